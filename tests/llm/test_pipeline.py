"""The pipeline's stages one by one on a small folder, against what each should keep."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagequarry.llm import bpe, mixing, ngram_join, pipeline, quality, secrets

from .helpers import awkward_texts, prose, table


def test_stages(spark, tmp_path):
    r = random.Random(11)
    data = [(i, prose(i, r.randint(15, 120))) for i in range(260)]
    data = [(i, " | ".join(t.split()) if i % 4 == 0 else t) for i, t in data]
    data += [(1000 + i, data[4 * i + 1][1] + " end") for i in range(30)] + [(2000, prose(2000, 50) + " password=abcdef123456")]
    data += [(i and 3000 + i, t) for i, t in awkward_texts()]
    docs = table(spark, data).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(260)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    now, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    key = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=str)
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        out.write.parquet(str(tmp_path / f"stage{k}"))
        out = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append((now, out))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        now = out
    (before, after) = seen[0]
    scores = quality.score(before, quality.fit(before, labels), keep=("doc_id", "text"))
    assert key(after) == key(scores.where(f"quality >= {quality.THRESHOLD}"))
    assert sum(x.doc_id is not None and x.doc_id < 260 and x.doc_id % 4 != 0 for x in after.collect()) > 0.97 * 195
    before, after = seen[1]
    known = {x.doc_id: x.text for x in before.collect() if x.doc_id is not None}
    want = {i for i, (_, c) in ngram_join.brute_force(known).items() if i == c}
    assert {x.doc_id for x in after.collect() if x.doc_id is not None} <= set(known) and not {x.doc_id for x in after.collect()} - want - {None}
    before, after = seen[2]
    assert after.count() == before.count() and all(not secrets.find_secrets(x.text or "")[0] and (x.text is None or x.n_chars == len(x.text)) for x in after.collect())
    before, after = seen[3]
    taken = mixing.mix(before).collect()
    assert after.count() == sum(x.taken // x["size"] for x in taken if x["size"])
    before, after = seen[4]
    assert after.count() == before.count()
    assert sorted((str(x.doc_id), x.n_tokens) for x in after.collect()) == sorted((str(x.doc_id), x.n_tokens) for x in bpe.encode(before).collect())


@pytest.mark.parametrize("labelled", [[], [(i, 0, 0) for i in range(20)], [(i, None, 1) for i in range(20)]])
def test_quality_stage_keeps_all_without_both_classes(spark, tmp_path, labelled):
    docs = table(spark, [*awkward_texts(), *((i, prose(i, 30)) for i in range(20, 40))])
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.quality_stage(spark, docs, str(tmp_path)).exceptAll(docs).count() == 0
    assert pipeline.quality_stage(spark, docs, str(tmp_path)).count() == docs.count()


def test_near_copy_stage_keeps_one_row_of_each_group(spark):
    text = {k: prose(k, 40) for k in range(6)}
    data = [(1, text[0]), (2, text[0]), (2, text[1]), (3, text[2]), (3, text[2]), (3, text[2] + " end")]  # 2 is a copy and a clean text
    data += [(None, text[3])] * 3 + [(None, text[3] + " end"), (None, text[1]), (None, text[4]), (9, text[5]), (None, text[5])]
    data += [(7, None), (7, None), (None, None), (8, "")]
    docs = table(spark, data)
    out = pipeline.near_copy_stage(spark, docs, "")
    assert out.schema == docs.schema
    got = [(x.doc_id, x.text) for x in out.collect()]
    for k in range(6):
        assert sum((t or "").startswith(text[k]) for _, t in got) == 1
    assert {(1, text[0]), (2, text[1]), (9, text[5]), (None, text[4])} <= set(got)
    assert sorted((x for x in got if not x[1]), key=str) == sorted([(7, None), (7, None), (None, None), (8, "")], key=str)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"] and out.count() > 0


def test_stages_take_empty_tables_and_clashing_columns(spark, tmp_path):
    data = [(i, prose(i, 30)) for i in range(20)] + [(40, prose(3, 30) + " end"), (40, prose(3, 30) + " end"), (3, prose(3, 30))] + awkward_texts()
    docs = table(spark, data)
    clash = ["_own", "_ident", "_row", "_rank", "_n", "_text", "_key", "total", "target", "weight", "limit_1", "quality", "sid"]
    docs = docs.withColumns({c: F.concat(F.lit("x"), F.col("doc_id").cast("string")) for c in clash})
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            kept = out.drop("text", "n_chars").exceptAll(rows.drop("text", "n_chars").unionAll(rows.drop("text", "n_chars")))
            assert kept.count() == 0, name
        assert stage_rows(corpus_pipeline.STAGES[4][1](spark, rows, str(tmp_path))) == rows.count()
    assert pipeline.near_copy_stage(spark, docs, "").exceptAll(docs).count() == 0


def stage_rows(df):
    return len(df.collect())
