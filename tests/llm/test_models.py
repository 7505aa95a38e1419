"""Classifiers on planted classes: held-out accuracy, folds, and awkward rows."""

import random
import zlib

import pytest

from pagequarry.llm import quality, toxicity

from .helpers import awkward_texts, prose, table


def corpus(n=700):
    r = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        t, bad, toxic = prose(1000 + i, r.randint(20, 200)), i % 4 == 0, i % 5 == 0
        if bad:
            t = " | ".join(t.split())
        if toxic:
            w = t.split(" ")
            for _ in range(6):
                w.insert(r.randrange(len(w)), r.choice(["vorquel", "vorquen", "zimbak"]))
            t = " ".join(w)
        docs.append((i, t))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def known(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator,column,folds,out", [(quality, 1, 4, 2), (toxicity, 2, 3, 1)])
def test_held_out_accuracy(spark, operator, column, folds, out):
    docs, labels = corpus()
    got = {r.doc_id: r for r in operator.scored(table(spark, docs), known(spark, labels)).collect()}
    assert len(got) == len(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % folds == out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(got[x[0]].predicted, x[column]) for x in labels if got[x[0]].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95


@pytest.mark.parametrize("operator,column", [(quality, 1), (toxicity, 2)])
def test_held_out_labels_are_never_learnt(spark, operator, column):
    docs, labels = corpus(200)
    folds, out = (4, 2) if operator is quality else (3, 1)
    flipped = [tuple(1 - v if k == column and zlib.crc32(str(x[0]).encode()) % folds == out else v for k, v in enumerate(x)) for x in labels]
    a, b = ({r.doc_id: r.score for r in operator.scored(table(spark, docs), known(spark, x)).collect()} for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_awkward_rows_and_labels(spark, operator):
    docs, labels = corpus(120)
    odd = [(None, 1, 1), (1, None, None), (2, 7, 7), (3, 1, 0), (3, 0, 1), (99_999, 1, 0)]
    got = operator.scored(table(spark, docs + [(i and 1000 + i, t) for i, t in awkward_texts()]), known(spark, labels + odd)).collect()
    assert len(got) == len(docs) + len(awkward_texts()) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1001] == by[1002] and by[1007] == by[1009]


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_without_rows_or_labels(spark, operator):
    docs, labels = corpus(20)
    none = known(spark, labels).where("doc_id < 0")
    assert {r.score for r in operator.scored(table(spark, docs), none).collect()} == {0.5}
    assert operator.scored(table(spark, docs).where("doc_id < 0"), known(spark, labels)).count() == 0


def test_accepted_keeps_rows_whole(spark):
    docs, labels = corpus(300)
    model = quality.fit(table(spark, docs), known(spark, labels))
    kept = quality.accepted(table(spark, docs), model)
    scores = {r.doc_id: r.quality for r in quality.score(table(spark, docs), model).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in scores.items() if s >= 0.7) and kept.schema == table(spark, docs).schema


def test_shared_backoff_is_neutral():
    import numpy as np

    grams = np.arange(64, 96)
    model = toxicity.ToxicityModel(grams, np.full(32, 5), np.full(32, 5))
    assert np.abs(model.ratios()).max() == 0


def test_words_of_other_scripts_are_told_apart(spark):
    r = random.Random(4)
    letters = {"cyrillic": "абвгдежзиклмнопрст", "greek": "αβγδεζηθικλμνοπρσ", "kana": "かきくけこさしすせそたちつ"}
    bad = {k: ["".join(r.choice(a) for _ in range(6)) for _ in range(2)] for k, a in letters.items()}
    docs, labels = [], []
    for i in range(600):
        k, a = list(letters.items())[i % 3]
        w = ["".join(r.choice(a) for _ in range(r.randint(2, 7))) for _ in range(r.randint(20, 80))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad[k]).upper() if r.random() < 0.3 else r.choice(bad[k]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    got = [(r.predicted, labels[r.doc_id][2]) for r in toxicity.scored(table(spark, docs), known(spark, labels)).collect() if r.held_out]
    assert sum(a == b for a, b in got) / len(got) > 0.95


def test_word_buckets_do_not_depend_on_what_stands_beside():
    import numpy as np

    read = toxicity.Reader()
    texts = ["naïve ÉTÉ, слово!", "", "слово", "x" * 400_000 + " слово", "12 ... 😀", "été"]
    bucket, n = read.words(texts)
    by = np.split(bucket, np.cumsum(n)[:-1])
    assert n.tolist() == [3, 0, 1, 2, 0, 1]
    assert by[0][2] == by[2][0] == by[3][1] and by[0][1] == by[5][0] and len({int(x) for x in bucket}) == 4
    assert [len(read.words([t])[0]) for t in texts] == n.tolist()


def test_rare_words_say_nothing():
    import numpy as np

    grams = np.array([toxicity.GRAMS + k for k in range(40)])
    toxic, ordinary = np.full(40, 1), np.full(40, 50)
    toxic[0], ordinary[0] = 30, 0
    ratio = toxicity.ToxicityModel(grams, toxic, ordinary).word_ratios()
    assert ratio[0] > 2 and (ratio[1:40] < 0).all() and ratio[50] == ratio[51]
