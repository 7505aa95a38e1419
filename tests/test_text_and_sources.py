"""Texts, manifests, photo folders, sinks and warnings in words."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import pages as PG
from pagequarry.functions import text as TX
from pagequarry.operators import wording as WD
from pagequarry.plans import album_run as RUN
from pagequarry.sources import inventory, sinks
from pagequarry.sources.manifest import manifest_pages
from pagequarry.sources.reports import parsed_outlines, report_rows


def _col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_page_sizes(spark):
    good = {"10x12in": (10, 12), " Letter ": (8.5, 11), "254x305mm": (10, 305 / 25.4), "25.4 x 30.5cm": (10, 30.5 / 2.54), "A4": (210 / 25.4, 297 / 25.4), ".5x.5in": (0.5, 0.5)}
    for got, want in zip(_col(spark, list(good), TX.page_size), good.values()):
        assert (got.a_in, got.b_in) == pytest.approx(want)
    assert _col(spark, ["10x12", "10in", "0x5in", "axbin", "", "-1x2in", "10x12ft"], TX.page_size) == [None] * 7
    assert _col(spark, ["0.125in", "3mm", "0mm", "3"], TX.length_inches) == [0.125, pytest.approx(3 / 25.4), 0.0, None]


def test_natural_order_and_slugs(spark):
    names = ["page-10", "P1", "page-2", "p10", "p1a", "page-1", "p2"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(TX.natural_key(F.col("n"))).collect()] == ["P1", "p1a", "p2", "p10", "page-1", "page-2", "page-10"]
    assert _col(spark, ["a b/c", "--..", "x."], TX.slug) == ["a-b-c", "page", "x"]


def test_ids_and_times(spark):
    u = "0A1B2C3D-0000-4000-8000-00000000000F"
    assert _col(spark, [u, u.replace("-", ""), "x"], TX.canonical_id) == [u.lower(), None, None]
    assert _col(spark, ["2024-05-01T10:00:00.123456789Z", "2024-05-01T10:00:00+02:00", "2024-13-01T10:00:00Z", "2024-05-01"], TX.utc_time) == ["2024-05-01T10:00:00.123Z", "2024-05-01T08:00:00.000Z", None, None]


def test_print_plan(spark):
    df = spark.createDataFrame([(2000, 1000, 12.0, 10.0), (3000, 3600, 12.0, 10.0)], "w int, h int, l double, s double")
    p = PG.print_plan(F.col("w"), F.col("h"), F.col("l"), F.col("s"), F.lit(300), F.lit("auto"), bleed_in=0.125)
    a, b = df.select(*[c.alias(n) for n, c in p.items()]).collect()
    assert (a.px_w, a.px_h, a.bleed_px, a.fit_used) == (3676, 3076, 38, "fit")
    assert [w.code for w in a.warnings] == ["aspect_mismatch", "upsampled"]
    assert (b.px_w, b.px_h, b.fit_used, b.warnings) == (3076, 3676, "stretch", [])


def test_manifest_errors_name_their_place(spark):
    bad = {
        "keys": '{"titel": 1, "pages": ["a"]}', "size": '{"page_size": "9x", "pages": ["a"]}', "fit": '{"fit": "big", "pages": ["a"]}', "list": '{"pages": 3}',
        "folder": '{"pages": [{"name": "a"}]}', "twice": '{"pages": ["a", "a"]}', "rotate": '{"pages": [{"folder": "a", "rotate": 45}]}', "json": "{",
    }
    good = '{"title": "t", "page_size": "a4", "fit": "fill", "pages": ["a", {"folder": "b c", "name": "B", "rotate": 90, "page_size": "10x12in"}]}'
    df = spark.createDataFrame([*bad.items(), ("good", good)], "album string, text string")
    pages, rejects = manifest_pages(df)
    assert {r.album for r in rejects.collect()} == set(bad)
    rows = pages.orderBy("index").collect()
    assert [(r.folder, r.name, r.slug, r.rotate, r.fit) for r in rows] == [("a", "a", "a", 0, "fill"), ("b c", "B", "b-c", 90, "fill")]
    assert rows[1]["size"].b_in == 12


def test_photo_folder_listing(spark, tmp_path):
    for name in ("page-2/b.JPG", "page-2/a10.png", "page-2/a9.png", "page-2/.hidden.jpg", "page-2/notes.txt", "page-10/x.tif", ".git/y.jpg", "empty/readme.md"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"\xff\xd8" + name.encode())
    rows = inventory.photos(spark, str(tmp_path)).orderBy("folder", "ordinal").collect()
    assert [(r.folder, r.photo) for r in rows] == [("page-10", "x.tif"), ("page-2", "a9.png"), ("page-2", "a10.png"), ("page-2", "b.JPG")]
    assert inventory.hashed(spark, str(tmp_path)).filter("jpeg").count() == inventory.listing(spark, str(tmp_path)).count()


def test_pixels_of_an_image(spark, tmp_path):
    import struct
    import zlib

    raw = b"".join(b"\0" + bytes([10 * y + x for x in range(3) for _ in range(3)]) for y in range(2))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    rows = inventory.pixels(spark, str(tmp_path)).orderBy("y", "x").collect()
    assert [(r.y, r.x, r.b, r.g, r.r) for r in rows] == [(y, x, *[10 * y + x] * 3) for y in range(2) for x in range(3)]


def test_file_roles(spark):
    paths = {"/d/albums/a/photos/p/s.jpg": "photo", "/d/albums/a/thumbs/s.jpg": "thumb", "/d/albums/a/work/p/x": "work", "/d/albums/a/out/p/run-1/r.json": "output", "/d/albums/a/report.json": "album", "/d/albums/a/x.tmp": "temporary", "/d/index": "outside"}
    got = {r.path: r.role for r in inventory.roles(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == paths


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("p1", 1), ("p2", 2)], "page string, v int")
    sinks.add_training_pages(s, str(tmp_path / "train"))
    sinks.add_training_pages(s.unionByName(spark.createDataFrame([("p3", 3)], "page string, v int")).withColumn("v", F.col("v") + 10), str(tmp_path / "train"))
    assert sorted((r.page, r.v) for r in spark.read.parquet(str(tmp_path / "train")).collect()) == [("p1", 1), ("p2", 2), ("p3", 13)]
    with pytest.raises(ValueError):
        sinks.write_numbers(s, os.path.join(str(tmp_path), "x"), str(tmp_path))
    pub = sinks.Published(spark, str(tmp_path / "pub"))
    rows = lambda v, ids: spark.createDataFrame([(i, v) for i in ids], "page_id int, v string")
    pub.write_run("r1", rows("old", [1, 2]))
    pub.adopt("r1", 1, rows("old", [1, 2]))
    pub.write_run("r2", rows("new", [2]))
    assert sorted((r.page_id, r.v) for r in pub.read().collect()) == [(1, "old"), (2, "old")]
    pub.adopt("r2", 2, rows("new", [2]))
    assert sorted((r.page_id, r.v) for r in pub.read().collect()) == [(1, "old"), (2, "new")]


def test_broken_reports_are_recorded(spark):
    good = json.dumps({"version": 1, "dpi": 400, "pages": [{"name": "a", "status": "ok", "print": "p.jpg"}]})
    df = spark.createDataFrame([("a", good), ("b", "{"), ("c", None), ("d", '{"pages": [{"status": "failed", "error": "bad"}]}')], "key string, text string")
    got = {r.key: (r.error, r.dpi) for r in report_rows(df).collect()}
    assert got == {"a": (None, 400), "b": ("report not readable", 300), "c": ("report missing", 300), "d": ("bad", 300)}
    assert _col(spark, ['{"s": [[0, 0], [1, 0], [1, 1]], "t": [[0, 0]]}'], parsed_outlines) == [{"s": [[0, 0], [1, 0], [1, 1]]}]


def test_page_failures_stay_on_their_page(spark):
    import pandas as pd

    def runner(pdf):
        if pdf.page_id.iloc[0] == 2:
            raise RuntimeError("cannot read photo")
        return pd.DataFrame({"page_id": [int(pdf.page_id.iloc[0])], "n": [len(pdf)]})

    rows = RUN.run_pages(spark.createDataFrame([(1,), (1,), (2,), (3,)], "page_id long"), runner, "page_id long, n long").orderBy("page_id").collect()
    assert [(r.page_id, r.n, r.error) for r in rows] == [(1, 2, None), (2, None, "cannot read photo"), (3, 1, None)]


def test_many_pages_share_a_batch_and_keep_their_rows_and_types(spark):
    import pandas as pd

    big = (1 << 53) + 1
    rows = [(k, big, True, "s") for k in range(300) for _ in range(k % 4 + 1)] + [(None, 1, None, None), (None, None, False, "t"), (300, None, True, None), (300, 5, True, "u")]

    def runner(pdf):
        if pdf["page_id"].iloc[0] == 7:
            raise ValueError("bad")
        assert list(pdf.index) == list(range(len(pdf)))
        return pd.DataFrame({"page_id": [pdf["page_id"].iloc[0]], "n": [len(pdf)], "top": [pdf["v"].max()], "kind": [f"{pdf['v'].dtype} {pdf['b'].dtype}"]})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = RUN.run_pages(spark.createDataFrame(rows, "page_id long, v long, b boolean, s string"), runner, "page_id long, n long, top long, kind string")
        got = {r.page_id: (r.n, r.top, r.kind, r.error) for r in out.collect()}
        plan = out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 302 and got[7] == (None, None, None, "ValueError: bad")
    assert all(got[k] == (k % 4 + 1, big, "int64 bool", None) for k in range(300) if k != 7)
    assert got[None] == (2, 1, "float64 object", None) and got[300] == (2, 5, "float64 bool", None)
    assert "FlatMapGroupsInPandas" not in plan  # no group of its own for each page


def test_pages_stay_whole_where_a_join_below_turns_into_a_broadcast(spark):
    import pandas as pd

    photos = spark.range(2000).select(F.lit(None).cast("long").alias("x"), (F.col("id") % 100).alias("page_id")).repartition(4, "x")
    todo = spark.range(100).select(F.col("id").alias("page_id")).groupBy("page_id").count().select("page_id")
    out = RUN.run_pages(photos.groupBy("page_id", F.rand(1).alias("r")).count().join(todo, "page_id"), lambda pdf: pd.DataFrame({"page_id": [pdf["page_id"].iloc[0]], "n": [len(pdf)]}), "page_id long, n long")
    assert sorted((r.page_id, r.n) for r in out.collect()) == [(k, 20) for k in range(100)]


def test_glare_words(spark):
    rows = [("a", 1, 1, "top"), ("b", 2, 2, "left"), ("c", 3, 1, "centre"), ("d", 2, 0, "top")]
    df = spark.createDataFrame(rows, "page_id string, n long, single long, largest string").withColumn("fraction", F.lit(0.125))
    m = {r.page_id: r.message for r in WD.glare_message(df).collect()}
    assert m["a"] == "Glare remains on 12.5% of the page in 1 area (top). It was seen by only one photo; add a shot of that area from a different angle."
    assert "2 areas (largest left). Each was seen by only one photo" in m["b"]
    assert "1 of them was seen by only one photo" in m["c"] and m["c"].endswith("change the light or the camera angle for those.")
    assert m["d"].endswith("Every photo had glare there; change the light or the camera angle for all the shots.")


def test_single_coverage_words(spark):
    rows = [("a", 1, "right", 0.2, 0.0, ["right"]), ("b", 1, "centre", 0.3, 0.01, []), ("b", 2, "top-left", 0.1, 0.4, ["top"]), ("c", 1, "bottom", 0.2, None, [])]
    df = spark.createDataFrame(rows, "page_id string, ord int, location string, area double, glare_seen double, edges array<string>")
    fr = spark.createDataFrame([(p, 0.25) for p in "abc"], "page_id string, fraction double")
    m = {r.page_id: r.message for r in WD.single_coverage_message(df, fr, ["page_id"]).collect()}
    assert m["a"] == "Only one photo covers the right edge (25.0% of the page). Take another shot of that part from a different angle so that glare there can be removed."
    assert m["b"].startswith("Only one photo covers the top-left corner, and glare was seen there (10.0% of the page). 1 other area is in one photo only too")
    assert m["c"].startswith("Only one photo covers the bottom (25.0%")


def test_bucketed_sinks_keep_their_keys(spark, tmp_path):
    cells = spark.createDataFrame([(p, l, y, 0) for p in range(40) for l in ("glare", "shadow") for y in range(3)], "page_id long, layer string, y int, x int")
    sinks.write_layers(cells, str(tmp_path / "layers"))
    back = spark.read.parquet(str(tmp_path / "layers"))
    assert sorted(map(tuple, back.select(*cells.columns).collect())) == sorted(map(tuple, cells.collect()))
    assert len(list((tmp_path / "layers" / "layer=glare").glob("bucket=*"))) <= sinks.BUCKETS


def test_a_broken_training_folder_is_not_taken_for_a_missing_one(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader raises
        sinks.add_training_pages(spark.createDataFrame([("p", 1)], "page string, v int"), str(tmp_path / "train"))
    assert not sinks._exists(spark, str(tmp_path / "nothing"))


def test_no_local_checkpoints_on_a_cluster():
    from types import SimpleNamespace

    from pagequarry.session import ensure_checkpoint_dir

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://somewhere:7077")
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_album_reports_are_one_row_an_album(spark, tmp_path):
    e = spark.createDataFrame([("a", 2, "p2", "ok", True), ("a", 1, "p1", "failed", False), ("b", 1, "q", "ok", False)], "album_id string, position int, page_id string, status string, has_image boolean")
    sinks.write_album_reports(e, str(tmp_path / "reports"))
    rows = {r.album_id: r for r in spark.read.json(str(tmp_path / "reports")).collect()}
    assert sorted(rows) == ["a", "b"] and [x.page_id for x in rows["a"].pages] == ["p1", "p2"]
    assert (rows["a"].pages_found, rows["a"].pages_ok, rows["a"].pages_failed, rows["a"].pdf_pages) == (2, 1, 1, 1)


def test_published_batches_again_and_compacted(spark, tmp_path):
    pub = sinks.Published(spark, str(tmp_path / "pub"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "page_id int")
    make = lambda v: lambda pages: pages.withColumn("v", F.lit(v))
    now = lambda: sorted((r.page_id, r.v, r.run) for r in pub.read().collect())
    pub.compact()  # nothing there yet
    pub.publish(ids(1, 2, 2), 0, make("a"))
    pub.publish(ids(2, 3), 1, make("b"))
    want = [(1, "a", "batch-0"), (2, "b", "batch-1"), (3, "b", "batch-1")]
    assert now() == want
    pub.publish(ids(2, 3), 1, make("b"))  # the batch done again
    pub.publish(ids(), 2, make("c"))
    assert now() == want
    pub.compact()
    pub.compact()
    assert now() == want and pub._generation() == 2
    pub.publish(ids(1), 3, make("d"))
    assert now() == [(1, "d", "batch-3"), *want[1:]]
    ready = tmp_path / "ready"
    ids(3, 4).coalesce(1).write.json(str(ready))
    stream = spark.readStream.schema("page_id int").json(str(ready))
    fresh = sinks.Published(spark, str(tmp_path / "stream"))
    for _ in range(2):  # a restart finds nothing new
        fresh.publish_stream(stream, make("s"), str(tmp_path / "checkpoint"))
    assert [(r.page_id, r.v) for r in fresh.read().orderBy("page_id").collect()] == [(3, "s"), (4, "s")]


def test_strict_runs_stop_and_others_show_placeholders(spark):
    import pandas as pd

    rows = [("a", i, f"f{i}", i, "no photos" if i == 4 else None, "failed" if i == 4 else "reprint" if i == 2 else "process") for i in range(1, 7)] + [("b", 11, "g", 1, None, "reuse"), ("c", 12, "h", 1, "no photos", "failed")]
    decided = spark.createDataFrame(rows, "album_id string, page_id long, folder string, index long, problem string, decision string")
    photos = spark.createDataFrame([(i, k) for i in range(1, 13) for k in range(2)], "page_id long, k int")

    def runner(pdf):
        if pdf["page_id"].iloc[0] == 3:
            raise RuntimeError("blurred")
        return pd.DataFrame({"page_id": [pdf["page_id"].iloc[0]], "n": [len(pdf)]})

    def printer(pdf):
        return pd.DataFrame({"page_id": [pdf["page_id"].iloc[0]], "from": [pdf["decision"].iloc[0]]})

    def entries(strict, placeholder=True):
        e = RUN.run_album(decided, photos, runner, "page_id long, n long", printer=printer, print_schema="page_id long, from string", strict=strict)
        return {r.page_id: (r.status, r.error, r.image, r["from"]) for r in RUN.recorded(e, strict, placeholder).collect()}, RUN.recorded(e, strict, placeholder)

    got, table = entries(False)
    assert got[1] == ("ok", None, "print/f1", "process") and got[2] == ("reprinted", None, "print/f2", "reprint") and got[3] == ("failed", "blurred", "placeholder/f3", None)
    assert got[4] == ("failed", "no photos", "placeholder/f4", None) and got[11] == ("reused", None, "print/g", None)
    assert {r.album_id: (r.images, r.pages) for r in RUN.pdf_pages(table).collect()}["a"] == (["print/f1", "print/f2", "placeholder/f3", "placeholder/f4", "print/f5", "print/f6"], 6)
    strict, table = entries(True)
    assert strict[2][0] == "reprinted" and strict[3] == ("failed", "blurred", None, None) and all(strict[i] == ("stopped", None, None, None) for i in (4, 5, 6))
    assert {r.album_id for r in RUN.pdf_pages(table).collect()} == {"a", "b"}
    assert {r.album_id: (r.page_id, r.error) for r in RUN.first_failure(spark.createDataFrame([("a", 3, 3, "failed", "x"), ("a", 4, 4, "failed", "y")], "album_id string, page_id long, index long, status string, error string")).collect()} == {"a": (3, "x")}
    assert entries(False, placeholder=False)[0][3] == ("failed", "blurred", None, None)


def test_missing_and_empty_folders_are_problems(spark):
    pages = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("a", "p3")], "album_id string, folder string")
    found = RUN.with_problems(pages, pages.limit(2), pages.limit(1).unionAll(pages.limit(1)))
    assert {r.folder: r.problem for r in found.collect()} == {"p1": None, "p2": "no photos in 'p2'", "p3": "folder 'p3' not found"}


def test_an_album_run_decides_and_makes_each_page_once(spark, tmp_path):
    import uuid

    at = str(tmp_path)

    def decide(i):
        open(f"{at}/decided-{i}-{uuid.uuid4().hex}", "w").close()
        return "process" if i % 2 else "reprint"

    pages = spark.createDataFrame([(1, i, f"p{i}", i + 1, None) for i in range(6)], "album_id long, page_id long, folder string, index int, problem string")
    pages = pages.withColumn("decision", F.udf(decide)("page_id"))
    photos = spark.createDataFrame([(i, i) for i in range(6) for _ in range(2)], "page_id long, bytes long")

    def made(kind, pdf):
        open(f"{at}/{kind}-{pdf['page_id'].iloc[0]}-{uuid.uuid4().hex}", "w").close()
        pdf["bytes"] = 0  # a page's frame can be changed
        return {"page_id": pdf["page_id"].iloc[0], "n": len(pdf)}

    def printer(pdf):
        assert pdf["n"].dtype == ("int64" if pdf["decision"].iloc[0] == "process" else "float64") and list(pdf.index) == [0]
        if pdf["page_id"].iloc[0] == 4:
            raise ValueError("cannot print")
        return {"page_id": made("printed", pdf)["page_id"], "printed": True}

    e = RUN.run_album(pages, photos, lambda pdf: made("run", pdf), "page_id long, n long", printer=printer, print_schema="page_id long, printed boolean", strict=True)
    out = RUN.recorded(e.select("album_id", "page_id", "folder", "index", "status", "error"), True).orderBy("index").collect()
    assert [r.status for r in out] == ["reprinted", "ok", "reprinted", "ok", "failed", "stopped"] and out[4].error == "ValueError: cannot print"
    assert sorted(f.rsplit("-", 1)[0] for f in os.listdir(at)) == [*[f"decided-{i}" for i in range(6)], *[f"printed-{i}" for i in (0, 1, 2, 3, 5)], *[f"run-{i}" for i in (1, 3, 5)]]


def test_a_page_may_be_longer_than_a_batch(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        pages = spark.createDataFrame([(k, None if v == 8 else v) for k in (1, 2) for v in range(10)] + [(3, 1)], "page_id long, v long")
        out = RUN.run_pages(pages, lambda pdf: {"page_id": pdf["page_id"].iloc[0], "n": len(pdf), "kind": str(pdf["v"].dtype)}, "page_id long, n long, kind string")
        assert sorted(tuple(r) for r in out.collect()) == [(1, 10, "float64", None), (2, 10, "float64", None), (3, 1, "int64", None)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
