"""The album state machine and the other stateful streams, run over files that are there now."""

import json
import random
import os

import pandas as pd
from pyspark.sql import functions as F

from pagequarry.streaming import oplog as OL
from pagequarry.streaming import stateful as ST

S = 1_000_000
SCHEMA = "album_id long, seq long, us long, kind string, page_id string, shot_id string, sha string, gen long, pages string"


START = 1_000_000  # seconds


def _files(tmp_path, batches, name="ops"):
    src = tmp_path / name
    src.mkdir()
    for i, rows in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken oldest first
    return str(src)


def _ops(batches, album=1):
    """Rows of operations (second, kind, page, shot, sha, pages), numbered through all batches."""
    out, seq = [], 0
    for ops in batches:
        out.append([])
        for t, kind, page, shot, sha, *pages in ops:
            seq += 1
            out[-1].append(dict(album_id=album, seq=seq, us=int((START + t) * S), kind=kind, page_id=page, shot_id=shot, sha=sha, gen=0, pages=",".join(pages[0]) if pages else ""))
    return out


def _run(spark, tmp_path, batches, idle=10, wait=0, name="ops", rows=None):
    src = _files(tmp_path, rows or [list(reversed(b)) for b in _ops(batches)], name)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    out = ST.run_to_table(ST.album_transitions(stream, idle, wait), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp"))
    got = out.orderBy("us", F.col("seq").asc_nulls_first(), "event").collect()
    return [(r.event, r.page_id, r.state) for r in got], out


def test_idle_next_page_and_runs(spark, tmp_path):
    got, _ = _run(spark, tmp_path, [
        [(0, "ALBUM_META", None, None, "letter", ["p1"]), (1, "PUT_SHOT", "p1", "s1", "h1"), (2, "PUT_SHOT", "p1", "s1", "h1"), (3, "PUT_SHOT", "p1", "s1", "other")],
        # Nine seconds after the last change nothing happens, ten seconds after it the page is ready.
        [(10, "TICK", None, None, None), (11, "TICK", None, None, None), (12, "CLAIM", "p1", None, None), (13, "PUT_SHOT", "p1", "s2", "h2"), (14, "RUN_END", "p1", None, "out")],
        # A new page makes the one before it ready at once.
        [(15, "ALBUM_META", None, None, "letter", ["p1", "p2"]), (16, "CLAIM", "p1", None, None), (17, "RUN_END", "p1", None, "out2")],
    ])
    assert got[:8] == [
        ("meta", None, None), ("stored", "p1", "changed"), ("repeat", "p1", "changed"), ("conflict", "p1", "changed"),
        # Nothing at ten seconds (the last change is at one), ready at eleven.
        ("ready", "p1", "ready"), ("processing", "p1", "processing"), ("stored", "p1", "processing"), ("adopted", "p1", "changed"),
    ]
    # Rows of one operation come in no particular order.
    assert set(got[8:10]) == {("ready", "p1", "ready"), ("meta", None, None)}
    assert got[10] == ("processing", "p1", "processing")
    assert set(got[11:]) == {("adopted", "p1", "done"), ("assemble", None, None)}


def test_a_page_turns_ready_without_a_later_operation(spark, tmp_path):
    rows = _ops([[(0, "ALBUM_META", None, None, "a4", ["p1"]), (1, "PUT_SHOT", "p1", "s1", "h")]])
    other = _ops([[(30, "TICK", None, None, None)]], album=2)  # another album moves the clock on
    got, out = _run(spark, tmp_path, None, rows=rows + other)
    assert got == [("meta", None, None), ("stored", "p1", "changed"), ("ready", "p1", "ready")]
    ready = out.filter("event = 'ready'").first()
    assert ready.us == (START + 11) * S and ready.seq is None and ready.album_id == 1


def test_albums_begin_with_a_put_and_runs_go_by_generation(spark, tmp_path):
    got, _ = _run(spark, tmp_path, [
        # The first size touches pages that are there: idle from its time on, with a generation more.
        [(0, "PUT_SHOT", "p1", "s1", "h"), (8, "ALBUM_META", None, None, "a4", ["p1"])],
        [(19, "CLAIM", "p1", None, None), (20, "RECOVER", None, None, None), (21, "RUN_END", "p1", None, "out"), (22, "RUN_END", "p7", None, "out")],
        # A refused move to a new page leaves no page: metadata later finds nothing to keep or drop.
        [(23, "PUT_SHOT", "p2", f"x{0}", "h")] + [(24, "PUT_SHOT", "p2", f"x{i}", "h") for i in range(1, 25)] + [(25, "PUT_SHOT", "p3", "y1", "h"), (25, "PUT_SHOT", "p3", "y2", "h")],
        [(26, "MOVE_SHOTS", "p9", ",".join([*(f"x{i}" for i in range(25)), "y1"]), None), (27, "CLAIM", "p9", None, None), (28, "RUN_END", "p9", None, "out")],
    ])
    at = {e: i for i, (e, *_) in enumerate(got)}
    assert got[:2] == [("stored", "p1", "changed"), ("meta", None, None)] and got[2] == ("ready", "p1", "ready")  # at 18, not at 10
    # Put back by the recovery, the page has been idle for long enough; the run's end still counts.
    assert got[3] == ("processing", "p1", "processing") and set(got[4:6]) == {("recovered", "p1", "changed"), ("ready", "p1", "ready")} and got[6] == ("adopted", "p1", "done")
    assert ("gone", "p7", None) in got and got[-1] == ("gone", "p9", None)
    assert got[at["refused_shots"]] == ("refused_shots", "p9", None)


def _random_ops(seed, n):
    r, t, out = random.Random(seed), 0, []
    for _ in range(n):
        t += r.choice([0, 1, 1, 2, 3, 12])
        kind = r.choice(["PUT_SHOT"] * 6 + ["ALBUM_META", "ALBUM_META", "DELETE_SHOT", "MOVE_SHOTS", "MOVE_SHOTS", "CLAIM", "CLAIM", "RUN_END", "RUN_END", "TICK", "RECOVER", "DELETE_PAGE"] + ["DELETE_ALBUM"] * (r.random() < 0.1))
        page, shots = f"p{r.randrange(6)}", [f"s{r.randrange(40)}" for _ in range(r.randint(1, 4))]
        sha = r.choice(["a4", "letter"]) if kind == "ALBUM_META" else r.choice(["h1", "h1", "h2", ""])
        pages = [f"p{i}" for i in r.sample(range(6), r.randint(0, 5))] if kind == "ALBUM_META" else []
        out.append((t, kind, page, ",".join(shots if kind == "MOVE_SHOTS" else shots[:1]), sha, pages))
    return out


def test_shuffled_files_give_the_same_table(spark, tmp_path):
    rows = [x for seed in (1, 2, 3) for b in _ops([_random_ops(seed, 250)], album=seed) for x in b]
    end = [dict(rows[0], album_id=9, us=(START + 5000) * S, kind="TICK")]
    key = lambda df: sorted((tuple(x) for x in df.collect()), key=str)
    rows.sort(key=lambda x: (x["us"], x["seq"]))
    whole = key(_run(spark, tmp_path, None, name="sorted", rows=[rows + end])[1])
    r = random.Random(4)
    late = sorted(rows, key=lambda x: x["us"] + r.randint(0, 60) * S)  # up to a minute out of order
    parts = [late[i : i + 80] for i in range(0, len(late), 80)]
    shuffled = key(_run(spark, tmp_path, None, wait=61, name="shuffled", rows=[*parts, end])[1])
    assert shuffled == whole and len({x[4] for x in whole}) > 14
    # Without waiting some operations come too late; each is reported and changes nothing.
    hasty = key(_run(spark, tmp_path, None, wait=0, name="hasty", rows=[*parts[1:5], parts[0], *parts[5:], end])[1])
    late_ones = {(x[0], x[1]) for x in hasty if x[4] == "late"}
    assert len(late_ones) > 10 and not any((x[0], x[1]) in late_ones and x[4] != "late" for x in hasty)


def test_states_follow_the_rules_one_by_one(spark, tmp_path):
    """A plain model of the rules over dictionaries, without idle time, against the stream's stored, moved and deleted shots."""
    ops = [(t, k, *rest) for t, k, *rest in _random_ops(7, 400) if k not in ("TICK", "RECOVER", "CLAIM", "RUN_END")]
    got, out = _run(spark, tmp_path, [ops], idle=10**6)
    events = {}
    for x in out.collect():
        events.setdefault(x.seq, set()).add(x.event)
    where, exists, pages = {}, False, set()
    for seq, (_, kind, page, shots, sha, listed) in enumerate(ops, 1):
        count = lambda p: sum(v[0] == p for v in where.values())  # noqa: E731, B023
        e = events.get(seq, set())
        if kind == "PUT_SHOT":
            if shots in where:
                assert e == {"repeat" if where[shots][1] == sha else "conflict"}
            elif count(page) >= 25:
                assert e == {"refused_shots"}
                pages.add(page)
            else:
                assert e == {"stored"}
                where[shots], exists = (page, sha), True
                pages.add(page)
        elif kind == "DELETE_SHOT":
            hit = where.get(shots, (None,))[0] == page
            if hit:
                del where[shots]
            assert e == ({"deleted"} | ({"emptied"} if count(page) == 0 else set()) if hit else set())
        elif kind == "MOVE_SHOTS":
            moving = {s for s in shots.split(",") if s in where and where[s][0] != page} if exists else set()
            if moving and count(page) + len(moving) > 25:
                assert e == {"refused_shots"}
                continue
            sources = {where[s][0] for s in moving}
            where.update({s: (page, where[s][1]) for s in moving})
            if exists:
                pages.add(page)
            assert e - {"ready"} == ({"moved"} if moving else set()) | ({"emptied"} if any(count(p) == 0 for p in sources) else set())
        elif kind == "ALBUM_META":
            exists = True
            pages = set(listed) | {p for p in pages if count(p)}
            assert "meta" in e
        elif kind == "DELETE_PAGE":
            assert e == ({"page_deleted"} if page in pages else set())
            pages.discard(page)
            where = {s: v for s, v in where.items() if v[0] != page}
        else:
            assert e == ({"album_deleted"} if exists else set())
            where, exists, pages = {}, False, set()


def test_moves_deletes_and_limits(spark, tmp_path):
    puts = [(1, "PUT_SHOT", "p1", f"s{i}", "h") for i in range(26)]
    got, _ = _run(spark, tmp_path, [
        [(0, "ALBUM_META", None, None, "a4", ["p1"]), *puts],
        [(2, "MOVE_SHOTS", "p2", "s0", None), (2, "MOVE_SHOTS", "p2", "s0", None), (3, "MOVE_SHOTS", "p2", "nope", None), (4, "DELETE_SHOT", "p2", "s0", None), (5, "PUT_SHOT", "p2", "s0", "new")],
        [(6, "DELETE_PAGE", "p1", None, None), (7, "PUT_SHOT", "p1", "s1", "again"), (8, "DELETE_ALBUM", None, None, None), (9, "PUT_SHOT", "p9", "s1", "h")],
    ])
    events = [e for e, *_ in got]
    assert events.count("stored") == 25 + 1 + 1 + 1 and events.count("refused_shots") == 1
    assert ("moved", "p2", "changed") in got and events.count("moved") == 1
    assert ("ready", "p1", "ready") in got  # the page shots were moved off is complete
    assert events.count("emptied") == 1 and ("page_deleted", "p1", None) in got and ("album_deleted", None, None) in got


def test_lists_move_whole_and_deletes_name_their_page(spark, tmp_path):
    puts = [(1, "PUT_SHOT", "p1", f"a{i}", "h") for i in range(10)] + [(1, "PUT_SHOT", "p2", f"b{i}", "h") for i in range(20)]
    got, _ = _run(spark, tmp_path, [
        [(0, "ALBUM_META", None, None, "a4", ["p1", "p2"]), *puts],
        [(2, "MOVE_SHOTS", "p2", ",".join(f"a{i}" for i in range(10)), None), (3, "MOVE_SHOTS", "p2", "a0,a1,a1,b3,none", None), (4, "DELETE_SHOT", "p1", "a0", None)],
        [(5, "MOVE_SHOTS", "p3", "none", None), (6, "ALBUM_META", None, None, "a4", ["p2", "p2"]), (7, "ALBUM_META", None, None, "a4", ["p4"])],
    ])
    events = [e for e, *_ in got]
    assert events.count("refused_shots") == 1 and events.count("moved") == 1 and "deleted" not in events and events.count("refused_repeat") == 1
    assert got[-1][0] in ("meta", "ready") and ("ready", "p1", "ready") in got


def test_throttle_and_late_feedback(spark, tmp_path):
    for n, rows in enumerate(([("t", 0), ("t", 59 * S), ("t", 60 * S), ("u", 5 * S)], [("t", 100 * S), ("t", 121 * S)])):
        spark.createDataFrame(rows, "token string, us long").coalesce(1).write.mode("append").json(str(tmp_path / "uses"))
    uses = spark.readStream.schema("token string, us long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "uses"))
    out = ST.run_to_table(ST.touched_tokens(uses), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert sorted((r.token, r.us // S) for r in out.collect()) == [("t", 0), ("t", 60), ("t", 121), ("u", 5)]
    rows = [(1, 1, 100, "changed"), (1, 2, 90, "done"), (1, 3, 100, "done"), (2, 4, 5, "done")]
    spark.createDataFrame(rows, "page_id long, seq long, us long, state string").coalesce(1).write.json(str(tmp_path / "fb"))
    fb = spark.readStream.schema("page_id long, seq long, us long, state string").json(str(tmp_path / "fb"))
    out = ST.run_to_table(ST.latest_feedback(fb), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert sorted((r.page_id, r.us, r.state) for r in out.collect()) == [(1, 100, "changed"), (1, 100, "done"), (2, 5, "done")]


def test_runs_without_a_claim_or_an_end(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02}:{s % 60:02}"
    claims = [dict(run=i, claimed_at=at(10 * i), gen=1, page_gen=1 + (i == 2), has_shots=i != 3, ready_at=1 if i == 5 else None) for i in (1, 2, 3, 5, 6)]
    ends = [dict(run=i, ended_at=at(10 * i + (400 if i == 6 else 5)), output=None if i == 1 else "out", error="e" if i == 1 else None) for i in (1, 2, 3, 4, 6)]
    clock = [dict(run=90, claimed_at=at(3500), gen=1, page_gen=1, has_shots=True, ready_at=None)], [dict(run=91, ended_at=at(3500), output="o", error=None)]
    read = lambda rows, name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(_files(tmp_path, rows, name))
    c = read([claims, clock[0]], "claims", "run long, claimed_at timestamp, gen int, page_gen int, has_shots boolean, ready_at int")
    e = read([ends, clock[1]], "ends", "run long, ended_at timestamp, output string, error string")
    out = ST.run_to_table(ST.run_results(c, e, 60, 0), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted((r.run, r.outcome, r.next_state) for r in out.collect() if r.run < 90 and r.run != 6) == [(1, "failed", "failed"), (2, "adopted", "changed"), (3, "discarded", "done"), (4, "gone", None), (5, "abandoned", "ready")]
    assert sorted((r.outcome, r.next_state or "") for r in out.collect() if r.run == 6) == [("abandoned", "changed"), ("gone", "")]


def test_newly_warned_stream_in_any_order(spark, tmp_path):
    hour = 3_600 * S
    polls = [(1, 1, "p"), (1, 2, "p"), (1, 2, "q"), (1, 3, None), (1, 4, "q"), (1, 9, "q"), (1, 10, "r"), (2, 4, "z"), (2, 5, "z"), (2, 5, "y")]
    rows = [dict(album_id=a, us=START * S + p * hour + i, seq=i, poll=p, until_us=START * S + (p + 1) * hour, page_id=x) for i, (a, p, x) in enumerate(polls)]
    end = [dict(rows[0], album_id=7, us=START * S + 99 * hour, seq=99)]
    stream = spark.readStream.schema("album_id long, us long, seq long, poll long, until_us long, page_id string").option("maxFilesPerTrigger", 1).json(_files(tmp_path, [rows[::-1][:5], rows[::-1][5:], end]))
    out = ST.run_to_table(ST.newly_warned(stream, 3 * 3_600, 20 * 3_600), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, "q"), (1, 4, "q"), (1, 10, "r"), (2, 5, "y")]


def test_thinning_by_doubling_is_the_greedy_one(spark, tmp_path):
    r = random.Random(8)
    times = {t: sorted(r.randrange(4000) for _ in range(n)) for t, n in (("busy", 600), ("few", 3), ("one", 1), ("same", 1))} | {"same": [5, 5, 5]}
    want = set()
    for token, all_ in times.items():
        last = None
        for x in all_:
            if last is None or x - last >= 60:
                want.add((token, x * S))
                last = x
    uses = spark.createDataFrame([(t, x * S) for t, all_ in times.items() for x in all_], "token string, us long")
    for hot in (None, 50):
        got = OL.thinned(uses, ["token"], 60, hot_rows=hot).collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    uses.coalesce(1).write.json(str(tmp_path / "uses"))
    stream = spark.readStream.schema("token string, us long").json(str(tmp_path / "uses"))
    assert {tuple(x) for x in ST.run_to_table(ST.touched_tokens(stream, 60), str(tmp_path / "o"), str(tmp_path / "c")).collect()} == want


def test_queue_compaction_and_drain(spark):
    q = spark.createDataFrame([(1, "a", "ALBUM_META", None, False), (2, "a", "PUT_SHOT", "s1", False), (3, "a", "PUT_SHOT", "s2", True), (4, "a", "ALBUM_META", None, False), (5, "a", "DELETE_SHOT", "s1", False), (6, "a", "DELETE_SHOT", "s2", False)], "seq long, album_id string, kind string, shot_id string, in_flight boolean")
    assert sorted(r.seq for r in OL.scanner_compacted(q).collect()) == [3, 4, 6]
    assert sorted(r.seq for r in OL.phone_compacted(q).collect()) == [3, 4, 5, 6]
    o = spark.createDataFrame([(1, "a", "done"), (2, "a", "drop"), (3, "a", "retry"), (4, "a", "done")], "seq long, album_id string, outcome string")
    want = {1: "sent", 2: "dropped", 3: "tried", 4: "waiting"}
    assert {r.seq: r.step for r in OL.drained(o).collect()} == want
    assert {r.seq: r.step for r in OL.drained(o, hot_rows=1).collect()} == want


def test_idle_gap_of_exactly_the_limit_closes(spark):
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate((0, 9, 19, 20))], "page string, seq long, t long").withColumn("ts", F.timestamp_seconds("t"))
    rows = OL.idle_islands(df, ["page"], 10, hot_rows=2).orderBy("start_us").collect()
    assert [(r.start_us // S, r.end_us // S, r.changes, r.ready_us // S) for r in rows] == [(0, 9, 2, 19), (19, 20, 2, 30)]


def test_scanner_queue_one_operation_after_another(spark):
    r = random.Random(6)
    rows = [(i, "a", r.choice(["PUT_SHOT", "DELETE_SHOT"]), f"s{r.randrange(12)}", r.random() < 0.04) for i in range(300)]
    rows += [(1000 + i, "b", ("PUT_SHOT", "DELETE_SHOT")[i % 2], "cycle", False) for i in range(8)]
    waiting, kept = {}, set()
    for seq, _, kind, shot, flying in rows:
        puts = waiting.setdefault(shot, [])
        if kind == "PUT_SHOT":
            puts.append((seq, flying))
            kept.add(seq)
        elif puts and not puts[0][1]:
            kept.discard(puts.pop(0)[0])
        else:
            kept.add(seq)
    q = spark.createDataFrame(rows, "seq long, album_id string, kind string, shot_id string, in_flight boolean")
    for hot in (None, 5):
        assert {x.seq for x in OL.scanner_compacted(q, hot_rows=hot).collect()} == kept
    assert not any(seq >= 1000 for seq in kept)


def test_newly_warned_looks_at_the_last_poll_made(spark):
    polls = spark.createDataFrame([("a", 1), ("a", 5), ("a", 6), ("b", 2)], "album_id string, poll long")
    warned = spark.createDataFrame([("a", 1, "p"), ("a", 5, "p"), ("a", 5, "q"), ("a", 6, "p"), ("b", 2, "p")], "album_id string, poll long, page_id string")
    assert [tuple(r) for r in OL.newly_warned_by_poll(warned, polls).collect()] == [("a", 5, "q")]


def test_idle_session_stream_gives_the_trailing_stretches_too(spark, tmp_path):
    from datetime import datetime, timedelta

    from pagequarry.mappings import Tables
    from pagequarry.registry import load

    start = datetime(2024, 1, 1)
    seen = [(1, 11, 0), (1, 11, 5), (1, 11, 24 * 60), (2, 25, 48 * 60 - 3), (2, 35, 48 * 60)]  # user, k, minutes
    rows = [(i, start + timedelta(minutes=m), u, "view", 1.0, json.dumps({"k": k})) for i, (u, k, m) in enumerate(seen)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").toPandas().astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    got = sorted((r.album_id, r.page_no, r.end_ms - r.start_ms, r.changes) for r in load()["idle_session_stream"].run(Tables(spark, str(tmp_path))).collect())
    assert got == [(1, 1, 0, 1), (1, 1, 300_000, 2), (2, 5, 180_000, 2)]


def test_puts_without_a_hot_group_are_shuffled_once(spark):
    rows = [(p, s, a, a % 2, 0.0, "h%d" % (a // 2), 1, None) for p in (1, 2, None) for s in "xy" for a in (3, 1, 2)]
    op = spark.createDataFrame(rows, "page_id long, shot_id string, arrival_a long, arrival_b long, arrival_c double, sha string, bytes long, taken date").withColumn("kind", F.lit("put"))
    out = OL.idempotent_puts(op.repartition("page_id", "shot_id"), ["page_id", "shot_id"], ["arrival_a", "sha"])
    got = {(r.page_id, r.shot_id, r.arrival_a): r.outcome for r in out.collect()}
    assert got == {(p, s, a): o for p in (1, 2) for s in "xy" for a, o in ((1, "stored"), (2, "conflict"), (3, "conflict"))}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_distinct_uploads_are_the_distinct_rows_of_the_uploads(spark, tmp_path):
    from pagequarry.mappings import Tables

    rows = [(1, 1, 5, 7, 2.0, 1.5), (1, 1, 5, 7, 2.0, 1.5), (1, 1, 5, 8, 2.0, 1.5), (None, 1, None, 7, 2.0, 1.5), (1, 1, 7, None, 2.0, 1.5), (1, 1, None, 7, 2.0, 1.5)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").withColumn("l_shipdate", F.lit("2024-01-01").cast("date"))
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    once = t.uploads_once()
    assert sorted(map(str, once.collect())) == sorted(map(str, t.upload().distinct().collect())) and once.columns == t.upload().columns


def test_shots_are_kept_with_their_page_and_new_keys_read_nothing():
    # One call a changed page, none for each shot, and none to read what a new album cannot have.
    calls = []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, method):
            def call(*args):
                calls.append((self.name, method))
                return False if method == "exists" else None

            return call

    class Handle(State):
        def getListState(self, name, schema):
            return State(name)

        getValueState = getListState

        def getMapState(self, name, key, value):
            return State(name)

    class Timers:
        def getCurrentWatermarkInMs(self):
            return 10_000

    album = ST.AlbumState(10)
    album.init(Handle("handle"))
    columns = [f.name for f in album.row.fields]
    ops = pd.DataFrame([(i, i, "PUT_SHOT", "p1", f"s{i}", "h", 0, "") for i in range(20)], columns=list(ST.OP_COLUMNS))[columns]
    out = pd.concat(list(album.handleInputRows((1,), iter([ops]), Timers())))
    assert out["event"].tolist() == ["stored"] * 20
    assert sorted(c for c in calls if c[0] != "handle") == [("album", "update"), ("mark", "exists"), ("mark", "update"), ("pages", "updateValue")]
