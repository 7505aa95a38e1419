"""The split path for huge groups gives what a plain window gives."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pagequarry.operators.ordered import OrderedGroups, quantile_by_index


def _rows():
    rnd = random.Random(3)
    rows = [(1 if i % 3 == 0 else rnd.randint(2, 9), rnd.randint(0, 50), i, rnd.randint(-5, 9)) for i in range(900)]
    return rows


def _expected(rows):
    by = {}
    for k, o, u, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(k, []).append((o, u, v))
    out = {}
    for k, items in by.items():
        total, top = 0, None
        for n, (o, u, v) in enumerate(items, 1):
            total += v
            top = v if top is None else max(top, v)
            prev = items[n - 2][1] if n > 1 else None
            nxt = items[n][1] if n < len(items) else None
            out[u] = (n, total, top, prev, nxt)
    return out


def test_hot_groups_match_plain_windows(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k int, o int, u int, v int").repartition(5)
    want = _expected(rows)
    for limit in (50, 10_000):
        g = lambda: OrderedGroups(df, ["k"], ["o", "u"], limit)
        assert g().split == (limit == 50)
        n = {r.u: r.n for r in g().number("n").collect()}
        run = {r.u: (r.s, r.m) for r in g().running(s=("sum", F.col("v")), m=("max", F.col("v"))).collect()}
        before = {r.u: r.p for r in g().shifted(-1, p=F.col("u")).collect()}
        after = {r.u: r.p for r in g().shifted(1, p=F.col("u")).collect()}
        got = {u: (n[u], *run[u], before[u], after[u]) for u in n}
        assert got == want


def test_quantile_by_index_with_a_hot_group(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k int, o int, u int, v int")
    got = {r.k: r.q for r in quantile_by_index(df, ["k"], "o", F.floor((F.col("_n") - 1) / 2), "q", hot_rows=10).collect()}
    by = {}
    for k, o, *_ in rows:
        by.setdefault(k, []).append(o)
    assert got == {k: sorted(v)[(len(v) - 1) // 2] for k, v in by.items()}


def test_null_keys_and_decimals_in_hot_groups(spark):
    rows = [(None if i % 2 else i % 5, None if i % 3 else "x", i, Decimal(i % 17) / 8) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, j string, u int, v decimal(10,3)").repartition(4)
    plain, split = (OrderedGroups(df, ["k", "j"], ["u"], limit) for limit in (10_000, 30))
    assert split.split and not plain.split
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    assert key(plain.number("n")) == key(split.number("n"))
    assert key(plain.running(s=("sum", F.col("v")), m=("min", F.col("v")))) == key(split.running(s=("sum", F.col("v")), m=("min", F.col("v"))))
    assert key(plain.shifted(-1, p=F.col("u"))) == key(split.shifted(-1, p=F.col("u")))
    with pytest.raises(ValueError):
        plain.running(s=("sum", F.col("v").cast("double")))


def test_several_quantiles_in_one_pass(spark):
    from pagequarry.operators.ordered import quantiles_by_index

    rng = random.Random(5)
    rows = [(k, rng.randrange(9)) for k in (1, 2) for _ in range(30 + k)] + [(3, None), (None, 4)]
    df = spark.createDataFrame(rows, "k int, v int")
    middle = {"lo": F.floor((F.col("_n") - 1) / 2), "hi": F.floor(F.col("_n") / 2)}
    want = {}
    for k in (1, 2):
        v = sorted(x for key, x in rows if key == k)
        want[k] = (v[(len(v) - 1) // 2], v[len(v) // 2])
    for some in ({}, {"census": df}, {"census": df, "hot_rows": 10}):
        out = quantiles_by_index(df, ["k"], "v", middle, **some)
        assert {r.k: (r.lo, r.hi) for r in out.filter("k IS NOT NULL").collect()} == want
    plan = quantiles_by_index(df, ["k"], "v", middle, census=df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
