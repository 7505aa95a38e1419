"""Clusters and codes of vectors against plain Python: every awkward vector, every size of number."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from pagequarry.llm import integers, pivots, vector_codes

KIND = "vec_id long, embedding array<double>, label int, v binary, big string, t double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, label, b"x", "y", 0.5) for i, x, label in rows], KIND)


def plain_rows(seed, n, d, labels=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(d)] for _ in range(labels)]
    return [(i, [c + r.gauss(0, 0.1) for c in centres[i % labels]], i % labels) for i in range(n)]


def odd_rows(first, d):
    """Nulls, other lengths, ties and repeated rows, and numbers of every size."""
    cells = [None, [], [0.5] * (d - 1), [0.25] * d, [0.25] * d, [1.0, None] + [0.0] * (d - 2), [math.nan] * d, [math.inf] * d, [1e300] * d, [-1e300] + [0.1] * (d - 1), [3e5] * d, [1e19] * d, [5e-324] * d, [-5e-324] * d]
    return [(first + i, x, None if i % 2 else 1) for i, x in enumerate(cells)] + [(first + 3, [0.25] * d, 1), (None, [0.3] * d, 2), (first + 99, [-0.0] * d, None)]


def whole(x, scale):
    return math.floor(Fraction(x) * scale)


def usable(x):
    return x is not None and all(c is not None and math.isfinite(c) for c in x)


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(v, entries):
    return min((far(v, e), j) for j, e in enumerate(entries))


def lloyd(points, entries, rounds):
    for _ in range(rounds):
        groups = {}
        for p in points:
            groups.setdefault(nearest(p, entries)[1], []).append(p)
        entries = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else e for j, e in enumerate(entries)]
    return entries


def clusters_by_hand(rows, k, rounds, scale, d):
    kept = [(i, [whole(c, scale) for c in x]) for i, x, _ in rows if usable(x) and len(x) == d]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    centres = lloyd([v for _, v in kept], [v for _, v in order[:k]], rounds)
    most = integers.LARGEST
    found = [(i, j, min(e, most)) for i, v in kept for e, j in [nearest(v, centres)]]
    of = {j: min(sum(e for _, c, e in found if c == j), most) for _, j, _ in found}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, e, of[j], min(sum(e for _, _, e in found), most), digest[j]) for i, j, e in found), key=str)


def codes_by_hand(rows, k, rounds, scale, parts):
    kept = [(i, [whole(c, scale) for c in x], label) for i, x, label in rows if usable(x)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:k]
    d = len(order[0][1]) if order else 0
    w, fits = d // parts, d % parts == 0
    own = [r for r in kept if fits and len(r[1]) == d]
    books = [lloyd([v[p * w : p * w + w] for _, v, _ in own], [v[p * w : p * w + w] for _, v, _ in order if len(v) == d], rounds) for p in range(parts)]
    out, most = [], integers.LARGEST
    for i, v, label in kept:
        found = [nearest(v[p * w : p * w + w], books[p]) for p in range(parts)] if fits and len(v) == d else None
        out.append((i, label, found and bytes(j for _, j in found).hex(), found and min(sum(e for e, _ in found), most)))
    total = {label: [e for _, x, _, e in out if x == label and e is not None] for _, label, _, _ in out}
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, min(sum(total[label]), most) if total[label] else None, digest) for i, label, c, e in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", [plain_rows(1, 300, 8), plain_rows(2, 60, 8) + odd_rows(1000, 8), odd_rows(0, 8), plain_rows(3, 5, 8), []])
def test_clusters_equal_plain_python(spark, rows):
    found = pivots.clusters(vectors(spark, rows).repartition(3), centroids=7, rounds=3, scale=64, dimension=8)
    df = pivots.with_inertia(*found)
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got(df) == clusters_by_hand(rows, 7, 3, 64, 8)


@pytest.mark.parametrize("rows", [plain_rows(4, 300, 8), plain_rows(5, 60, 8) + odd_rows(1000, 8), odd_rows(1, 8), odd_rows(0, 8)[3:], plain_rows(6, 3, 8), plain_rows(7, 9, 6), []])
def test_codes_equal_plain_python(spark, monkeypatch, rows):
    monkeypatch.setattr(vector_codes, "CHUNK_ROWS", 40)
    df = vector_codes.with_label_error(*vector_codes.encode(vectors(spark, rows).repartition(3), parts=4, entries=5, rounds=3, scale=4096))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got(df) == codes_by_hand(rows, 5, 3, 4096, 4)


def test_sql_gives_the_same_rows(spark):
    rows = plain_rows(8, 200, 64)
    df = vectors(spark, rows).select("vec_id", "embedding", "label")
    con = duckdb.connect()
    con.register("embeddings", df.toPandas())
    for mine, sql in ((pivots.with_inertia(*pivots.clusters(df)), pivots.clusters_sql()), (vector_codes.with_label_error(*vector_codes.encode(df)), vector_codes.codes_sql())):
        want = con.execute(sql).df()
        assert got(mine) == sorted((tuple(r) for r in want[mine.columns].itertuples(index=False)), key=str)


def test_bounds_spare_distances_and_keep_ties():
    x = np.array([[int(c * 64) for c in v] for _, v, _ in plain_rows(9, 400, 16, 20)])
    x = np.concatenate([x, x[:50]])
    chosen = pivots.far_apart(x, 8)
    centroids = pivots.Centroids([*x[:20].tolist(), x[0].tolist()], chosen)  # the last equals the first
    found, best, looked = centroids.nearest(x, pivots.to_pivots(x, chosen))
    d = ((x[:, None] - np.array(centroids.all)) ** 2).sum(-1)
    assert (found == d.argmin(1)).all() and (best == d.min(1)).all() and looked < d.size / 2


@pytest.mark.parametrize("d", [1, 2, 8])
def test_cover_tree_covers_and_assigns_exactly(d):
    r = np.random.default_rng(d)
    x = np.concatenate([r.integers(-4096, 4096, (700, d)), r.integers(-20, 20, (300, d)), np.zeros((50, d), np.int64)])
    order, nodes = vector_codes.cover_tree(x)
    assert sorted(order.tolist()) == list(range(len(x)))
    for n in nodes:
        own = x[order[n["lo"] : n["hi"]]]
        assert vector_codes._distance(own, x[n["centre"]]).max() == n["radius"]
        children = nodes[n["first"] : n["last"]]
        if len(children):
            assert children["lo"].tolist() == [n["lo"], *children["hi"][:-1].tolist()] and children["hi"][-1] == n["hi"]
            assert (children["radius"] * vector_codes.SHRINK <= n["radius"]).all()
            apart = vector_codes._distance(x[children["centre"]][:, None], x[children["centre"]][None]) + np.eye(len(children)) * 1e9
            assert (apart * vector_codes.SHRINK > n["radius"]).all()
    entries = np.concatenate([x[:15], x[:1]])
    counts, sums, code, looked = vector_codes.assign(x, order, nodes, entries)
    want = ((x[:, None] - entries) ** 2).sum(-1).argmin(1)
    assert (code == want).all() and looked < len(x)
    assert (counts == np.bincount(want, minlength=16)).all()
    assert all((sums[j] == x[want == j].sum(0)).all() for j in range(16))


def test_sums_have_no_limit():
    sums = integers.Sums()
    sums.add(3, 2, [10**40, -(10**30), 5])
    sums.add(3, 1, [1, -1, -5])
    total: dict = {}
    for number, at, limb, value in zip(*(c.to_pylist() for c in sums.batch().columns)):
        total[number, at] = total.get((number, at), 0) + (value << 40 * limb)
    assert total == {(3, 0): 3, (3, 1): 10**40 + 1, (3, 2): -(10**30) - 1}
