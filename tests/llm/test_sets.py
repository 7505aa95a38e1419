"""Operators over whole tables against brute force: joins, deduplication, shards, mixes, vectors, components."""

import math
import random
import time
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from pagequarry.llm import debruijn, embeddings, linking, mixing, ngram_join, sharding

from .helpers import awkward_texts, prose, table


def varied(seed, n=60):
    """Texts with edited copies, shared passages and repeats within a text."""
    r, out = random.Random(seed), []
    passage = prose(99, 40)
    for i in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out)[1].split(" ")
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(["new", "words", "here"])
            t = " ".join(w)
        else:
            t = prose(seed * 1000 + i, r.choice([3, 5, 7, 9, 12, 30, 150]))
        if r.random() < 0.2:
            t += " " + passage + (" " + passage if r.random() < 0.4 else "")
        out.append((i, t))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join_is_exact(spark, seed):
    data = varied(seed, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(table(spark, data).repartition(4)).collect()}
    assert got == ngram_join.brute_force(dict(data))


def test_ngram_join_small_sets_and_chains(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    data = [(i, " ".join(words[j : j + n])) for i, (j, n) in enumerate((j, n) for j in range(0, 12) for n in (5, 8, 9, 12, 13, 20))]
    want = ngram_join.brute_force(dict(data))
    for cost in (0, 4, 10**6):  # no small sets; by cost; as many as there may be
        monkeypatch.setattr(ngram_join, "LIST_COST", cost)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(table(spark, data)).collect()}
        assert got == want


def test_ngram_join_with_many_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    data = varied(8, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(table(spark, data)).collect()}
    assert got == ngram_join.brute_force(dict(data))


def test_ngram_join_awkward_rows(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(table(spark, awkward_texts())).collect()]
    by = {i: (n, c) for i, n, c in got}
    assert len(got) == len(awkward_texts())
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4) and by[6] == (1, 5)
    assert by[8][1] == 7 and by[9][1] == 7 and by[13][1] == by[16][1] == 13 and by[14] == (2, 14)
    assert ngram_join.classes(table(spark, [(1, "x")]).where("doc_id > 1")).count() == 0


@pytest.mark.parametrize("seed,window,anchor", [(4, 20, 6), (5, 8, 3), (6, 20, 19), (7, 5, 1)])
def test_substring_dedup_is_exact(spark, seed, window, anchor):
    data = varied(seed, 80)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.deduplicated(table(spark, data).repartition(4), window, anchor).collect()]
    assert sorted(got) == debruijn.brute_force(data, window)


def test_substring_dedup_awkward_rows(spark):
    data = [(i, t) for i, t in awkward_texts() if i is not None]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.deduplicated(table(spark, data)).collect()]
    assert sorted(got) == sorted(debruijn.brute_force(data))
    everything = debruijn.deduplicated(table(spark, awkward_texts()), texts=True).collect()
    assert len(everything) == len(awkward_texts())
    assert next(r.n_removed for r in everything if r.doc_id == 7) == 120  # a null id comes first
    assert debruijn.deduplicated(table(spark, data).where("doc_id < 0")).count() == 0


def test_repeats_within_a_word_pattern(spark):
    data = [(1, "a " * 50), (2, "a b " * 30), (3, "b a " * 30), (4, "x " * 19), (5, "x " * 20), (6, "x " * 20)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.deduplicated(table(spark, data)).collect()]
    assert sorted(got) == debruijn.brute_force(data)


def test_shards(spark):
    data = awkward_texts() + [(100 + i, prose(i // 7, 20)) for i in range(400)] + [(1000 + i, "hot group") for i in range(300)]
    got = sharding.shard(table(spark, data), shards=7).collect()
    assert len(got) == len(data)
    counts = [sum(r.shard == s for r in got) for s in range(7)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(data)
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    text = {i: t for i, t in data if i is not None}
    for r in got:
        if r.doc_id is not None:
            t = text[r.doc_id]
            assert r.size == len((t or "").encode()) + 16 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        assert r.law == "rows" and r.grown_shard is None
    groups = {}
    for r in got:
        if r.doc_id is not None and 100 <= r.doc_id < 1000:
            groups.setdefault(text[r.doc_id], set()).add(r.shard)
    assert sum(len(s) == 1 for s in groups.values()) > 0.9 * len(groups)
    assert len({r.shard for r in got if r.doc_id is not None and r.doc_id >= 1000}) <= 5
    assert sharding.shard(table(spark, data).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("copies", [(2,), (2, 3, 5)])
def test_shards_keep_copies_together_without_unlinked_rows(spark, copies):
    data, group = [], 0
    while len(data) < 3000:
        data += [(len(data) + k, f"group {group}") for k in range(copies[group % len(copies)])]
        group += 1
    got = sharding.shard(table(spark, data), shards=10).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(data) and max(counts.values()) - min(counts.values()) <= 1
    text, places = dict(data), {}
    for r in got:
        places.setdefault(text[r.doc_id], set()).add(r.shard)
    assert sum(len(p) > 1 for p in places.values()) <= 9


def test_granted_moves_fill_no_shard_beyond_its_room():
    r = random.Random(8)
    for _ in range(200):
        asked = {(s, t, n): r.randint(1, 9) for s in range(6) for t in range(6) for n in (1, 2, 5) if s != t and r.random() < 0.5}
        free = [r.choice([0, 0, 3]) for _ in range(6)]
        yes = sharding.granted(asked, free)
        assert all(0 < k <= asked[a] for a, k in yes.items())
        assert all(sum(k * n * ((t == x) - (s == x)) for (s, t, n), k in yes.items()) <= free[x] for x in range(6))
    assert sharding.granted({(0, 1, 2): 5, (1, 2, 2): 4, (2, 0, 2): 7, (0, 2, 1): 3}, [0, 0, 0]) == {(0, 1, 2): 4, (1, 2, 2): 4, (2, 0, 2): 4}


def run_sql(sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    return con.execute(sql).df()


def test_mix_is_its_sql(spark):
    r = random.Random(2)
    data = [(i, prose(i, r.randint(1, 90))) for i in range(300)] + awkward_texts()
    docs = table(spark, data)
    got = mixing.mix(docs).toPandas()
    want = run_sql(mixing.mix_sql(), documents=docs.toPandas())
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    by = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    big = by[(by.index > 1000) & (by.index < 30_000)]  # a text of 30,000 words fills most of the third source
    assert ((big.taken - big.target).abs() / big.target < 0.02).all() and (got.taken <= 2 * got["size"]).all()
    mixed = mixing.mixed(docs)
    assert mixed.schema == docs.schema
    assert mixed.count() == sum(t // s for t, s in zip(got.taken, got["size"], strict=True) if s)
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0


def test_targets_are_refilled_until_none_is_above(spark):
    totals = {"a": 10, "b": 5000, "c": 3000, None: 40, "d": 700}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(totals.items()), "source string, total long")).collect()}
    order = ["a", "b", "c", "d", None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, left, open_ = {}, 1.5 * sum(totals.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * totals[s]}
        if not over:
            want |= share
            break
        want |= {s: 2.0 * totals[s] for s in over}
        left -= sum(2.0 * totals[s] for s in over)
        open_ -= over
    assert all(math.isclose(got[s], want[s]) for s in order)


def vectors(seed, n=240, d=16):
    r, out = random.Random(seed), []
    for i in range(n):
        if out and r.random() < 0.6:
            x = [v + r.gauss(0, 0.12) for v in r.choice(out)[1]]
            if r.random() < 0.3:
                x = list(r.choice(out)[1])
        else:
            x = [r.gauss(0, 1) for _ in range(d)]
        out.append((i, x, r.choice([0, 0, 1, None])))
    return out


@pytest.mark.parametrize("tile", [1024, 16])
def test_vectors_link_as_in_sql(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0, None], 0), (1004, [1e300] * 16, 0), (1005, [1.0] * 16, 0), (1006, [1.0] * 3, 0), (1007, [2.0] * 3, 0), (1008, [], 0)]
    data = vectors(4) + odd
    df = spark.createDataFrame([(*x, "v", 1) for x in data], "vec_id long, embedding array<double>, label int, v string, key int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    want = run_sql(embeddings.cosine_sql(), embeddings=df.drop("v", "key").where("vec_id <> 1004").toPandas())
    want = {int(r.vec_id): (r.n_links, r.component_id, r.kept) for r in want.itertuples()}
    assert sum(n > 0 for n, *_ in want.values()) > 50
    differ = {i for i in want if got[i] != want[i]}
    assert differ == {1005} and got[1004] == (1, 1004, True) and got[1005][1] == 1004
    assert embeddings.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_vectors_without_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(embeddings.near_duplicates(df).collect(), key=str)
    assert [(r.vec_id, r.n_links, r.component_id) for r in got] == [(3, 1, 3), (3, 1, 3), (None, 0, None)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in linking.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: y for x, y in root.items() if x in got} and all(root[x] == x for x in root if x not in got)


def test_sketches_never_overstate_differences():
    import numpy as np

    r = np.random.default_rng(5)
    for _ in range(200):
        pool = r.integers(0, 1 << 62, 600).astype(np.uint64)
        a = np.unique(pool[: r.integers(1, 500)])
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.8], pool[500 : 500 + r.integers(0, 100)]]))
        assert ngram_join.least_difference(ngram_join.sketch(a), ngram_join.sketch(b)) <= len(np.setxor1d(a, b))


def test_vectors_of_every_size_link_by_direction(spark):
    r = random.Random(3)
    way = [r.gauss(0, 1) for _ in range(6)]
    other = [r.gauss(0, 1) for _ in range(6)]
    sizes = [1.0, 3.0, 1e-300, 1e-200, 1e150, 1e300, 1e-320, 7e307]
    data = [(k, [c * s for c in way], 1) for k, s in enumerate(sizes)] + [(100 + k, [c * s for c in other], 1) for k, s in enumerate(sizes)]
    mixed_sizes = [(200, [1e300, 1.0, 0.0, 0.0, 0.0, 0.0], 1), (201, [1e-300, 1e-305, 0.0, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(data + mixed_sizes, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == {k: (7, 0) for k in range(8)} | {100 + k: (7, 100) for k in range(8)} | {200: (1, 200), 201: (1, 200)}
    want = run_sql(embeddings.cosine_sql(), embeddings=df.toPandas())
    assert got == {int(r.vec_id): (r.n_links, r.component_id) for r in want.itertuples()}


def near_group(seed: int, members: int, words: int = 120):
    """Edits of one text, of which many pairs lie near the threshold."""
    r, base = random.Random(seed), prose(seed, words).split()
    out = []
    for i in range(members):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            w[r.randrange(words)] = f"edit{r.randrange(40)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [16_384, 60])
def test_ngram_join_in_a_large_group_near_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    data = near_group(5, 500) + [(1000 + i, t) for i, t in varied(6, 40)]
    seen = []
    links = ngram_join._crossing_links
    monkeypatch.setattr(ngram_join, "_crossing_links", lambda members, texts: seen.append(links(members, texts)) or seen[-1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(table(spark, data).repartition(4)).collect()}
    want = ngram_join.brute_force(dict(data))
    assert got == want
    assert seen[0].count() <= 4 * len(data)  # joining links only, no candidate pairs


def test_ngram_join_without_ids_keeps_texts_apart(spark):
    data = [(None, t) for _, t in near_group(7, 150) + varied(9, 60)]
    start = time.time()
    got = ngram_join.classes(table(spark, data).select("doc_id", "text")).collect()
    assert len(got) == len(data) and time.time() - start < 60
    assert all(r.component_id is None for r in got)
    sizes = sorted(n for n, _ in ngram_join.brute_force({i: t for i, (_, t) in enumerate(data)}).values())
    assert sorted(r.n_shingles for r in got) == sizes


def test_substring_dedup_with_hot_windows(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "HOT", 5)
    data = varied(12, 80) + [(500 + i, f"w{i} x{i} " + prose(99, 40) + f" y{i}") for i in range(30)]
    got = sorted(tuple(r) for r in debruijn.deduplicated(table(spark, data).repartition(4)).collect())
    assert got == sorted(debruijn.brute_force(data))
