"""Operator 13: compact codes for vectors; codebooks by Lloyd's rounds over cover trees (product quantisation).

A vector of whole numbers is cut into parts; each part position has a codebook of a few entries. Inside a task,
a few thousand vectors make a chunk with one cover tree for each part position: a node's children lie farther
apart than what covers it, shrunk level by level, and its points stand side by side, so that its count and sum are
differences of running sums. In a round a node goes wholly to an entry if by the triangle inequality every point of
it is nearer to that entry than to any other; only ambiguous nodes are opened, and the points of ambiguous leaves
are compared exactly. Trees are built once and stored; all rounds read them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import look_up, written
from .integers import LARGEST, Sums, integer_vectors, is_plain, matrix, moved, parsed, read, square, summed

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bytes of vectors in a chunk (about) and most rows; points of a node that isn't split further.
CHUNK_BYTES, CHUNK_ROWS, LEAF = 1 << 20, 2048, 4
#: How far a level's cover shrinks against the one above.
SHRINK = 1.3
#: What double rounding may add to a distance (below 2**33).
SLACK = 1e-3

_NODE = np.dtype([("lo", "<u4"), ("hi", "<u4"), ("centre", "<u4"), ("first", "<u4"), ("last", "<u4"), ("radius", "<f8")])


def _distance(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(-1).astype(float))


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points in which each node's stand side by side, and the nodes; node 0 is the root.

    A node has its points' range, the row of its centre (one of its points), the range of its children and the
    largest distance of a point from the centre. Children's centres are taken farthest first.
    """
    order, nodes, at = np.arange(len(points)), [[0, len(points), 0, 0, 0, 0.0]], 0
    while at < len(nodes):
        lo, hi, centre = nodes[at][:3]
        own = order[lo:hi]
        x = points[own]
        near = _distance(x, points[centre])
        radius = nodes[at][5] = float(near.max())
        if hi - lo > LEAF and radius:
            of, centres = np.zeros(len(own), np.int64), [centre]
            while True:
                far = int(near.argmax())
                if near[far] * SHRINK <= radius:
                    break
                d = _distance(x, x[far])
                closer = d < near
                near[closer], of[closer] = d[closer], len(centres)
                centres.append(int(own[far]))
            order[lo:hi] = own[np.argsort(of, kind="stable")]
            ends = lo + np.cumsum(np.bincount(of, minlength=len(centres)))
            nodes[at][3:5] = len(nodes), len(nodes) + len(centres)
            for start, end, c in zip([lo, *ends[:-1].tolist()], ends.tolist(), centres, strict=True):
                nodes.append([start, end, c, 0, 0, 0.0])
        at += 1
    return order, np.array([tuple(n) for n in nodes], _NODE)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    size = hi.astype(np.int64) - lo
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo.astype(np.int64), size)


def assign(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Counts and sums by entry, the nearest entry of each point (least number of equals), and how many points were compared one by one."""
    k, placed = len(entries), points[order]
    running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(placed, 0)])
    counts, sums, code, looked = np.zeros(k, np.int64), np.zeros((k, points.shape[1]), np.int64), np.zeros(len(points), np.int64), 0
    at, may = np.zeros(1, np.int64), np.ones((1, k), bool)
    while len(at):
        node = nodes[at]
        d = _distance(points[node["centre"]][:, None, :], entries[None])
        d[~may] = np.inf
        best, near = d.argmin(1), d.min(1)
        may = d - node["radius"][:, None] <= (near + node["radius"])[:, None] + SLACK
        sole = may.sum(1) == 1
        whole, entry = node[sole], best[sole]
        np.add.at(counts, entry, whole["hi"].astype(np.int64) - whole["lo"])
        np.add.at(sums, entry, running[whole["hi"]] - running[whole["lo"]])
        code[_ranges(whole["lo"], whole["hi"])] = np.repeat(entry, whole["hi"].astype(np.int64) - whole["lo"])
        leaf = ~sole & (node["last"] == 0)
        if leaf.any():
            few, size = node[leaf], (node["hi"].astype(np.int64) - node["lo"])[leaf]
            rows = _ranges(few["lo"], few["hi"])
            i, j = np.nonzero(np.repeat(may[leaf], size, 0))
            exact = np.full((len(rows), k), LARGEST)
            exact[i, j] = ((placed[rows[i]] - entries[j]) ** 2).sum(-1)
            found = exact.argmin(1)
            code[rows] = found
            counts += np.bincount(found, minlength=k)
            np.add.at(sums, found, placed[rows])
            looked += len(rows)
        split = ~sole & (node["last"] > 0)
        n = node[split]
        at, may = _ranges(n["first"], n["last"]), np.repeat(may[split], n["last"].astype(np.int64) - n["first"], 0)
    back = np.empty(len(points), np.int64)
    back[order] = code
    return counts, sums, back, looked


def _kept(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, plain, text = integer_vectors(batch.column(1), scale)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(plain, pa.binary()), pa.array(text, pa.string())], names=["vec_id", "label", "v", "big"])

    return run


def _chunked(dimension: int, parts: int):
    """Chunks of a task's rows with their trees; rows that have none (other lengths, very large components) stand in a chunk each."""
    width = dimension // parts
    names = ["vec_id", "label", "v", "big", "tree"]

    def chunk(ids: list, labels: list, cells: list) -> list:
        x, trees = matrix(cells), []
        for p in range(parts if width else 0):
            order, nodes = cover_tree(x[:, p * width : (p + 1) * width])
            trees += [len(nodes).to_bytes(4, "little"), order.astype("<u4").tobytes(), nodes.tobytes()]
        return [ids, labels, b"".join(cells), None, b"".join(trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = min(CHUNK_ROWS, max(1, CHUNK_BYTES // (4 * max(1, dimension))))
        ids: list = []
        labels: list = []
        cells: list = []
        kind: list = []

        def made(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.list_(pa.int64()), pa.list_(kind[0]), pa.binary(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            kind = [batch.schema.field(1).type]
            for i, label, v, big in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if v is None or len(v) != 4 * dimension:
                    yield made([[[i], [label], v, big, None]])
                    continue
                ids.append(i)
                labels.append(label)
                cells.append(v)
                if len(cells) >= most:
                    yield made([chunk(ids, labels, cells)])
                    ids, labels, cells = [], [], []
        if cells:
            yield made([chunk(ids, labels, cells)])

    return run


def _trees(data: bytes, n: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = 0
    for _ in range(parts):
        count = int.from_bytes(data[at : at + 4], "little")
        order = np.frombuffer(data, "<u4", n, at + 4).astype(np.int64)
        nodes = np.frombuffer(data, _NODE, count, at + 4 + 4 * n)
        yield order, nodes
        at += 4 + 4 * n + count * _NODE.itemsize


def _nearest(part: list[int], entries: list[list[int]]) -> tuple[int, int]:
    d, j = min((square(part, e), j) for j, e in enumerate(entries))
    return j, d


def _slow(vector: list[int], books: list[list[list[int]]], width: int) -> list[tuple[int, int]]:
    return [_nearest(vector[p * width : (p + 1) * width], book) for p, book in enumerate(books)]


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error) of every kept vector, and the final codebooks (part, entry, component).

    Rows whose vector is null or holds null or non-finite components are dropped; a component x becomes
    floor(scale * x). Codebooks start as the parts of the vectors of the smallest ids (of rows that repeat an id the
    one of least components first, a null id last); with fewer vectors there are as many entries as rows. The length
    is that of the first of them: vectors of another length, and all if it can't be cut into equal parts, have a
    null code and error. An empty vector has empty parts: entry 0, error 0. Components may be of any size: beyond 2**24
    they are compared one by one in exact integers, and an error beyond a long is the largest long. Repeated rows
    are vectors of their own, a null label is a label. Only ``vec_id``, ``embedding`` and ``label`` are read.
    """
    label = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    kept = rows.mapInArrow(_kept(scale), f"vec_id long, label {label}, v binary, big string")
    starts = [read(r.v, r.big) for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v", "big").limit(entries).collect()]
    dimension = len(starts[0]) if starts else 0
    width = dimension // parts
    fits = bool(starts) and dimension % parts == 0
    starts = [s for s in starts if len(s) == dimension]
    books = [[s[p * width : (p + 1) * width] for s in starts] for p in range(parts)]
    table = written(kept.mapInArrow(_chunked(dimension if fits else -1, parts), f"vec_id array<long>, label array<{label}>, v binary, big string, tree binary"))

    def coded(v: bytes | None, big: str | None, tree: bytes | None, n: int, now: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Part by part: counts and sums by entry, codes and errors of a chunk."""
        plain = [all(is_plain(e) for e in book) for book in now]
        if tree is None or not all(plain):
            vectors_ = [parsed(big)] if v is None else matrix([v]).reshape(n, dimension).tolist()
            found = [_slow(x, now, width) for x in vectors_]
            for p in range(parts):
                counts, sums = np.zeros(len(starts), object), np.zeros((len(starts), width), object)
                for x, f in zip(vectors_, found, strict=True):
                    counts[f[p][0]] += 1
                    sums[f[p][0]] += np.array(x[p * width : (p + 1) * width], object)
                yield p, counts, sums, np.array([f[p][0] for f in found]), np.array([f[p][1] for f in found], object)
            return
        x = matrix([v]).reshape(n, dimension)
        for p, (order, nodes) in enumerate(_trees(tree, n, parts) if width else [(None, None)] * parts):
            if not width:
                yield p, np.array([n] + [0] * (len(starts) - 1)), np.zeros((len(starts), 0), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                continue
            piece, book = x[:, p * width : (p + 1) * width], np.array(now[p], np.int64)
            counts, sums, code, _ = assign(piece, order, nodes, book)
            yield p, counts, sums, code, ((piece - book[code]) ** 2).sum(1)

    def is_coded(v: bytes | None, big: str | None, n: int) -> bool:
        return fits and (big.count(",") + 1 == dimension if v is None else len(v) == 4 * dimension * n)

    for _ in range(rounds if fits else 0):

        def add(batch: pa.RecordBatch, sums: Sums, now: list = books) -> None:
            for ids, v, big, tree in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                if is_coded(v, big, len(ids)):
                    for p, counts, total, _, _ in coded(v, big, tree, len(ids), now):
                        for j in np.flatnonzero(counts).tolist():
                            sums.add(p * entries + j, counts[j], total[j])

        sums = summed(table.select("vec_id", "label", "v", "big", "tree"), add)
        books = [moved(book, sums, p * entries) for p, book in enumerate(books)]
    last = books

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(1).type.value_type
            for r in range(len(batch)):
                ids, labels, v, big, tree = (batch.column(c)[r].as_py() for c in range(5))
                code, error = [None] * len(ids), [None] * len(ids)
                if is_coded(v, big, len(ids)):
                    found = list(coded(v, big, tree, len(ids), last))
                    codes = np.stack([f[3] for f in found], 1).astype(np.uint8)
                    code = [c.tobytes().hex() for c in codes]
                    error = [min(int(e), LARGEST) for e in sum(f[4] for f in found)]
                columns = (pa.array(ids, pa.int64()), pa.array(labels, kind), pa.array(code, pa.string()), pa.array(error, pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns), names=["vec_id", "label", "code", "error"])

    return table.mapInArrow(final, f"vec_id long, label {label}, code string, error long"), books


def with_label_error(found: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """``found`` with its errors summed over equal labels (nulls are equal; null where no row of a label has a code) and the digest of all codebooks.

    A label may hold any share of the rows: its sum is made before the shuffle and looked up by broadcast, or salted.
    A sum beyond a long is given as the largest long.
    """
    found = written(found)
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.when(exact <= LARGEST, exact.cast("long")).when(exact.isNotNull(), LARGEST)
    sums = written(found.groupBy("label").agg(total.alias("label_error")))
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    joined = look_up(found, sums, "label", F.xxhash64("vec_id", "code"))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def codes_sql(dimension: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows in DuckDB SQL, by comparing every part with every entry; all vectors have ``dimension`` components."""
    width = dimension // parts
    near = "SELECT k.vec_id, k.p, k.v, min((list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) ** 2))::BIGINT, c.j)) AS m FROM cut k JOIN {c} c USING (p) GROUP BY k.vec_id, k.p, k.v"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor({scale} * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"cut AS MATERIALIZED (SELECT vec_id, p, v[p * {width} + 1 : (p + 1) * {width}] AS v FROM kept, range({parts}) t(p))",
        f"ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM kept QUALIFY j < {entries})",
        "c0 AS MATERIALIZED (SELECT p, j, v FROM cut JOIN ids USING (vec_id))",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})",
            f"s{r} AS (SELECT p, m[2] AS j, q, sum(v[q])::HUGEINT AS s, count(*) AS n FROM a{r}, range(1, {width} + 1) t(q) GROUP BY p, m[2], q)",
            f"m{r} AS (SELECT p, j, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY q) AS v FROM s{r} GROUP BY p, j)",
            f"c{r + 1} AS MATERIALIZED (SELECT p, c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (p, j))",
        ]
    steps += [
        f"last AS MATERIALIZED ({near.format(c=f'c{rounds}')})",
        "coded AS (SELECT vec_id, string_agg(printf('%02x', m[2]::INTEGER), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM last GROUP BY vec_id)",
        f"book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) AS h FROM c{rounds})",
    ]
    return f"""WITH {", ".join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (vec_id), book"""
