"""Operator 8: substring deduplication over a de Bruijn graph of token k-mers.

A window of 20 words is an edge of the graph. The edges that follow each other in a document and have the same
anchor (the 6-word gram of least hash among the window's 15) form a segment; equal windows have equal anchors, so
they lie in segments of the same anchor. If all segments of an anchor are equal, none of their edges branches: the
path compacts to one row for each place where it stands, and the first place is the least (doc_id, position).
Where segments of an anchor differ, paths branch inside them: only there windows are compared one by one, by two
hashes of 96 bits together. Removed spans are then laid on the words of each document by its coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_text, give_back, lean, slices, written
from .words import mixed, ngrams, run_hashes, word_hashes

WINDOW, ANCHOR = 20, 6
GRAMS = WINDOW - ANCHOR + 1
#: Segments in a bucket of anchors (about one for every 50 bytes of text).
BUCKET_SEGMENTS, LEAST_BUCKETS, SEGMENT_BYTES = 300_000, 96, 50
_FIRST = -(1 << 63)
#: Places from which on a window counts as hot, at least; and how many hot windows there may be.
HOT, MOST_HOT = 1_000, 50_000
#: Of the pressed texts, which are shuffled twice.
LEVEL = 9


def anchors(words: np.ndarray, window: int, anchor: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a document: anchor hash, anchor position, first window and the window after the last.

    Of equal least grams in a window the leftmost is its anchor. Empty if there are fewer words than a window.
    """
    grams = ngrams(words, anchor, seed)
    n, wide = len(words) - window + 1, window - anchor + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    # Least of each run of ``wide`` grams, by doubling: the leftmost of equals wins.
    best, span = np.arange(len(grams)), 1
    while span < wide:
        step = min(span, wide - span)
        left, right = best[:-step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        span += step
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    return grams[best[first]], best[first], first, np.append(first[1:], n)


_FIELDS = (("anchor", "<u4"), ("words", "<u8"), ("at", "<i4"), ("before", "u1"), ("count", "u1"), ("doc", "<i4"))


def _segments(docs: DataFrame, window: int, anchor: int, buckets: int) -> DataFrame:
    """All segments of all documents, packed by bucket of anchors and slice of a task, with the documents' ids and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                order, key = (np.array(part.column(i).to_pylist(), np.int64) for i in (0, 1))
                words, at = word_hashes([x or b"" for x in part.column(2).cast(pa.binary()).to_pylist()])
                found: list[list[np.ndarray]] = [[] for _ in range(7)]
                for d, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    h, p, lo, hi = anchors(words[a:b], window, anchor)
                    if len(h):
                        text = run_hashes(words[a:b], lo, hi + window - 1)
                        for to, x in zip(found, (h, text, p, p - lo, hi - lo, np.full(len(h), d), lo), strict=True):
                            to.append(x)
                if not found[0]:
                    continue
                h, text, p, before, count, doc, _ = (np.concatenate(x) for x in found)
                h = mixed(h)
                of = (h >> np.uint64(32)) % np.uint64(buckets)
                rank = np.argsort(of, kind="stable")
                columns = [x.astype(kind)[rank] for x, (_, kind) in zip((h, text, p, before, count, doc), _FIELDS, strict=True)]
                name, start = np.unique(of[rank], return_index=True)
                data, ids = [], []
                for a, b in zip(start, [*start[1:], len(rank)], strict=True):
                    used, local = np.unique(columns[5][a:b], return_inverse=True)
                    data.append(b"".join([x[a:b].tobytes() for x in columns[:5]] + [local.astype("<i4").tobytes()]))
                    ids.append(order[used].tobytes() + key[used].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int32)), pa.array(data, pa.binary()), pa.array(ids, pa.binary())], names=["bucket", "data", "ids"])

    return docs.mapInArrow(lean(run), "bucket int, data binary, ids binary")


def _compact(window: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Of one bucket: spans that repeat an earlier unbranched path, and the segments in which paths branch.

        Spans have ``at`` null; others name the anchor's position.
        """
        parts: list[list[np.ndarray]] = [[] for _ in range(7)]
        for data, ids in zip(table.column("data").to_pylist(), table.column("ids").to_pylist(), strict=True):
            n, at = len(data) // sum(np.dtype(k).itemsize for _, k in _FIELDS), 0
            for part, (_, kind) in zip(parts, _FIELDS[:5], strict=False):
                part.append(np.frombuffer(data, kind, n, at))
                at += n * np.dtype(kind).itemsize
            doc = np.frombuffer(data, "<i4", n, at)
            both = np.frombuffer(ids, "<i8").reshape(2, -1)
            parts[5].append(both[0][doc])
            parts[6].append(both[1][doc])
        anchor, words, p, before, count, order, doc = (np.concatenate(x) for x in parts)
        rank = np.lexsort((p, order, anchor))
        anchor, words, p, before, count, order, doc = (x[rank] for x in (anchor, words, p, before, count, order, doc))
        start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(start, len(anchor)))
        head = np.repeat(start, size)
        equal = (words == words[head]) & (before == before[head]) & (count == count[head])
        whole = np.repeat(np.logical_and.reduceat(equal, start), size)
        lo = p.astype(np.int64) - before
        later = (order > order[head]) | (p > p[head])
        span, branch = whole & later, ~whole
        pick = np.concatenate([np.flatnonzero(span), np.flatnonzero(branch)])
        is_branch = np.arange(len(pick)) >= span.sum()
        give_back()
        return pa.table({
            "key": doc[pick], "at": pa.array(p[pick].astype(np.int64), mask=~is_branch),
            "from": lo[pick], "to": (lo + count)[pick] + window - 1,
        })

    return run


def _kept(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[int, str]:
    """How many words the spans cover, and the digest of the rest."""
    if not spans:
        return 0, hashlib.sha256(b" ".join(words)).hexdigest()
    cover = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        cover[a] += 1
        cover[b] -= 1
    stays = np.cumsum(cover[:-1]) == 0
    return int(len(words) - stays.sum()), hashlib.sha256(b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s])).hexdigest()


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document, without words that an earlier window covers.

    A word goes if a window of ``window`` words over it has a word sequence that also starts earlier: in a smaller
    doc_id, or earlier in the same document. Windows are judged on the input. ``doc_id`` is an integer; a null one
    counts as the smallest. A null text has no words. Rows that repeat id and text are judged alike, as one place
    each; texts of one id are compared by position only. ``texts`` adds ``kept``, the remaining text. ``anchor`` may
    be any length below ``window``: it changes the work, not the result.
    """
    kind = docs.schema["doc_id"].dataType
    source = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("_order"), F.xxhash64("doc_id", text).alias("_key"), F.col(text).alias("_text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // SEGMENT_BYTES // BUCKET_SEGMENTS + 1)
    packed = _segments(source.select("_order", "_key", "_text"), window, anchor, buckets)
    found = written(packed.groupBy("bucket").applyInArrow(_compact(window), "key long, at long, from long, to long"))

    # Spans of a document are joined before anything else happens to them: a list is bounded by its document.
    touched = found.groupBy("key").agg(F.collect_set("at").alias("branches")).withColumnRenamed("key", "_touched")
    pressed = by_text(source, _press, [T.StructField("z", T.BinaryType())], "_text", ("doc_id", "_order", "_key"))
    laid = pressed.join(touched, F.col("_key") == F.col("_touched"), "left").select("doc_id", "_order", "_key", "z", "branches")
    name = kind.simpleString()
    state = written(laid.mapInArrow(lean(_first_look(texts)), f"doc_id {name}, _order long, _key long, z binary, branches array<bigint>, n_words long, kept_sha256 string, kept string"))

    open_rows = state.where("size(branches) > 0").select("_order", "_key", "z", "branches").dropDuplicates(["_key"])
    edges = written(open_rows.mapInArrow(lean(_branch_windows(window, anchor)), "key long, doc long, at int, h1 long, h2 int"))
    least = written(edges.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    # Windows that stand in very many places are looked up where these lie: no more than MOST_HOT can stand in so many.
    bar = max(HOT, edges.count() // MOST_HOT)
    hot = F.broadcast(least.where(F.col("n") > bar).drop("n"))
    rare = edges.join(hot, ["h1", "h2"], "left_anti").join(least.where(F.col("n") <= bar).drop("n"), ["h1", "h2"])
    later = edges.join(hot, ["h1", "h2"]).unionByName(rare).where(F.struct("doc", "at") > F.col("first"))
    again = later.select("key", F.col("at").cast("long").alias("from"), (F.col("at") + window).cast("long").alias("to"))
    spans = found.where("at is null").select("key", "from", "to").unionAll(again)
    listed = spans.groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("spans")).withColumnRenamed("key", "_spanned")

    done = state.where("branches is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", "kept")
    rest = state.where("branches is not null").select("doc_id", "_key", "z").join(listed, F.col("_key") == F.col("_spanned"), "left").select("doc_id", "z", "spans")
    cut = rest.mapInArrow(lean(_cut(texts)), f"doc_id {name}, n_words long, n_removed long, kept_sha256 string, kept string")
    out = done.unionAll(cut)
    return out if texts else out.drop("kept")


def _press(texts: list[str]) -> dict:
    press = zstandard.ZstdCompressor(level=LEVEL)
    return {"z": [press.compress(t.encode()) for t in texts]}


def _first_look(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finishes documents in which nothing repeats; the others keep their text."""
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            branches = batch.column(4)
            n, sha, kept, z = [], [], [], []
            for data, touched in zip(batch.column(3).to_pylist(), branches.is_valid().to_pylist(), strict=True):
                words = None if touched else press.decompress(data).split()
                n.append(None if touched else len(words))
                sha.append(None if touched else _kept(words, [])[1])
                kept.append(None if touched or not texts else b" ".join(words).decode())
                z.append(data if touched else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.binary()), branches, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "_order", "_key", "z", "branches", "n_words", "kept_sha256", "kept"])

    return run


def _branch_windows(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of segments in which paths branch, with two hashes of their words (96 bits)."""
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for order, key, z, branches in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = [press.decompress(z)]
                words = word_hashes(data)[0]
                _, p, lo, hi = anchors(words, window, anchor)
                chosen = np.isin(p, np.array(branches, np.int64))
                at = np.concatenate([np.arange(a, b) for a, b in zip(lo[chosen], hi[chosen], strict=True)] or [np.zeros(0, np.int64)])
                h1, h2 = ngrams(words, window, 1)[at], ngrams(word_hashes(data, 2)[0], window, 2)[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key, np.int64)), pa.array(np.full(len(at), order, np.int64)), pa.array(at.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["key", "doc", "at", "h1", "h2"])

    return run


def _cut(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for z, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = press.decompress(z).split()
                spans = [(s["from"], s["to"]) for s in spans or []]
                removed, sha = _kept(words, spans)
                kept = None
                if texts:
                    cover = np.zeros(len(words), bool)
                    for a, b in spans:
                        cover[a:b] = True
                    kept = b" ".join([w for w, c in zip(words, cover.tolist(), strict=True) if not c]).decode()
                for to, x in zip(out, (len(words), removed, sha, kept), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def brute_force(texts: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The same by a dictionary of all windows: for tests on few documents."""
    words = [(i, (t or "").encode().split()) for i, t in texts]
    first: dict[tuple, tuple[int, int]] = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in words:
        spans = [(s, s + window) for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < (i, s)]
        out.append((i, len(w), *_kept(w, spans)))
    return out
