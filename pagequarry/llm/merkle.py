"""Operator 7: document fingerprints as Merkle trees over sections, paragraphs and clauses.

A paragraph is a line; a section ends at an empty line or after a paragraph whose digest says so, so an edit
moves no border far from it. Digests of paragraphs hash to sections and these to the root. Below a paragraph
lie short leaves (words at the head of a text, clauses later), kept as a 17-bit hash and a length for likeness only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PIECE, by_text, lean, slices, written

#: Code points at the head of a text whose leaves are single words.
HEAD = 200
#: One paragraph in so many ends a section.
SECTION = 8
_WORD = re.compile(r"\S+\s*|\s+")
_CLAUSE = re.compile(r"[^.,;:!?|]{1,96}[.,;:!?|]*\s*|[.,;:!?|]+\s*")


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def _leaf(x: str) -> bytes:
    return ((zlib.crc32(x.encode()) & 0x1FFFF) << 7 | min(len(x), 127)).to_bytes(3, "big")


def paragraphs(text: str, known: dict | None = None) -> list[tuple[bytes, bytes]]:
    """(digest, leaves) of each line of a text; leaves are 3 bytes each. ``known`` remembers lines beyond the head."""
    out, at = [], 0
    known = {} if known is None else known
    for line in text.split("\n") if text else []:
        made = known.get(line) if at >= HEAD else None
        if made is None:
            leaves = (_CLAUSE if at >= HEAD else _WORD).findall(line) or [""]
            if at < HEAD < at + len(line):
                leaves = _WORD.findall(line[: HEAD - at]) + _CLAUSE.findall(line[HEAD - at :])
            made = (_digest(line.encode()), b"".join([_leaf(x) for x in leaves]))
            if at >= HEAD:
                known[line] = made
        out.append(made)
        at += len(line) + 1
    return out


_EMPTY = _digest(b"")


def sections(lines: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """(first paragraph, end, digest) of each section."""
    start = 0
    for i, (digest, _) in enumerate(lines):
        if digest[0] % SECTION == 0 or digest == _EMPTY or i == len(lines) - 1:
            yield start, i + 1, _digest(b"".join([d for d, _ in lines[start : i + 1]]))
            start = i + 1


def fingerprint(text: str, known: dict | None = None) -> str:
    """``root|section:leaves.leaves|section:...`` : the root in 32 hex digits, each section's digest in 8, a paragraph's leaves in base64."""
    lines = paragraphs(text, known)
    parts = list(sections(lines))
    root = _digest(b"".join([d for _, _, d in parts]))
    shown = ["%s:%s" % (d[:4].hex(), ".".join([base64.urlsafe_b64encode(x).decode() for _, x in lines[a:b]])) for a, b, d in parts]
    return "|".join([root.hex(), *shown])


def likeness(a: str, b: str) -> float:
    """Share (0 to 1) of the longer tree's leaves, by length, that both trees have.

    Equal roots give 1 at once; sections that both have are taken whole, and only the rest is compared leaf by leaf.
    """
    root_a, *parts_a = a.split("|")
    root_b, *parts_b = b.split("|")
    if root_a == root_b:
        return 1.0
    all_a, all_b = Counter(parts_a), Counter(parts_b)
    same = all_a & all_b
    both, rest_a, rest_b = _leaves(same), _leaves(all_a - same), _leaves(all_b - same)
    shared = _length(both)
    most = shared + max(_length(rest_a), _length(rest_b))
    return (shared + _length(rest_a & rest_b)) / most if most else 0.0


def _leaves(parts: Counter) -> Counter:
    out: Counter = Counter()
    for p in parts.elements():
        body = base64.urlsafe_b64decode(p[9:].replace(".", ""))
        out.update([body[i : i + 3] for i in range(0, len(body), 3)])
    return out


def _length(leaves: Counter) -> int:
    return sum([(x[2] & 127) * n for x, n in leaves.items()])


def differing(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Where two texts differ: (start, end) in code points of the first, then of the second, by whole paragraphs.

    Walks both trees from the root: sections with equal digests are passed over, others are compared by paragraph.
    """
    from difflib import SequenceMatcher

    lines = [paragraphs(a), paragraphs(b)]
    parts = [list(sections(x)) for x in lines]
    starts = []
    for text in (a, b):
        at = [0]
        for line in text.split("\n") if text else []:
            at.append(at[-1] + len(line) + 1)
        at[-1] = max(0, at[-1] - 1)
        starts.append(at)
    out = []
    for op, a0, a1, b0, b1 in SequenceMatcher(None, [d for *_, d in parts[0]], [d for *_, d in parts[1]], autojunk=False).get_opcodes():
        if op == "equal":
            continue
        low = [p[i][0] if i < len(p) else len(x) for p, x, i in zip(parts, lines, (a0, b0), strict=True)]
        high = [p[j - 1][1] if j > i else lo for p, i, j, lo in zip(parts, (a0, b0), (a1, b1), low, strict=True)]
        inner = [[d for d, _ in x[lo:hi]] for x, lo, hi in zip(lines, low, high, strict=True)]
        for kind, c0, c1, d0, d1 in SequenceMatcher(None, *inner, autojunk=False).get_opcodes():
            if kind != "equal":
                out.append((starts[0][low[0] + c0], starts[0][low[0] + c1], starts[1][low[1] + d0], starts[1][low[1] + d1]))
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``root`` and ``fingerprint`` of every whole text; a null text counts as empty. Equal texts have equal ones."""

    def work(texts: list[str]) -> dict:
        made = [fingerprint(t) for t in texts]
        return {"root": [m[:32] for m in made], "fingerprint": made}

    return by_text(docs, work, [T.StructField("root", T.StringType()), T.StructField("fingerprint", T.StringType())], text, keep)


def _row(text: str, known: dict, own: str, after: str, after_print: str) -> tuple:
    n, k = len(text), len(text) // 4
    edited = text[: n - k] + after[:k]
    made = fingerprint(edited, known)
    return n, hashlib.sha256(edited.encode()).hexdigest(), own, made, likeness(own, made), likeness(own, after_print)


_RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every document's fingerprint, compared with that of an edited text and with the next document's.

    In the edited text, the last quarter of the code points (rounded down) is replaced by the head of the next
    document by ascending doc_id (a null id first, equal ids by hash of their texts; after the last comes the
    first). A null text counts as empty; a table of one row follows itself; no rows give no rows. Compressed
    texts are range-partitioned by id and sorted, so that almost every document is beside the next one; a task
    holds two texts. The last document of each partition waits for the first of the next: those two rows a
    partition are saved with the results and paired afterwards.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = docs.select("doc_id", F.xxhash64(F.col(text)).alias("_h"), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(lean(_pack), f"doc_id {kind}, _h long, _z binary")
    laid = packed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    made = written(laid.mapInArrow(lean(_walk), f"doc_id {kind}, _h long, _part int, _kind int, _z binary, {_TYPES}"))
    heads = made.where("_kind = 1")
    # One narrow row a partition; the order of partitions is that of their first rows.
    by_id = Window.orderBy("doc_id", "_h", "_part")
    first = F.first("_part").over(by_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select("doc_id", "_h", "_part").select(F.col("_part").alias("_p"), F.coalesce(F.lead("_part").over(by_id), first).alias("_next"))
    next_head = heads.select(F.col("_part").alias("_np"), F.col("_z").alias("_next_z"))
    open_rows = made.where("_kind = 2").join(after, F.col("_part") == F.col("_p")).join(next_head, F.col("_next") == F.col("_np"))
    closed = open_rows.select("doc_id", "_z", "_next_z").mapInArrow(lean(_close), f"doc_id {kind}, {_TYPES}")
    return made.where("_kind = 0").select("doc_id", *_RESULT).unionByName(closed)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for b in slices(batch, 2):
            z = [press.compress(t.encode()) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], names=["doc_id", "_h", "_z"])


def _unpack(z: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(z).decode()


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, before, out, size = TaskContext.get().partitionId(), None, [], 0
    none = (None,) * len(_RESULT)
    schema = None
    for b in batches:
        if schema is None:
            schema = pa.schema([b.schema.field(0), ("_h", pa.int64()), ("_part", pa.int32()), ("_kind", pa.int32()), ("_z", pa.binary()), *_FIELDS])
        for doc_id, h, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text, known = _unpack(z), {}
            own = fingerprint(text, known)
            if before is None:
                out.append((doc_id, h, part, 1, z, *none))
            else:
                out.append((*before[:2], part, 0, None, *_row(*before[3:], text, own)))
            before = (doc_id, h, z, text, known, own)
            size += len(own)
            if size >= PIECE:
                yield _batch(out, schema)
                out, size = [], 0
    if before is not None:
        out.append((*before[:2], part, 2, before[2], *none))
        yield _batch(out, schema)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        schema = pa.schema([b.schema.field(0), *_FIELDS])
        for doc_id, z, after in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text, known, other = _unpack(z), {}, _unpack(after)
            yield _batch([(doc_id, *_row(text, known, fingerprint(text, known), other, fingerprint(other)))], schema)


_FIELDS = [("n_chars", pa.int64()), *[(n, pa.string()) for n in _RESULT[1:4]], *[(n, pa.float64()) for n in _RESULT[4:]]]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
