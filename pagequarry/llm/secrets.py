"""Operator 1: secrets in texts, by rules and by sliding-window entropy."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import by_text, lean, slices

# What the base rules look for, and the least length that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

#: Character class: what separates its candidates, window length, and the entropy in bits that a window must reach.
CLASSES = {
    "entropy_hex": (re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}(?![0-9A-Za-z])"), 24, 3.0),
    "entropy_base64": (re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}"), 24, 3.9),
}
#: Candidates that are no secrets whatever their entropy.
ALLOWED = (
    re.compile(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),  # UUID
    re.compile(r"^[^A-Za-z]*$"),  # numbers, rules of signs
    re.compile(r"^([a-z]+|[A-Z]+)[0-9]{0,4}$"),  # a word with a number
)
#: Windows that touch one of these are no secrets.
PLACEHOLDER = re.compile(r"(?i)example|sample|placeholder|xxxx|0123456789|abcdefgh|lorem")
#: What stands between separators in slugs, paths and dates of plain words; windows over nothing else are no secrets.
TOKEN = re.compile(r"[A-Za-z0-9]+")
PLAIN = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]{1,4}")
#: Letters in mixed case are words if they fall into these parts, of ``WORD_LENGTH`` letters or more on average.
WORDS, CAPITALS, WORD_LENGTH = re.compile(r"[a-z]*+(?:(?:A[st]|By|I[dfnst]|My|No|O[fnr]|To|Up)(?![a-z])|[A-Z]++[a-z]{2,}+)*+[A-Z]*+"), re.compile(r"[A-Z]+"), 4


def _plain(token: str) -> bool:
    if PLAIN.fullmatch(token):
        return True
    return bool(WORDS.fullmatch(token)) and len(token) >= WORD_LENGTH * len(CAPITALS.findall(token))


def _counting(s: str, width: int) -> Callable[[int], bool]:
    """Whether the window that starts at a place of the candidate may be a secret."""
    named, odd = bytearray(len(s)), bytearray(len(s))
    for m in PLACEHOLDER.finditer(s):
        named[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    for m in TOKEN.finditer(s):
        if not _plain(m[0]):
            odd[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return lambda i: odd.find(1, i, i + width) >= 0 and named.find(1, i, i + width) < 0


def entropy_windows(s: str, width: int, least: float, counting: Callable[[], Callable[[int], bool]] | None = None) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``width`` characters whose Shannon entropy is at least ``least`` bits.

    ``counting``, called at the first such window, gives a rule: only windows are taken for whose start it holds.

    The sum of n log2 n over the window's character counts is kept up to date as one character enters and one
    leaves; the entropy is log2(width) minus that sum over the width.
    """
    part = [0.0, 0.0, *(n * math.log2(n) for n in range(2, width + 1))]
    most = (math.log2(width) - least) * width + 1e-9
    counts: dict[str, int] = {}
    total, spans, counts_here = 0.0, [], None
    for i, c in enumerate(s):
        if i >= width:
            old = s[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += part[n - 1] - part[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += part[n + 1] - part[n]
        if i >= width - 1 and total <= most:
            start = i - width + 1
            if counting:
                counts_here = counts_here or counting()
                if not counts_here(start):
                    continue
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


class _Cover:
    """Spans in order of their starts, joined where they touch or overlap: tells whether they hold a stretch wholly."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            self.add(start, end)

    def add(self, start: int, end: int) -> None:
        lo = bisect_left(self.ends, start)
        hi = bisect_right(self.starts, end)
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [start], [end]

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start) - 1
        return k >= 0 and self.ends[k] >= end


def find_secrets(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans and all spans of a text, as (start, end, kind) in code points, by start and kind."""
    base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    more: list[tuple[int, int, str]] = []
    cover = _Cover(base)
    for kind, (candidates, width, least) in CLASSES.items():
        for m in candidates.finditer(text):
            if any(p.search(m[0]) for p in ALLOWED):
                continue
            for start, end in entropy_windows(m[0], width, least, partial(_counting, m[0], width)):
                start, end = m.start() + start, m.start() + end
                if not cover.holds(start, end):
                    more.append((start, end, kind))
                    cover.add(start, end)
    order = lambda x: (x[0], KINDS.index(x[2]))
    return sorted(base, key=order), sorted([*base, *more], key=order)


def named(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secret_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Secrets in every text: counts of the base kinds, ``base`` and ``spans`` (``kind:start:end``, comma-joined).

    Base rules find assignments, access keys and hex digests. Beyond them, candidate strings of one character
    class are scanned by a sliding window; windows of high entropy are joined to spans, without those that touch a
    placeholder or hold plain words alone, unless an allow-list pattern names the candidate or other spans cover it wholly; one that they cover in part is reported beside
    them. A null text counts as empty: no spans, counts 0.
    A span ends before ``end``. Repeated rows give repeated results; only ``keep`` and the text column are read,
    so other columns of whatever name don't matter. Nothing is held but one slice of a batch.
    """

    def work(texts: list[str]) -> dict:
        found = [find_secrets(t) for t in texts]
        count = lambda kind: [sum(k == kind for _, _, k in base) for base, _ in found]
        return {
            "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"),
            "base": [named(base) for base, _ in found], "spans": [named(spans) for _, spans in found],
        }

    fields = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base", "spans")]
    return by_text(docs, work, fields, text, keep)


def redacted(docs: DataFrame, mask: str = "[secret]", text: str = "text") -> DataFrame:
    """``docs`` with every secret in its text replaced by ``mask``; the columns stay as they are.

    Overlapping spans are replaced as one. A null text stays null, a text without secrets stays as it is.
    """
    import pyarrow as pa

    at = docs.columns.index(text)

    def cut(t: str | None) -> str | None:
        spans = find_secrets(t)[1] if t else []
        out, done = [], 0
        for start, end, _ in spans:
            if end > done:
                if start >= done:
                    out += [t[done:start], mask]
                done = end
        return "".join([*out, t[done:]]) if spans else t

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                cells = pa.array([cut(t) for t in part.column(at).to_pylist()], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), cells)

    return docs.mapInArrow(lean(run), docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's rows."""
    from pyspark.sql import functions as F

    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


