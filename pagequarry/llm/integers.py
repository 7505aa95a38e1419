"""Vectors as whole numbers of any size, and sums of them that never overflow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components up to this size are worked on as 64-bit integers (their squared distances fit, up to 2**12 of them);
#: vectors with larger ones are exact Python integers, held as text.
PLAIN = 1 << 24
#: The largest number of a long; sums and distances beyond it are given as this.
LARGEST = (1 << 63) - 1
_LIMB = 40


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly, for a power of two ``scale``."""
    return int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale))


def integer_vectors(column: pa.Array, scale: int, dimension: int | None = None) -> tuple[np.ndarray, list, list]:
    """Which rows are kept, and for each of those its components as int32 bytes or (``None`` there) as decimal text.

    Kept are vectors without null or non-finite components, of ``dimension`` components if one is given.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    start = column.offsets.to_numpy()[:-1].astype(np.int64)
    size = np.diff(column.offsets.to_numpy().astype(np.int64))
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (bad[start + size] == bad[start])
    if dimension is not None:
        ok &= size == dimension
    rows = np.flatnonzero(ok)
    plain, text = [], []
    for i in rows:
        x = values[start[i] : start[i] + size[i]]
        if len(x) and np.abs(x).max() * scale > PLAIN - 1:
            plain.append(None)
            text.append(",".join(str(whole(float(c), scale)) for c in x))
        else:
            plain.append(np.floor(x * scale).astype("<i4").tobytes())
            text.append(None)
    return rows, plain, text


def matrix(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<i4").reshape(len(cells), -1).astype(np.int64)


def parsed(text: str) -> list[int]:
    return [int(c) for c in text.split(",")] if text else []


def read(v: bytes | None, text: str | None) -> list[int]:
    """A kept vector as a list of integers."""
    return parsed(text) if v is None else np.frombuffer(v, "<i4").tolist()


def is_plain(vector: list[int]) -> bool:
    return all(-PLAIN <= c <= PLAIN for c in vector)


def square(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


class Sums:
    """Counts and componentwise sums of vectors by number, exact whatever their size."""

    def __init__(self):
        self.held: dict[int, list[int]] = {}

    def add(self, number: int, count: int, total) -> None:
        """``total`` is the sum of ``count`` vectors of the group ``number``."""
        new = [int(count), *(int(t) for t in total)]
        old = self.held.get(number)
        self.held[number] = new if old is None else [a + b for a, b in zip(old, new, strict=True)]

    def batch(self) -> pa.RecordBatch:
        """The sums in limbs of 40 bits, so that the long sums of any number of tasks stay exact."""
        out = []
        for number, values in self.held.items():
            for at, v in enumerate(values):
                sign, v, limb = (-1 if v < 0 else 1), abs(v), 0
                while v:
                    out.append((number, at, limb, sign * (v & ((1 << _LIMB) - 1))))
                    v, limb = v >> _LIMB, limb + 1
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["number", "at", "limb", "value"])


def summed(df: DataFrame, add: Callable[[pa.RecordBatch, Sums], None]) -> dict[int, tuple[int, dict[int, int]]]:
    """Count and nonzero sums by position for each group number; ``add`` takes batches in the tasks.

    Each task gives one partial sum a group, number and limb, so one group may hold any share of the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            add(batch, sums)
        yield sums.batch()

    rows = df.mapInArrow(run, "number int, at int, limb int, value long").groupBy("number", "at", "limb").agg(F.sum("value").alias("value")).collect()
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        group = out.setdefault(r.number, {})
        group[r["at"]] = group.get(r["at"], 0) + (r.value << (_LIMB * r.limb))
    return {number: (group.pop(0), {at - 1: v for at, v in group.items()}) for number, group in out.items()}


def moved(entries: list[list[int]], sums: dict[int, tuple[int, dict[int, int]]], first: int = 0) -> list[list[int]]:
    """``entries`` replaced by the floor of their groups' means; those without a group stay. Entry i is group ``first + i``."""
    out = []
    for i, e in enumerate(entries):
        count, total = sums.get(first + i, (0, {}))
        out.append([total.get(p, 0) // count for p in range(len(e))] if count else e)
    return out
