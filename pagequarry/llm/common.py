"""Helpers the operators share: row-wise Arrow work, text pieces, checked broadcasts, cut lineage."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: Rows up to which a narrow table (a few numbers a row) may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of text worked on at once inside a task.
PIECE = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder: its lineage ends and lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, for results that are read with few columns or filters."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``limit`` rows, else as it is (a shuffled join).

    ``small`` should be narrow and cheap to count: a saved table or a few columns of one.
    """
    few = small.limit(limit + 1).count() <= limit
    return F.broadcast(small) if few else small


def look_up(big: DataFrame, small: DataFrame, on: str, salt: Column, parts: int = 64) -> DataFrame:
    """Inner join of ``big`` with one row of ``small`` for each key, nulls equal, when a key may hold most of ``big``.

    A saved ``small`` of few rows is broadcast; else its rows are repeated for each part into which ``salt`` (an
    integer column of ``big``) splits a key.
    """
    key = small.withColumnRenamed(on, "_on")
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(key), big[on].eqNullSafe(F.col("_on"))).drop("_on")
    left = big.withColumn("_part", F.pmod(salt, F.lit(parts)).cast("int"))
    right = key.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, left[on].eqNullSafe(F.col("_on")) & (F.col("_part") == F.col("_of"))).drop("_on", "_of", "_part")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as it takes not to clash with a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality, column by column."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)])


def give_back() -> None:
    """Returns this process's free memory to the system: an idle Python worker would hold it beside a full JVM heap.

    Tables that are quick to make again (``worker_store("tables")``) go too.
    """
    import ctypes

    worker_store("tables").clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over the batches of a partition, giving memory back at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return whole


def by_text(docs: DataFrame, work: Callable[[list], dict], fields: list[T.StructField], text: str = "text", keep: tuple[str, ...] = ("doc_id",), state: Callable[[], object] | None = None, most: int = 4 * PIECE) -> DataFrame:
    """One output row for each row of ``docs``: the ``keep`` columns and what ``work`` makes of the texts.

    ``work`` takes a list of texts (``str``, a null as ``""``) of about ``most`` bytes, and the value of ``state()``
    as second argument if there is one; it returns a list for each of ``fields``.
    """
    kept = [docs.schema[k] for k in keep]
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in kept], *fields])
    arrow = [pa.field(f.name, _arrow(f.dataType)) for f in fields]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state() if state else None
        for batch in batches:
            for part in slices(batch, len(names), most):
                texts = [x or "" for x in part.column(len(names)).to_pylist()]
                made = work(texts, held) if state else work(texts)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(names))], *[pa.array(made[f.name], f.type) for f in arrow]],
                    names=[*names, *[f.name for f in arrow]],
                )

    return docs.select(*names, F.col(text).alias("_text")).mapInArrow(lean(run), schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def slices(batch: pa.RecordBatch, text: int, most: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes of text each (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``data`` cut at ASCII white space into pieces of about ``size`` bytes; no word is cut."""
    import re

    if len(data) <= size:
        yield data
        return
    space, start = re.compile(rb"[\x20\x09-\x0D]"), 0
    while start < len(data):
        found = space.search(data, start + size) if start + size < len(data) else None
        end = found.end() if found else len(data)
        yield data[start:end]
        start = end


class Sent:
    """A value sent to the executors once, with a name of its own. Its classes travel with it, by value."""

    def __init__(self, spark: SparkSession, value: object):
        from pyspark import cloudpickle

        self.data, self.name = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex

    @property
    def value(self):
        import pickle

        return pickle.loads(self.data.value)


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    module = sys.modules.setdefault("_worker_store", types.ModuleType("_worker_store"))
    return module.__dict__.setdefault(name, {})
