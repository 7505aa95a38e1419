"""Ordered work inside groups that stays balanced when one group is huge.

A plain window puts a whole group into one task. Here a group is looked at
first: groups above ``hot_rows`` rows are sorted as a distributed range sort
and written out once (a reliable checkpoint, so a lost executor cannot change
the cut points), each sorted piece of a group becomes a *chunk*, and a window
result is the result inside the chunk plus what the earlier chunks of the
group carry over. The carried table has one row per (hot group, chunk): at
most one row per sort partition and group. Groups below the bar take the plain
window path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..session import ensure_checkpoint_dir

HOT_ROWS = 2_000_000
_CHUNK, _POS = "_chunk", "_pos"


def _order(order: list) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _hot_groups(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    hot = df.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys)
    return None if hot.isEmpty() else hot


def _with_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` in which nulls are equal; the keys stay those of ``left``."""
    named = right.select(*[F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(F.col(f"_key_{k}"))
    return left.join(named, on, how).drop(*[f"_key_{k}" for k in keys])


class OrderedGroups:
    """Rows of ``df`` ordered by ``order`` inside the groups given by ``keys``.

    ``order`` must be total inside a group (end it with a unique column) for
    results to be reproducible. A null key is a group like others, hot or not.
    Sums are of whole numbers or decimals only, so they don't depend on where a
    group is cut. Groups are counted on ``census`` where given: a cheaper table with at least as many
    rows of every key, such as the base table before joins.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list, hot_rows: int = HOT_ROWS, census: DataFrame | None = None):
        self.keys, self.order = keys, _order(order)
        hot = _hot_groups(df if census is None else census, keys, hot_rows)
        self.split = hot is not None
        if self.split:
            ensure_checkpoint_dir(df.sparkSession)
            rows = _with_keys(df, hot, keys, "left_semi").sort(*[F.col(k) for k in keys], *self.order)
            rows = rows.withColumn(_POS, F.monotonically_increasing_id()).checkpoint()
            # The upper bits of the position are the sort partition it was written from.
            rows = rows.withColumn(_CHUNK, F.shiftright(_POS, 33))
            self._hot = rows
            self._cold = _with_keys(df, hot, keys, "left_anti")
        else:
            self._cold = df

    def _cold_window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def _chunk_window(self):
        return Window.partitionBy(*self.keys, _CHUNK).orderBy(_POS)

    def _carry_window(self):
        return Window.partitionBy(*self.keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)

    def _merge(self, cold: DataFrame, hot: DataFrame) -> DataFrame:
        return cold.unionByName(hot.select(*cold.columns))

    def number(self, name: str = "n") -> DataFrame:
        """1-based position of each row in its group."""
        cold = self._cold.withColumn(name, F.row_number().over(self._cold_window()).cast("bigint"))
        if not self.split:
            return cold
        sizes = self._hot.groupBy(*self.keys, _CHUNK).agg(F.count(F.lit(1)).alias("_size"))
        carry = sizes.select(*self.keys, _CHUNK, F.coalesce(F.sum("_size").over(self._carry_window()), F.lit(0)).alias("_before"))
        hot = _with_keys(self._hot, carry, [*self.keys, _CHUNK])
        hot = hot.withColumn(name, F.row_number().over(self._chunk_window()) + F.col("_before"))
        return self._merge(cold, hot)

    def running(self, **specs: tuple[str, Column]) -> DataFrame:
        """Running ``sum``, ``max`` or ``min`` up to and including each row: ``name=("sum", column)``."""
        fns = {"sum": F.sum, "max": F.max, "min": F.min}
        for name, (how, col) in specs.items():
            if how == "sum" and isinstance(self._cold.select(col).schema[0].dataType, (DoubleType, FloatType)):
                raise ValueError(f"{name}: sums of doubles depend on their order; use whole numbers or decimals")
        w = self._cold_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cold = self._cold
        for name, (how, col) in specs.items():
            cold = cold.withColumn(name, fns[how](col).over(w))
        if not self.split:
            return cold
        hot = self._hot
        for name, (_, col) in specs.items():
            hot = hot.withColumn(f"_in_{name}", col)
        totals = hot.groupBy(*self.keys, _CHUNK).agg(*[fns[how](f"_in_{name}").alias(f"_tot_{name}") for name, (how, _) in specs.items()])
        carry = totals.select(*self.keys, _CHUNK, *[fns[how](f"_tot_{name}").over(self._carry_window()).alias(f"_tot_{name}") for name, (how, _) in specs.items()])
        hot = _with_keys(hot, carry, [*self.keys, _CHUNK])
        cw = self._chunk_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for name, (how, _) in specs.items():
            here, before = fns[how](f"_in_{name}").over(cw), F.col(f"_tot_{name}")
            if how == "sum":
                both = F.when(before.isNull(), here).when(here.isNull(), before).otherwise(here + before)
            else:
                both = (F.greatest if how == "max" else F.least)(here, before)
            hot = hot.withColumn(name, both)
        return self._merge(cold, hot)

    def shifted(self, by: int, **cols: Column) -> DataFrame:
        """The value of each column on the previous (``by=-1``) or next (``by=1``) row of the group; null at its ends."""
        if by not in (-1, 1):
            raise ValueError("by must be -1 or 1")
        step = F.lag if by < 0 else F.lead
        cold = self._cold
        for name, col in cols.items():
            cold = cold.withColumn(name, step(col).over(self._cold_window()))
        if not self.split:
            return cold
        hot = self._hot
        for name, col in cols.items():
            hot = hot.withColumn(f"_in_{name}", col)
        edge = F.struct(*[F.col(f"_in_{name}") for name in cols])
        ends = hot.groupBy(*self.keys, _CHUNK).agg((F.max_by if by < 0 else F.min_by)(edge, F.col(_POS)).alias("_edge"))
        near = Window.partitionBy(*self.keys).orderBy(_CHUNK)
        ends = ends.select(*self.keys, _CHUNK, step("_edge").over(near).alias("_edge"))
        hot = _with_keys(hot, ends, [*self.keys, _CHUNK])
        cw = self._chunk_window()
        at_end = step(F.lit(1)).over(cw).isNull()
        for name in cols:
            hot = hot.withColumn(name, F.when(at_end, F.col(f"_edge._in_{name}")).otherwise(step(f"_in_{name}").over(cw)))
        return self._merge(cold, hot)


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "n", hot_rows: int = HOT_ROWS, census: DataFrame | None = None) -> DataFrame:
    return OrderedGroups(df, keys, order, hot_rows, census).number(name)


def first_k(df: DataFrame, keys: list[str], order: list, k: int, name: str = "n") -> DataFrame:
    """The first ``k`` rows of each group. Spark limits each group before the shuffle, so hot groups stay small."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def quantile_by_index(df: DataFrame, keys: list[str], value: str, index: Column, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The value at a 0-based ``index`` of each group's sorted values; ``index`` may use the group size ``_n``.

    Equal values are counted before the shuffle, and the running count is taken
    with ``OrderedGroups``, so neither many rows nor one hot group reach one task.
    """
    return quantiles_by_index(df, keys, value, {name: index}, hot_rows)


def quantiles_by_index(df: DataFrame, keys: list[str], value: str, indexes: dict[str, Column], hot_rows: int = HOT_ROWS, census: DataFrame | None = None) -> DataFrame:
    """``quantile_by_index`` at several indexes (name: index) in one pass.

    If ``census``, a cheaper table with at least as many rows of every key, has no hot group, one shuffle by group
    serves the counts, their order and the sizes.
    """
    some = df.filter(F.col(value).isNotNull())
    if census is not None and _hot_groups(census, keys, hot_rows) is None:
        group = Window.partitionBy(*keys)
        counts = some.dropna(subset=keys).repartition(*keys).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sized = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(group))
    else:
        counts = some.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
        sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
        sized = OrderedGroups(counts, keys, [value], hot_rows).running(_upto=("sum", F.col("_c"))).join(sizes, keys)
    return sized.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > i, F.col(value))).alias(name) for name, i in indexes.items()]).dropna(subset=list(indexes), how="all")


def spread_groups(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """``df`` hashed by ``keys`` into the session's full number of partitions.

    Grouped Python work costs far more per byte than adaptive execution
    expects, which would merge small inputs into one task. The grouping that
    follows reuses this exchange.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
