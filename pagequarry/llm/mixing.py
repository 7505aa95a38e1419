"""Operator 6: mixing sources to target weights by hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import look_up, saved

#: Bits of a document's hash key, and the bits left below the buckets of each histogram.
KEY_BITS, SHIFTS = 32, (22, 12, 0)
#: Budget passes: each fills what the last one left with documents that fit into it.
PASSES = 3
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_key(doc_id: Column) -> Column:
    """The first 32 bits of the MD5 of the id as text (a null id: of an empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(totals: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, total) with ``target``: ``share`` of all sizes dealt by weight, none above ``most`` times its total.

    Sources take the weights in turn, by code point with null last. What a stopped source leaves goes to the
    others by weight: with sources in order of most * total / weight, the stopped ones come first, and the level
    (target by weight) is that of the first source that its own limit doesn't stop. The windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = totals.select("source", "total", weight.alias("weight"))
    limit = (F.col("total") * most).cast("double")
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("total").over(everything) * share - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    w = w.withColumn("level", level).withColumn("free", F.col("level") <= limit / F.col("weight"))
    chosen = F.min(F.when(F.col("free"), F.struct(limit / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    return w.select("source", "total", F.least(limit, chosen * F.col("weight")).alias("target"))


def _boundary(rows: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """``state`` (source, budget, base) with the first bucket of each source at which the running size passes the budget.

    ``bucket`` is null where all fits; ``base`` becomes the size of all before the bucket.
    """
    histogram = rows.groupBy("source", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("size"))
    here = histogram.join(state.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) + F.col("base")
    over = here.withColumn("run", run).where(F.col("run") > F.col("budget"))
    first = over.groupBy("source").agg(F.min(F.struct("bucket", (F.col("run") - F.col("size")).alias("base"))).alias("first"))
    return state.drop("base").join(first.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select(
        *[c for c in state.columns if c != "base"], F.col("first.bucket").alias("bucket"), F.coalesce("first.base", F.lit(0)).alias("base")
    )


def _threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, budget, key): the least key that no longer fits, found bucket by bucket; 2**32 where all fits.

    Only the rows of the boundary bucket are looked at again, in finer buckets; nothing is sorted but one
    histogram of at most 4096 buckets a source.
    """
    state = saved(_boundary(rows, budgets.withColumn("base", F.lit(0).cast("long")), SHIFTS[0]))
    for above, shift in zip(SHIFTS, SHIFTS[1:], strict=False):
        inside = look_up(rows, state.select("source", F.col("bucket").alias("_bucket")), "source", F.col("key"))
        inside = inside.where(F.shiftright("key", above) == F.col("_bucket")).drop("_bucket")
        finer = _boundary(inside, state.drop("bucket"), shift)
        state = saved(finer)
    return state.select("source", "budget", F.coalesce("bucket", F.lit(1 << KEY_BITS)).alias("limit"))


def measured(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns, ``source``, and each document's size and hash key."""
    named = [F.col(c) for c in columns if c != "source"]
    return docs.select(*named, "source", word_count(F.col(text)).alias("size"), hash_key(F.col("doc_id")).alias("key"))


def budgets(narrow: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row a source: total, target, and for each pass its budget and the key limit below which documents fit it.

    ``narrow`` has source, size and key, and is read several times: it should be saved.
    """
    wanted = saved(targets(narrow.groupBy("source").agg(F.sum("size").alias("total")), share, most, weights))
    spare = F.when(F.col("target") > F.col("total"), F.col("target") - F.col("total")).otherwise(F.col("target"))
    state = wanted.select("source", "total", "target", spare.alias("budget_1"))
    for p in range(1, PASSES + 1):
        fits = (F.col("size") <= F.col(f"budget_{p}")) & (F.col("size") > 0) & ~_before(p)
        rows = look_up(narrow, state, "source", F.col("key")).where(fits).select("source", "size", "key")
        limits = _threshold(rows, state.select("source", F.col(f"budget_{p}").alias("budget"))).select(F.col("source").alias("_s"), F.col("limit").alias(f"limit_{p}"))
        state = saved(state.join(limits, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
        if p < PASSES:
            used = look_up(narrow, state, "source", F.col("key")).where(fits & (F.col("key") < F.col(f"limit_{p}"))).groupBy("source").agg(F.sum("size").alias("used"))
            state = state.join(used.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
            state = saved(state.withColumn(f"budget_{p + 1}", F.col(f"budget_{p}") - F.coalesce("used", F.lit(0))).drop("used"))
    return state


def copies() -> Column:
    """How often a document is taken, from its size and key and its source's row of ``budgets``."""
    return (F.col("target") > F.col("total")).cast("long") + (_before(PASSES + 1) & (F.col("size") > 0)).cast("long")


def mix(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, text: str = "text") -> DataFrame:
    """How many words of each document a mix takes: doc_id, size, source_size, target and taken.

    The size of a text is its number of words (a null text: 0); sources (null is one of its own) get targets by
    ``targets``. A target above its source's size takes every document once and fills the rest with second
    copies. Documents are chosen by hash: those whose key lies below the budget's threshold. What the budget
    still leaves goes, in ``PASSES`` passes, to documents that fit into it. Equal ids share a key, so they are
    taken or left together; repeated rows count as often as they stand there; reruns agree. Without rows there
    is no result. Text is read once; everything after works on a narrow saved table.
    """
    narrow = saved(measured(docs, ["doc_id"], text))
    found = look_up(narrow, budgets(narrow, share, most, weights), "source", F.col("key"))
    return found.select("doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("size") * copies()).alias("taken"))


def mixed(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, text: str = "text") -> DataFrame:
    """``docs`` as the mix has them: rows that it takes twice stand there twice, rows that it leaves are gone.

    Texts without words have nothing to take and are gone too. The columns stay as they are. Only narrow columns
    are saved or moved; texts are read again and their copies made in place.
    """
    names = docs.columns
    state = budgets(saved(measured(docs, [], text)), share, most, weights)
    whole = docs.select(F.struct(*names).alias("_row"), "source", word_count(F.col(text)).alias("size"), hash_key(F.col("doc_id")).alias("key"))
    taken = look_up(whole, state, "source", F.col("key")).select("_row", F.when(F.col("size") > 0, copies()).otherwise(0).alias("_n"))
    return taken.where("_n > 0").select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).select("_row.*")


def _before(p: int) -> Column:
    """Whether a pass before ``p`` chose the document."""
    out = F.lit(False)
    for q in range(1, p):
        out = out | ((F.col("size") <= F.col(f"budget_{q}")) & (F.col("key") < F.col(f"limit_{q}")))
    return out


def mix_sql(share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> str:
    """The same mix in DuckDB SQL: documents in order of their keys while the running size fits the budget."""
    sql = f"""WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS key, row_number() OVER () AS rid FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS total FROM sized GROUP BY source),
weighed AS (SELECT source, total, [{", ".join(f"{w}.0::DOUBLE" for w in weights)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INT] AS weight FROM totals),
levels AS (SELECT *, (total * {most})::DOUBLE AS cap, ((sum(total) OVER ())::DOUBLE * {share}::DOUBLE - coalesce((sum(total * {most}) OVER (ORDER BY (total * {most})::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 0.0::DOUBLE))
  / sum(weight) OVER (ORDER BY (total * {most})::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
level AS (SELECT arg_min(level, cap / weight) AS level FROM levels WHERE level <= cap / weight),
state0 AS (SELECT source, total, least(cap, (SELECT level FROM level) * weight) AS target FROM levels),
mixed0 AS (SELECT s.*, t.total, t.target, CASE WHEN target > total THEN target - total ELSE target END AS budget, false AS chosen FROM sized s JOIN state0 t ON s.source IS NOT DISTINCT FROM t.source)"""
    for p in range(1, passes + 1):
        sql += f""",
run{p} AS (SELECT rid, sum(size) OVER (PARTITION BY source ORDER BY key RANGE UNBOUNDED PRECEDING) AS run FROM mixed{p - 1} WHERE NOT chosen AND size > 0 AND size <= budget),
taken{p} AS (SELECT m.*, coalesce(r.run <= m.budget, false) AS now FROM mixed{p - 1} m LEFT JOIN run{p} r USING (rid)),
mixed{p} AS (SELECT doc_id, source, size, key, rid, total, target, budget - (sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY source))::DOUBLE AS budget, chosen OR now AS chosen FROM taken{p})"""
    return sql + f"\nSELECT doc_id, size, total AS source_size, target, (size * (CASE WHEN target > total THEN 1 ELSE 0 END + CASE WHEN chosen THEN 1 ELSE 0 END))::BIGINT AS taken FROM mixed{passes}"
