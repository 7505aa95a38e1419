"""Writing results: reports, partitioned layers and training sets, and versioned publishing."""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a partitioned sink.
BUCKETS = 64


def write_album_reports(entries: DataFrame, path: str) -> None:
    """Album reports, one JSON row an album with its counters and page entries, partitioned by a bucket of the album."""
    from ..operators.catalog import album_report

    album_report(entries).withColumn("bucket", _bucket("album_id", BUCKETS)).write.mode("overwrite").partitionBy("bucket").json(path)


def write_layers(cells: DataFrame, path: str) -> None:
    """Mask layers as cells, partitioned by layer and a bucket of the page; page and cell stay columns."""
    cells.withColumn("bucket", _bucket("page_id", BUCKETS)).repartition("layer", "bucket").write.mode("overwrite").partitionBy("layer", "bucket").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is written at a path; errors other than a missing or empty folder are raised."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def add_training_pages(samples: DataFrame, path: str) -> None:
    """Append pages that are not in the training set yet; pages already there are left as they are.

    The folder is partitioned by a bucket of the page, so it holds ``BUCKETS`` folders however many pages there are.
    """
    spark = samples.sparkSession
    new = samples.withColumn("page", F.col("page").cast("string")).withColumn("bucket", _bucket("page", BUCKETS))
    if _exists(spark, path):
        known = spark.read.parquet(path).select("bucket", "page").distinct()
        new = new.join(known, ["bucket", "page"], "left_anti")
    new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def write_numbers(df: DataFrame, path: str, source_tree: str) -> None:
    """Evaluation numbers; a local target inside ``source_tree`` is refused."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        out, tree = os.path.realpath(os.path.expanduser(parsed.path)), os.path.realpath(source_tree)
        if out == tree or out.startswith(tree + os.sep):
            raise ValueError(f"{path} is inside {source_tree}; write evaluation results outside it")
    df.write.mode("overwrite").json(path)


class Published:
    """Run outputs by version: a run is written first, and a small pointer table says which run is each page's current one.

    Each version's pointers are one folder, written as a whole, so readers see either the old run or the new one, never
    half of each, and a version that is written again changes nothing. ``compact`` folds pointers into the latest one
    of each page, in a new generation of the table. One writer at a time; any number of readers.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write_run(self, run: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/runs/run={run}")

    def adopt(self, run: str, version: int, pages: DataFrame) -> None:
        """Points the pages at the run, from ``version`` on (a growing number)."""
        rows = pages.select("page_id").distinct().select("page_id", F.lit(run).alias("run"), F.lit(version).cast("long").alias("version"))
        rows.write.mode("overwrite").parquet(f"{self._pointers()}/part=v{version}")

    def _generation(self) -> int:
        marks = f"{self.root}/generations"
        return self.spark.read.parquet(marks).agg(F.max("generation")).first()[0] if _exists(self.spark, marks) else 0

    def _pointers(self) -> str:
        return f"{self.root}/pointers-{self._generation()}"

    def pointers(self) -> DataFrame:
        p = self.spark.read.parquet(self._pointers())
        return p.groupBy("page_id").agg(F.max_by("run", "version").alias("run"))

    def compact(self) -> None:
        """Writes the latest pointer of each page as the next generation, then the mark that readers go by."""
        now = self._generation()
        if not _exists(self.spark, f"{self.root}/pointers-{now}"):
            return
        p = self.spark.read.parquet(f"{self.root}/pointers-{now}")
        latest = p.groupBy("page_id").agg(F.max_by("run", "version").alias("run"), F.max("version").alias("version"))
        latest.write.mode("overwrite").parquet(f"{self.root}/pointers-{now + 1}/part=folded")
        self.spark.createDataFrame([(now + 1,)], "generation int").coalesce(1).write.mode("append").parquet(f"{self.root}/generations")

    def read(self) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.root}/runs").parquet(f"{self.root}/runs")
        return rows.withColumn("run", F.col("run").cast("string")).join(self.pointers(), ["page_id", "run"])

    def publish(self, pages: DataFrame, batch: int, make: Callable[[DataFrame], DataFrame]) -> None:
        """One batch of ready pages: what ``make`` gives for them becomes a run, then their pointers move to it.

        Run and pointers go by the batch number, so a batch that is done again after a failure overwrites what it left.
        """
        ids = pages.select("page_id").distinct()
        if ids.isEmpty():
            return
        run = f"batch-{batch}"
        self.write_run(run, make(ids))
        self.adopt(run, batch, self.spark.read.parquet(f"{self.root}/runs/run={run}"))

    def publish_stream(self, ready: DataFrame, make: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
        """Publishes all ready events (page_id) that are there now; a restart goes on from ``checkpoint``."""
        q = ready.writeStream.foreachBatch(lambda df, batch: self.publish(df, batch, make)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
