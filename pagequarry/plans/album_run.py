"""Incremental album runs: what each page needs, and running only that."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pages import is_scan, scan_dpi
from ..functions.text import content_key, natural_key
from ..operators.ordered import spread_groups
from ..session import work_folder, written


def photo_lists(photos: DataFrame) -> DataFrame:
    """Per page its photos' hashes in natural order of the photo names (a page holds at most a few dozen photos)."""
    one = photos.select("page_id", "photo", "sha").distinct()
    listed = F.array_sort(F.collect_list(F.struct(natural_key(F.col("photo")).alias("k"), "photo", "sha")))
    return one.groupBy("page_id").agg(listed.alias("l")).select("page_id", F.transform("l", lambda s: s["photo"]).alias("photos"), F.transform("l", lambda s: s["sha"]).alias("shas"))


def page_sources(photo: DataFrame, marker: str) -> DataFrame:
    """``scan`` for pages all of whose photos carry the scan mark, with their common resolution if known."""
    dpi = scan_dpi(F.col("resolution"), F.col("unit"))
    g = photo.groupBy("page_id").agg(F.bool_and(is_scan(F.col("software"), marker)).alias("_scan"), F.min(dpi).alias("_lo"), F.max(dpi).alias("_hi"), F.bool_or(F.col("resolution").isNull()).alias("_unknown"))
    scan = F.col("_scan")
    return g.select("page_id", F.when(scan, "scan").otherwise("photo").alias("source"), F.when(scan & ~F.col("_unknown") & (F.col("_lo") == F.col("_hi")), F.col("_lo")).alias("dpi"))


def with_keys(spec: DataFrame, version: str) -> DataFrame:
    """Page specs with their process and print keys; ``spec`` has shas, page_options, size, print_options and coverage."""
    process = content_key(F.col("page_options").alias("page"), F.col("shas").alias("photos"), F.lit(version).alias("version"))
    s = spec.withColumn("process_key", process)
    return s.withColumn("print_key", content_key(F.col("coverage"), F.col("print_options").alias("print"), F.col("process_key").alias("process"), F.col("size")))


def decide(spec: DataFrame, previous: DataFrame, force: bool = False) -> DataFrame:
    """What each page needs: ``failed`` (a known problem), ``process``, ``reprint`` or ``reuse``.

    ``spec`` has (album_id, folder, problem, process_key, print_key, processed,
    print); ``previous`` the same keys and paths from the last report, with
    ``processed_exists`` and ``print_exists``.
    """
    old = previous.select(
        "album_id", "folder", *[F.col(c).alias(f"_{c}") for c in ("process_key", "print_key", "processed", "print", "processed_exists", "print_exists")]
    )
    j = spec.join(old, ["album_id", "folder"], "left")
    same = lambda a: F.coalesce(F.col(a) == F.col(f"_{a}"), F.lit(False))
    there = lambda a: F.coalesce(F.col(a), F.lit(False))
    keep_page = F.lit(not force) & same("process_key") & same("processed") & there("_processed_exists")
    keep_print = same("print_key") & same("print") & there("_print_exists")
    decision = F.when(F.col("problem").isNotNull(), "failed").when(~keep_page, "process").when(~keep_print, "reprint").otherwise("reuse")
    return j.select(*spec.columns, decision.alias("decision"))


def isolated(fn: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str], key: str) -> Callable[[pd.DataFrame], pd.DataFrame | dict]:
    """``fn`` over one page's rows, with a failure turned into one row (a dictionary) that says why.

    ``fn`` gives a frame, or a dictionary for a single row, which costs far less.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame | dict:
        try:
            out = fn(pdf)
            if isinstance(out, dict):
                return {c: out[c] for c in columns} | {"error": None}
            return out if isinstance(out, pd.DataFrame) and list(out.columns) == columns else out.assign(error=None)[columns]
        except Exception as e:  # noqa: BLE001 - one bad page must not stop the album
            error = str(e) if isinstance(e, RuntimeError) and str(e) else f"{type(e).__name__}: {e}"
            return {c: None for c in columns} | {key: pdf[key].iloc[0], "error": error}

    return run


def run_pages(pages: DataFrame, runner: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "page_id") -> DataFrame:
    """Run ``runner`` on each page's rows (its photos), one call a page; ``schema`` without the error column.

    Pages lie together and sorted in their partitions, and one Python batch holds many of them: a group of its own
    for each page costs milliseconds, many times what most pages need. Whole numbers and flags travel without nulls
    beside a mark of where they were, so a page's null changes no other page's types.
    """
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    run = isolated(runner, columns, key)
    names, marked = pages.columns, [f.name for f in pages.schema if isinstance(f.dataType, T.IntegralType | T.BooleanType)]
    # By a hash of its own, as an exchange by the key would give way to a join's below, which adaptive execution may undo.
    at = F.xxhash64(key)
    rows = spread_groups(pages, [at]).withColumn("_at", at).sortWithinPartitions("_at", key)
    zero = {c: F.lit(0).cast(pages.schema[c].dataType) for c in marked}
    rows = rows.select(*[F.coalesce(c, zero[c]).alias(c) if c in zero else F.col(c) for c in names], *[F.col(c).isNull().alias(f"_null_{c}") for c in marked])

    def frames_of(batch: pd.DataFrame, starts: list[int]) -> Iterator[pd.DataFrame]:
        null = np.logical_or.reduceat(batch[[f"_null_{c}" for c in marked]].to_numpy(bool)[: starts[-1]], starts[:-1], axis=0)
        kept, made, index = batch[names].copy(), {}, {}
        for a, b, some in zip(starts, starts[1:], map(tuple, null.tolist())):
            # Pages with nulls in the same columns are parts of one frame, in which those columns can hold nulls.
            frame = kept if not any(some) else made[some] if some in made else made.setdefault(some, with_nulls(batch, [c for c, there in zip(marked, some) if there]))
            pdf = frame.iloc[a:b]
            pdf.index = index.setdefault(b - a, pd.RangeIndex(b - a))
            yield pdf

    def with_nulls(batch: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
        pdf = batch[names].copy()
        for c in columns:
            own = pdf[c].to_numpy(object if pdf[c].dtype == bool else np.float64, copy=True)
            own[batch[f"_null_{c}"].to_numpy(bool)] = None
            pdf[c] = own
        return pdf

    def done(batch: pd.DataFrame, starts: list[int]) -> Iterator[pd.DataFrame]:
        if len(starts) < 2:
            return
        made, single = {}, []
        with pd.option_context("mode.chained_assignment", None):  # a page's frame is its runner's to change
            for pdf in frames_of(batch, starts):
                out = run(pdf)
                if isinstance(out, dict):
                    single.append(out)
                else:
                    made.setdefault(tuple(out.dtypes), []).append(out)  # frames of one batch keep the types they came with
        for frames in made.values():
            yield pd.concat(frames, ignore_index=True).assign(error=None)
        if single:
            yield pd.DataFrame(single, columns=[*columns, "error"], dtype=object)

    def run_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []  # the page that the last batch ended in
        for batch in batches:
            if len(batch) == 0:
                continue
            if parts and _same_key(parts[0], batch, key) and _same_key(batch.iloc[-1:], batch, key):
                parts.append(batch)
                continue
            batch = pd.concat([*parts, batch], ignore_index=True)
            code = pd.factorize(batch[key], use_na_sentinel=False)[0] * 2 + (batch[f"_null_{key}"].to_numpy(bool) if key in marked else 0)
            starts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist()]
            yield from done(batch, starts)
            parts = [batch.iloc[starts[-1] :]]
        if parts:
            last = pd.concat(parts, ignore_index=True)
            yield from done(last, [0, len(last)])

    return rows.mapInPandas(run_all, f"{schema}, error string")


def _same_key(a: pd.DataFrame, b: pd.DataFrame, key: str) -> bool:
    """Whether the first rows of both are of one page."""
    x, y = a[key].iloc[0], b[key].iloc[0]
    mark = f"_null_{key}"
    return bool((pd.isna(x) and pd.isna(y)) or x == y) and (mark not in a or a[mark].iloc[0] == b[mark].iloc[0])


def with_problems(pages: DataFrame, folders: DataFrame, photos: DataFrame) -> DataFrame:
    """``pages`` (album_id, folder, index) with ``problem`` where their folder is not there or holds no photos.

    ``folders`` is (album_id, folder) of all that exist, ``photos`` the same once a photo.
    """
    key = ["album_id", "folder"]
    there = folders.select(*key).distinct().withColumn("_there", F.lit(True))
    filled = photos.select(*key).distinct().withColumn("_filled", F.lit(True))
    j = pages.join(there, key, "left").join(filled, key, "left")
    quoted = F.concat(F.lit("'"), "folder", F.lit("'"))
    problem = F.when(F.col("_there").isNull(), F.concat(F.lit("folder "), quoted, F.lit(" not found"))).when(F.col("_filled").isNull(), F.concat(F.lit("no photos in "), quoted))
    return j.withColumn("problem", problem).drop("_there", "_filled")


def _before_known(decided: DataFrame) -> DataFrame:
    """Strict mode: pages behind one whose problem is known beforehand are not run."""
    known = decided.filter("decision = 'failed'").groupBy("album_id").agg(F.min("index").alias("_stop"))
    return decided.join(known, "album_id", "left").filter(F.col("_stop").isNull() | (F.col("index") < F.col("_stop"))).drop("_stop")


def run_album(decided: DataFrame, photos: DataFrame, runner, schema: str, key: str = "page_id", printer=None, print_schema: str | None = None, strict: bool = False) -> DataFrame:
    """What becomes of each page. Only pages that must be processed enter the heavy job, and only those and ``reprint`` pages the printer.

    ``printer`` (with ``print_schema``) gets one row a page, with its decision and what ``runner`` made of it; its
    columns follow. A page that fails in either has ``error``. With ``strict``, pages behind a known problem aren't run.
    """
    if printer is not None:
        # The decisions and what was made are read by several steps: each is written out once.
        root = work_folder(decided.sparkSession, "album-run")
        decided = written(decided, f"{root}/decided")
    runs = _before_known(decided) if strict else decided
    todo = runs.filter("decision = 'process'").select(key)
    results = run_pages(photos.join(todo, key, "left_semi"), runner, schema, key)
    if printer is not None:
        results = written(results, f"{root}/results")
        again = runs.filter("decision IN ('process', 'reprint')").select(key, "decision").join(results, key, "left").filter("error IS NULL").drop("error")
        made = written(run_pages(again, printer, print_schema, key).withColumnRenamed("error", "_print_error"), f"{root}/printed")
        results = runs.filter("decision IN ('process', 'reprint')").select(key).join(results, key, "left").join(made, key, "left")
        results = results.withColumn("error", F.coalesce("error", "_print_error")).drop("_print_error")
    j = decided.join(results, key, "left")
    done = F.when(F.col("decision") == "process", "ok").when((F.col("decision") == "reprint") & F.lit(printer is not None), "reprinted").otherwise("reused")
    status = F.when((F.col("decision") == "failed") | F.col("error").isNotNull(), "failed").otherwise(done)
    return j.withColumn("status", status).withColumn("error", F.coalesce("error", "problem"))


def first_failure(entries: DataFrame) -> DataFrame:
    """Strict mode: per album the failed page that stops it, the lowest-numbered one."""
    return entries.filter("status = 'failed'").groupBy("album_id").agg(F.min_by("page_id", "index").alias("page_id"), F.min_by("error", "index").alias("error"), F.min("index").alias("index"))


def recorded(entries: DataFrame, strict: bool = False, placeholder: bool = True) -> DataFrame:
    """The report's entries: ``entries`` (album_id, folder, index, status, error) with ``image``, what the album's PDF shows.

    A failed page shows a placeholder, unless placeholders are off or the run is strict. A strict run stops at an
    album's first failed page: every later page has the entry ``stopped``, without error or image.
    """
    stopped = F.lit(False)
    out = entries
    if strict:
        stops = first_failure(entries).select("album_id", F.col("index").alias("_stop"))
        out = entries.join(stops, "album_id", "left")
        stopped = F.coalesce(F.col("index") > F.col("_stop"), F.lit(False))
    shown = F.when(stopped, None).when(F.col("status") != "failed", F.concat(F.lit("print/"), "folder")).when(F.lit(placeholder and not strict), F.concat(F.lit("placeholder/"), "folder"))
    out = out.withColumn("image", shown).withColumn("error", F.when(~stopped, F.col("error"))).withColumn("status", F.when(stopped, "stopped").otherwise(F.col("status")))
    return out.select(*entries.columns, "image")


def pdf_pages(entries: DataFrame) -> DataFrame:
    """The PDF of each album: its images in the order of the pages, and how many; albums without images have none."""
    kept = F.array_sort(F.collect_list(F.when(F.col("image").isNotNull(), F.struct("index", "image"))))
    g = entries.groupBy("album_id").agg(kept.alias("_l"))
    return g.filter(F.size("_l") > 0).select("album_id", F.transform("_l", lambda s: s["image"]).alias("images"), F.size("_l").alias("pages"))
