"""Page quality: coverage, leftover glare and shadow, their regions, and the page's warnings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pages import shot_box, shot_box_extent
from ..limits import GLARE_SEEN, MIN_REGION_AREA, MIN_SINGLE_AREA, RESIDUAL_THRESHOLD
from ..operators import fusion as FU
from ..operators import regions as R
from ..operators import wording as WD
from ..session import ensure_checkpoint_dir

KEY = ["page_id"]


@dataclass
class Quality:
    fractions: DataFrame  # page_id, covered, uncovered, single, glare, shadow
    per_shot: DataFrame  # page_id, shot, glare
    regions: DataFrame  # page_id, kind, ord, box and place, cause, shots, glare_seen
    warnings: DataFrame  # page_id, code, message


def _regions(df: DataFrame, kind: str) -> DataFrame:
    have = set(df.columns)
    opt = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    shots = F.col("shots") if "shots" in have else (F.array("shot") if "shot" in have else F.lit(None).cast("array<int>"))
    return df.select(
        *KEY, F.lit(kind).alias("kind"), "ord", "fx0", "fy0", "fx1", "fy1", "px0", "py0", "px1", "py1", "area", "location", shots.alias("shots"),
        opt("cause", "string"), opt("severity", "double"), opt("edges", "array<string>"), opt("glare_seen", "double"),
    )


def assess(
    cells: DataFrame, gw: int, gh: int, page_w: int, page_h: int, scan_pages: DataFrame | None = None, dropped: DataFrame | None = None,
    threshold: float = RESIDUAL_THRESHOLD, min_region: float = MIN_REGION_AREA, min_single: float = MIN_SINGLE_AREA,
) -> Quality:
    """Assess all pages at once.

    ``cells`` are the shots on the grid with ``weight``, ``glare`` and
    ``shadow`` (0..1). Single coverage is not looked at on ``scan_pages``.
    ``dropped`` is (page_id, photo) of photos that matched no other.
    """
    ensure_checkpoint_dir(cells.sparkSession)
    # Every map below is an aggregate of these cells: written out once, hashed by page.
    cells = cells.select("page_id", "shot", "y", "x", "weight", "glare", "shadow").repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id").checkpoint()
    maps = FU.fused(cells, "weight", "glare", "shadow").checkpoint()
    glare = maps.select(*FU.CELL, F.col("glare").alias("residual"))
    shadow = maps.select(*FU.CELL, F.col("shadow").alias("residual"))
    left = maps.groupBy(*KEY).agg(*[(F.count_if(F.col(c) >= threshold) / F.count(F.lit(1))).alias(c) for c in ("glare", "shadow")])
    fractions = FU.page_fractions(cells, gw * gh).join(left, KEY)
    fractions = fractions.select(*KEY, *[F.bround(c, 4).alias(c) for c in ("covered", "uncovered", "single", "glare", "shadow")])
    per_shot = FU.shot_shares(cells, "glare", threshold, "glare").withColumn("glare", F.bround("glare", 4))
    sized = (gw, gh, page_w, page_h)
    g = R.glare_regions(glare, cells, KEY, *sized, threshold=threshold, min_area=min_region)
    s = R.shadow_regions(shadow, cells, KEY, *sized, threshold=threshold, min_area=min_region)
    seen = cells if scan_pages is None else cells.join(scan_pages.select("page_id"), "page_id", "left_anti")
    one = R.single_regions(seen, KEY, *sized, residual=glare, threshold=threshold, min_area=min_single)
    gaps = R.region_cells(R.uncovered_mask(cells.select(*FU.CELL).distinct(), KEY, 1, gw, gh, cells), KEY, gw, gh, min_region)
    u = R.region_stats(gaps, KEY, *sized)
    regions = _regions(g, "glare").unionByName(_regions(s, "shadow")).unionByName(_regions(u, "incomplete_coverage")).unionByName(_regions(one, "single_coverage")).checkpoint()
    of = lambda kind: regions.filter(F.col("kind") == kind)
    share = lambda c: fractions.select(*KEY, F.col(c).alias("fraction"))
    texts = [
        (0, "glare", WD.glare_message(WD.region_summary(of("glare"), KEY).join(share("glare"), KEY))),
        (1, "shadow", WD.shadow_message(WD.region_summary(of("shadow"), KEY).join(share("shadow"), KEY))),
        (2, "incomplete_coverage", WD.uncovered_message(of("incomplete_coverage"), share("uncovered"), KEY)),
        (3, "single_coverage", WD.single_coverage_message(of("single_coverage"), share("single"), KEY, GLARE_SEEN)),
    ]
    if dropped is not None:
        texts.append((4, "photos_dropped", WD.dropped_message(dropped, KEY)))
    warnings = None
    for at, code, df in texts:
        part = df.select(*KEY, F.lit(at).alias("ord"), F.lit(code).alias("code"), "message")
        warnings = part if warnings is None else warnings.unionByName(part)
    return Quality(fractions, per_shot, regions, warnings)


def with_shot_boxes(regions: DataFrame, mappers: DataFrame) -> DataFrame:
    """``regions`` with ``shot_boxes``: for each shot of the page into which a region's box falls, the box there in pixels.

    ``mappers`` is (page_id, shot, h, width, height): the homography from the page to a used shot (nine numbers, row
    by row) and the shot's size. A page has at most a few dozen shots.
    """
    at = [*KEY, "kind", "ord"]
    h = [F.get("h", F.lit(i)) for i in range(9)]
    j = regions.select(*at, "px0", "py0", "px1", "py1").join(mappers, KEY)
    j = j.withColumn("_p", shot_box_extent(F.col("px0"), F.col("py0"), F.col("px1"), F.col("py1"), h)).withColumn("_box", shot_box(F.col("_p"), F.col("width"), F.col("height")))
    boxes = j.filter("_box IS NOT NULL").groupBy(*at).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("shot", "_box")))).alias("shot_boxes"))
    return regions.join(boxes, at, "left").withColumn("shot_boxes", F.coalesce("shot_boxes", F.create_map().cast("map<int,array<int>>")))


def payloads(q: Quality, mappers: DataFrame | None = None, glare_seen: float = GLARE_SEEN) -> DataFrame:
    """The page's warnings with all they carry, one row a warning: code, message, fraction, counts, locations and regions.

    ``single_shot`` counts the regions that one photo alone saw, ``all_shots`` the others (glare and shadow only);
    ``location`` is the largest region's, ``locations`` lists all of them, largest first (coverage only). A region has
    its box in page fractions and pixels, its place, shots, cause, edges, its box in each shot, and the glare seen in
    it; what a region doesn't know is null. ``glare_seen_regions`` counts those with enough of it, if anyone looked.
    """
    regions = q.regions.withColumn("shot_boxes", F.lit(None).cast("map<int,array<int>>")) if mappers is None else with_shot_boxes(q.regions, mappers)
    one = F.struct(
        "ord", F.array("fx0", "fy0", "fx1", "fy1").alias("bbox"), F.array("px0", "py0", "px1", "py1").alias("bbox_px"), "location", "shots", "cause", "edges", "shot_boxes", "glare_seen"
    )
    seen = F.col("glare_seen") >= glare_seen
    g = regions.withColumn("_r", one).withColumn("_o", F.col("ord")).groupBy(*KEY, "kind").agg(
        F.count_if(F.col("cause") == "single_shot").alias("_single"), F.count(F.lit(1)).alias("_n"), F.min_by("location", "ord").alias("_largest"),
        F.map_from_entries(F.collect_list(F.struct(F.col("_o"), F.col("_r")))).alias("_by"), F.array_sort(F.collect_list("_o")).alias("_ords"),
        F.count("glare_seen").alias("_looked"), F.count_if(F.coalesce(seen, F.lit(False))).alias("_seen"),
    )
    kinds = {"glare": "glare", "shadow": "shadow", "incomplete_coverage": "uncovered", "single_coverage": "single"}
    share = F.coalesce(*[F.when(F.col("kind") == k, F.col(c)) for k, c in kinds.items()])
    lit = F.col("kind").isin("glare", "shadow")
    rows = F.transform("_ords", lambda o: F.col("_by")[o])
    body = g.join(q.fractions, KEY).select(
        *KEY, F.col("kind").alias("code"), share.alias("fraction"), F.when(lit, F.col("_single")).alias("single_shot"), F.when(lit, F.col("_n") - F.col("_single")).alias("all_shots"),
        F.when(lit, F.col("_largest")).alias("location"), F.when(~lit, F.transform(rows, lambda r: r["location"])).alias("locations"), rows.alias("regions"),
        F.when((F.col("kind") == "single_coverage") & (F.col("_looked") > 0), F.col("_seen")).alias("glare_seen_regions"),
    )
    return q.warnings.join(body, [*KEY, "code"], "left")
