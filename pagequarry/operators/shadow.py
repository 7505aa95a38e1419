"""Shadows found by comparing each shot with the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import photometry as P
from ..limits import (
    SHADOW_B_TOL, SHADOW_CHROMA_TOL, SHADOW_DARK_LEVEL, SHADOW_DEPTH_RAMP, SHADOW_MIN_AREA, SHADOW_MIN_CORRELATION, SHADOW_MIN_DEPTH, SHADOW_SEED, SHADOW_WEAK,
)
from .fusion import CELL, SHOT
from .grid import box_sums, local_max_disk_at
from .regions import grown, grown_from

AT = [*SHOT, "y", "x"]
_EPS = 1e-6
GLARE_REACH = 0.03  # how far the glare check reaches beyond plain glare, fraction of the long side


def _other_of_two(values: Column, own: Column) -> Column:
    first = F.get(values, F.lit(0))
    return F.when(first == own, F.get(values, F.lit(1))).otherwise(first)


def with_references(cells: DataFrame) -> DataFrame:
    """Linear channels ``i_*``, the other shots' channels ``q_*`` and how many others cover the cell, on overlapped cells."""
    w = Window.partitionBy(*CELL)  # at most the shots of one page
    out = cells.select(*AT, *[P.linear(F.col(c)).alias(f"i_{c}") for c in "bgr"])
    count = F.count(F.lit(1)).over(w)
    out = out.withColumn("others", count - 1)
    for c in "bgr":
        values = F.array_sort(F.collect_list(f"i_{c}").over(w))
        lower = F.get(values, F.floor((F.size(values) - 1) / 2).cast("int"))
        out = out.withColumn(f"q_{c}", F.when(F.col("others") == 1, _other_of_two(values, F.col(f"i_{c}"))).otherwise(lower))
    return out.filter("others > 0")


def window_fit(pairs: DataFrame, radius: int, gw: int, gh: int) -> DataFrame:
    """Means of both sides and the texture fit ``q = a * i + b`` over a window of compared cells.

    Each channel is centred on its own mean; ``a`` is the ratio of the two
    sides' contrast, so noise on both does not pull it towards 0.
    """
    sums = {"_n": ()}
    for c in "bgr":
        i, q = f"i_{c}", f"q_{c}"
        sums |= {f"_i{c}": (i,), f"_q{c}": (q,), f"_ii{c}": (i, i), f"_qq{c}": (q, q), f"_iq{c}": (i, q)}
    s = box_sums(pairs.select(*AT, *[f"{s}_{c}" for s in "iq" for c in "bgr"], "others"), SHOT, radius, gw, gh, **sums)
    mean = lambda n: F.try_divide(F.col(n), F.col("_n"))
    total = lambda f: f("b") + f("g") + f("r")
    var_i = F.greatest(total(lambda c: mean(f"_ii{c}") - mean(f"_i{c}") * mean(f"_i{c}")), F.lit(0.0))
    var_q = F.greatest(total(lambda c: mean(f"_qq{c}") - mean(f"_q{c}") * mean(f"_q{c}")), F.lit(0.0))
    cov = total(lambda c: mean(f"_iq{c}") - mean(f"_i{c}") * mean(f"_q{c}"))
    s = s.select(*AT, "others", *[mean(f"_{k}{c}").alias(f"m{k}_{c}") for k in "iq" for c in "bgr"], var_i.alias("var_i"), var_q.alias("var_q"), cov.alias("cov"))
    a = F.when(F.col("cov") > 1e-12, F.sqrt(F.col("var_q") / F.greatest(F.col("var_i"), F.lit(_EPS)))).otherwise(0.0)
    s = s.withColumn("a", a).withColumn("mean_i", total(lambda c: F.col(f"mi_{c}")) / 3).withColumn("mean_q", total(lambda c: F.col(f"mq_{c}")) / 3)
    return s.withColumn("b", F.col("mean_q") - F.col("a") * F.col("mean_i"))


def _ramp(depth: Column, start: float) -> Column:
    return P.clamp01((depth - start) / SHADOW_DEPTH_RAMP)


def _channel_spread(f) -> Column:
    return F.greatest(f("b"), f("g"), f("r")) - F.least(f("b"), f("g"), f("r"))


def cues(fit: DataFrame, veto: Column | None = None, weak: float = SHADOW_WEAK) -> DataFrame:
    """Depth and the two shadow cues of each compared cell.

    A shadow scales every channel alike; added light changes dark channels
    more. Where the colours cannot tell, the texture must fit, and ``veto``
    (the other side's own glare score) must be low. ``cue_grow`` starts at a
    third of the depth, to follow a shadow's soft edge.
    """
    low = lambda c: F.greatest(c, F.lit(_EPS))
    y_i = P.luminance(*[F.col(f"mi_{c}") for c in "bgr"])
    y_q = P.luminance(*[F.col(f"mq_{c}") for c in "bgr"])
    f = fit.withColumn("_yi", y_i).withColumn("_yq", y_q).withColumn("depth", 1 - F.col("_yi") / low(F.col("_yq")))
    fit_line = P.clamp01(1 - F.abs(F.col("b")) / (SHADOW_B_TOL * low(F.col("mean_q"))))
    textured = (F.col("cov") > 1e-12) & (F.col("cov") >= SHADOW_MIN_CORRELATION * F.sqrt(F.col("var_i") * F.col("var_q")))
    spread = _channel_spread(lambda c: F.log(low(F.col(f"mq_{c}"))) - F.log(low(F.col(f"mi_{c}"))))
    added = F.greatest(F.col("_yq") - F.col("_yi"), F.lit(0.0))
    expected = _channel_spread(lambda c: F.log(1 + added / low(F.col(f"mi_{c}"))))
    f = f.withColumn("_spread", spread).withColumn("_expected", expected)
    by_colour = P.clamp01(1 - F.col("_spread") / low(0.5 * F.col("_expected")))
    by_texture = F.when(textured, fit_line).otherwise(0.0)
    if veto is not None:
        by_texture = F.when(veto >= weak, 0.0).otherwise(by_texture)
    match = F.when(F.col("_yi") >= SHADOW_DARK_LEVEL, F.when(F.col("_expected") >= SHADOW_CHROMA_TOL, by_colour).otherwise(by_texture)).otherwise(0.0)
    f = f.withColumn("_match", match)
    return (
        f.withColumn("cue", _ramp(F.col("depth"), SHADOW_MIN_DEPTH) * F.col("_match"))
        .withColumn("cue_grow", _ramp(F.col("depth"), SHADOW_MIN_DEPTH / 3) * F.col("_match"))
        .drop("_yi", "_yq", "_spread", "_expected", "_match")
    )


def comparison_shadow(cells: DataFrame, gw: int, gh: int, glare: DataFrame | None = None, min_seed: int = 5, min_area: float = SHADOW_MIN_AREA) -> DataFrame:
    """Each shot's shadow areas where it overlaps other shots: (page_id, shot, y, x, value).

    ``glare`` (page_id, shot, y, x, score) holds back areas where the compared
    side looks glared; None skips that check.
    """
    k = max(3, int(round(0.015 * max(gw, gh))) | 1)
    fit = window_fit(with_references(cells), k // 2, gw, gh)
    veto = None
    if glare is not None:
        # Glare fades out softly, so the other side's score is widened before it holds anything back.
        wide = local_max_disk_at(glare, cells, SHOT, "score", max(1, int(round(GLARE_REACH * max(gw, gh)))), gw, gh, "wide")
        w = Window.partitionBy(*CELL)
        values = F.array_sort(F.collect_list("wide").over(w))
        n = F.size(values)
        middle = (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2
        other = F.when(n == 2, _other_of_two(values, F.col("wide"))).otherwise(middle)
        fit = fit.join(wide.select(*AT, other.alias("_veto")), AT, "left").fillna({"_veto": 0.0})
        veto = F.col("_veto")
    c = cues(fit, veto)
    if glare is not None:
        keep = 1 - P.clamp01(F.col("_veto"))
        c = c.withColumn("cue", F.col("cue") * keep).withColumn("cue_grow", F.col("cue_grow") * keep)
    c = c.filter((F.col("cue") > 0) | (F.col("cue_grow") > 0)).select(*AT, "cue", "cue_grow")
    return grown_from(c, SHOT, "cue", "cue_grow", SHADOW_SEED, SHADOW_WEAK, min_seed, min_area, gw, gh)


def reported_shadow(comparison: DataFrame, cue: DataFrame, alone: DataFrame, gw: int, gh: int, min_seed: int = 5, min_area: float = SHADOW_MIN_AREA) -> DataFrame:
    """A shot's shadow beyond what comparison saw: (page_id, shot, y, x).

    ``comparison`` are its shadow cells, ``cue`` (value) the single-image cue
    given as data, ``alone`` the cells no other shot covers. Shadows found by
    comparison grow into ``alone``; the cue counts by itself only from strong seeds.
    """
    from .components import grid_components

    seeds = comparison.select(*AT).distinct()
    weak = cue.filter(F.col("value") >= SHADOW_WEAK).join(alone.select(*AT), AT, "left_semi").select(*AT, F.lit(False).alias("_seed"))
    areas = grid_components(weak.unionByName(seeds.withColumn("_seed", F.lit(True))), SHOT, "_seed")
    beyond = areas.filter("held").select(*AT).join(seeds, AT, "left_anti")
    strong = grown(cue, cue, SHOT, SHADOW_SEED, SHADOW_WEAK, min_seed, min_area, gw, gh).filter(F.col("value") > 0).select(*AT)
    return beyond.unionByName(strong).distinct()
