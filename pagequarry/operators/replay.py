"""What-if replays: start from a few shots, add the shots a warning would prompt, and see what glare is left."""

from __future__ import annotations

import functools
from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..limits import GATE_REMOVED, GATE_UNWARNED, GLARE_SEEN, MIN_COVER, MIN_SINGLE_AREA, NO_GLARE, PROMPTS, SAME_PAGE_MAX_SCALE, SAME_PAGE_MIN_OVERLAP
from ..session import ensure_checkpoint_dir
from . import layers
from .catalog import spread_over
from .components import label_layers
from .ordered import first_k, spread_groups

RID = ["page_id", "rid"]


def page_area(cells: DataFrame) -> DataFrame:
    return cells.select("page_id", "y", "x").distinct().groupBy("page_id").agg(F.count(F.lit(1)).alias("area"))


def pair_shares(cells: DataFrame) -> DataFrame:
    """Every two shots of a page: shares of the page they cover together, both, and each alone at least."""
    own = cells.groupBy("page_id", "shot").agg(F.count(F.lit(1)).alias("n"))
    pairs = own.select("page_id", F.col("shot").alias("a"), F.col("n").alias("na")).join(own.select("page_id", F.col("shot").alias("b"), F.col("n").alias("nb")), "page_id").filter("a < b")
    # Shots sharing a cell, at most one page's shots, become pairs within the cell. A page is bounded by its grid and hashed once.
    shots = spread_groups(cells.select("page_id", "y", "x", "shot"), ["page_id"]).groupBy("page_id", "y", "x").agg(F.array_sort(F.collect_set("shot")).alias("s"))
    both = shots.select("page_id", "s", F.explode("s").alias("a")).select("page_id", "a", F.explode("s").alias("b")).filter("a < b").groupBy("page_id", "a", "b").agg(F.count(F.lit(1)).alias("both"))
    j = pairs.join(both, ["page_id", "a", "b"], "left").fillna({"both": 0}).join(shots.groupBy("page_id").agg(F.count(F.lit(1)).alias("area")), "page_id")
    return j.select(
        "page_id", "a", "b", ((F.col("na") + F.col("nb") - F.col("both")) / F.col("area")).alias("union"), (F.col("both") / F.col("area")).alias("overlap"),
        (F.least("na", "nb") / F.col("area") - F.col("both") / F.col("area")).alias("own"),
    )


def stitch_pairs(shares: DataFrame, limit: int = 6, min_union: float = 0.98, max_overlap: float = 0.5, min_own: float = 0.2) -> DataFrame:
    """Pairs that stitch the page, least overlap first, at most ``limit`` a page (the report's own top list)."""
    ok = shares.filter((F.col("union") >= min_union) & (F.col("overlap") < max_overlap) & (F.col("own") >= min_own))
    return first_k(ok, ["page_id"], ["overlap", "a", "b"], limit, "rank")


def whole_shots(cells: DataFrame, limit: int = 4, min_cover: float = 0.98) -> DataFrame:
    """Shots that cover the page on their own, at most ``limit``, spread over the capture order."""
    own = cells.groupBy("page_id", "shot").agg(F.count(F.lit(1)).alias("n")).join(page_area(cells), "page_id")
    return spread_over(own.filter(F.col("n") / F.col("area") >= min_cover).select("page_id", "shot"), ["page_id"], ["shot"], limit)


def prompted(boxes: DataFrame, cells: DataFrame, used: DataFrame, rule: Column | str, min_cover: float = MIN_COVER) -> DataFrame:
    """The unused shot a user aiming at a box would add: (page_id, rid, shot).

    ``boxes`` are box cells (page_id, rid, y, x), ``used`` (page_id, rid,
    shot). ``best`` covers most of the box; ``worst`` least, but at least
    ``min_cover`` of it, else the best. The lower index wins ties.
    """
    size = boxes.groupBy(*RID).agg(F.count(F.lit(1)).alias("_n"))
    cover = boxes.join(cells.select("page_id", "y", "x", "shot"), ["page_id", "y", "x"]).groupBy(*RID, "shot").agg(F.count(F.lit(1)).alias("_c"))
    free = cover.join(used, [*RID, "shot"], "left_anti").join(size, RID).withColumn("share", F.col("_c") / F.col("_n"))
    first = (-F.col("shot")).alias("first")
    pick = free.groupBy(*RID).agg(
        F.max_by("shot", F.struct("share", first)).alias("best"),
        F.min_by(F.when(F.col("share") >= min_cover, F.col("shot")), F.when(F.col("share") >= min_cover, F.struct("share", "shot"))).alias("least"),
    )
    r = F.lit(rule) if isinstance(rule, str) else rule
    return pick.select(*RID, "best", "least").withColumn("shot", F.when(r == "best", F.col("best")).otherwise(F.coalesce("least", "best")))


def same_page(overlap: Column, scale: Column) -> Column:
    """Why a composition does not count, null when it does."""
    return F.when((overlap < SAME_PAGE_MIN_OVERLAP) | (scale > SAME_PAGE_MAX_SCALE), "other_outline")


class DarkestComposer:
    """Takes the darkest shot of each cell; what exceeds the page's darkest by ``glare`` counts as glare.

    A composer takes compositions (page_id, rid, shot) and gives their glare cells (page_id, rid, y, x). One that also has
    ``cells``, ``value`` and ``seen`` is asked within the pages of a replay, so that its glare cells are never written out.
    """

    value = "lum"

    def __init__(self, cells: DataFrame, glare: float):
        self.cells, self.glare = cells, glare
        self.seen = functools.partial(_glare_over_darkest, glare=glare)

    def __call__(self, shots: DataFrame) -> DataFrame:
        reference = self.cells.groupBy("page_id", "y", "x").agg(F.min("lum").alias("_ref"))
        page = shots.join(self.cells, ["page_id", "shot"]).groupBy(*RID, "y", "x").agg(F.min("lum").alias("lum"))
        return page.join(reference, ["page_id", "y", "x"]).filter(F.col("lum") - F.col("_ref") >= self.glare).select(*RID, "y", "x")


def _glare_over_darkest(darkest: np.ndarray, members: np.ndarray, pages: np.ndarray, glare: float) -> np.ndarray:
    """Glare cells of compositions. ``darkest`` are the lowest values of shots and, behind them, of whole pages, NaN where there is none."""
    page = darkest[members[:, 0]]
    for m in members.T[1:]:
        page = np.fmin(page, darkest[m])
    return page - darkest[pages] >= glare


def darkest_composer(cells: DataFrame, glare: float) -> DarkestComposer:
    return DarkestComposer(cells, glare)


class _PageShots:
    """The shots of some pages as layers of cells: how often each covers a cell, and the lowest value there.

    Shots lie in order of page and index, the one without index behind the others of its page; one layer more has no cells.
    """

    def __init__(self, l: layers.Layers, value: bool):
        t, (pages, gh, gw) = l.table, l.shape
        cell = t["rid"].is_null().to_numpy()
        whole = pa.table({"page": l.layer, "y": l.y, "x": l.x, "gone": t["_gone"]}).filter(pa.array(cell))
        self.area = np.bincount(whole.group_by(["page", "y", "x", "gone"]).aggregate([])["page"].to_numpy(), minlength=pages)
        self.some = np.bincount(l.layer[cell], minlength=pages) > 0
        at = np.flatnonzero(cell & (l.y >= 0) & (l.y < gh) & (l.x >= 0) & (l.x < gw))
        shot, none = t["shot"].fill_null(0).to_numpy(), t["shot"].is_null().to_numpy()
        at = at[np.lexsort((shot[at], none[at], l.layer[at]))]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(l.layer[at]) != 0) | (np.diff(shot[at]) != 0) | (none[at][1:] != none[at][:-1])
        first = at[new]
        self.page, self.shot, self.unnamed, self.empty = l.layer[first], shot[first], none[first], len(first)
        place = ((np.cumsum(new) - 1) * gh + l.y[at]) * gw + l.x[at]
        self.count = np.bincount(place, minlength=(self.empty + 1) * gh * gw).reshape(-1, gh, gw)
        self.place = {(p, s): k for k, (p, s, n) in enumerate(zip(self.page.tolist(), self.shot.tolist(), self.unnamed.tolist())) if not n}
        upto = np.zeros((self.empty + 1, gh + 1, gw + 1), np.int64)
        upto[:, 1:, 1:] = self.count.cumsum(axis=1).cumsum(axis=2)
        self.upto = upto
        slot = np.arange(self.empty) - np.searchsorted(self.page, self.page)
        self.of_page = np.full((pages, max(slot.max(initial=0) + 1, 1)), self.empty)
        self.of_page[self.page, slot] = np.arange(self.empty)
        if value:
            v = l.column("_value")[at]
            darkest = np.full((self.empty + 1 + pages) * gh * gw, np.nan)
            np.fmin.at(darkest, place, v)
            np.fmin.at(darkest, ((self.empty + 1 + l.layer[at]) * gh + l.y[at]) * gw + l.x[at], v)
            self.darkest = darkest.reshape(-1, gh, gw)

    def prompted(self, page: np.ndarray, box: np.ndarray, used: np.ndarray, min_cover: float) -> tuple[list, list]:
        """As the operator ``prompted`` for boxes (y0, x0, y1, x1): the shots ``best`` and ``least``, None for none."""
        cand = self.of_page[page]
        y0, x0, y1, x1 = (c[:, None] for c in box.T)
        n = self.upto[cand, y1, x1] - self.upto[cand, y0, x1] - self.upto[cand, y1, x0] + self.upto[cand, y0, x0]
        free = (n > 0) & ~(cand[:, :, None] == used[:, None, :]).any(axis=2)
        share = n / ((y1 - y0) * (x1 - x0))
        unnamed = np.append(self.unnamed, False)[cand]
        row, best = np.arange(len(cand)), np.where(free, share, -1.0).argmax(axis=1)
        named = lambda k, some: [int(self.shot[c]) if ok else None for c, ok in zip(cand[row, k].tolist(), some & ~unnamed[row, k])]
        enough = free & (share >= min_cover)
        low = np.where(enough, share, np.inf)
        least = low.argmin(axis=1)
        # Without index comes first among equals here, last above.
        first = (enough & unnamed & (low == low.min(axis=1, keepdims=True))).any(axis=1)
        return named(best, free.any(axis=1)), named(least, enough.any(axis=1) & ~first)


def _fractions(size: int) -> np.ndarray:
    """``bround(i / size, 4)`` of each place of an axis."""
    return np.array([float(Decimal(repr(i / size)).quantize(Decimal("0.0001"), ROUND_HALF_EVEN)) for i in range(size + 1)])


def _largest_boxes(single: np.ndarray, min_area: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each layer of cells that one shot covers has a region (as ``single_regions``), and the box of the first (y0, x0, y1, x1) on the grid."""
    n, gh, gw = single.shape
    mask = layers.box_any(layers.box_all(single, 1), 1)
    mask = layers.box_all(layers.box_any(mask, 1), 1)
    layer, y, x = np.nonzero(mask)
    component, pixels, _ = label_layers(layer, y, x, np.zeros(len(y), bool))
    large = pixels / (gw * gh) >= min_area
    layer, y, x, component, pixels = (v[large] for v in (layer, y, x, component, pixels))
    _, first, region = np.unique((layer << 32) + component, return_index=True, return_inverse=True)
    box = np.array([[gh], [gw], [0], [0]]) + np.zeros((4, len(first)), np.int64)
    for k, (how, v) in enumerate(((np.minimum, y), (np.minimum, x), (np.maximum, y + 1), (np.maximum, x + 1))):
        how.at(box[k], region, v)
    order = np.lexsort((component[first], box[1], box[0], -pixels[first], layer[first]))
    owner, top = np.unique(layer[first][order], return_index=True)
    fy, fx = _fractions(gh), _fractions(gw)
    y0, x0, y1, x1 = box[:, order[top]]
    out = np.zeros((n, 4), np.int64)
    # From and to fractions as ``region_stats`` and ``box_fill`` do.
    out[owner] = np.stack([np.floor(fy[y0] * gh), np.floor(fx[x0] * gw), np.minimum(np.ceil(fy[y1] * gh), gh), np.minimum(np.ceil(fx[x1] * gw), gw)], axis=1)
    found = np.zeros(n, bool)
    found[owner] = True
    return found, out


def _replayed(l: layers.Layers, seen: Callable | None, prompts: int, min_area: float, min_cover: float) -> dict:
    """All replays of some pages: by column, a value for each replay of a page that has cells."""
    _, gh, gw = l.shape
    of = _PageShots(l, seen is not None)
    rows = np.flatnonzero(l.table["rid"].is_valid().to_numpy() & of.some[l.layer])
    t, page = l.table.take(pa.array(rows)), l.layer[rows]
    best, other = (t[c].to_pylist() for c in ("_best", "_other"))
    shots = [set(s) for s in t["_shots"].to_pylist()]
    added: list[list[list[int]]] = [[] for _ in rows]
    counts, left = np.zeros((prompts + 2, len(rows)), np.int64), np.zeros(len(rows), bool)
    covered, some = of.count > 0, max(1, layers.DENSE_CELLS // (gw * gh))
    lost, start = np.zeros((0, gh, gw), bool), np.zeros(len(rows), np.int64)
    for step in range(prompts + 1):
        # Replays of a page whose shots are the same are one composition.
        own = [(p, *sorted(of.place[p, s] for s in have if (p, s) in of.place)) for p, have in zip(page.tolist(), shots)]
        keys: dict[tuple, int] = {}
        which = np.array([keys.setdefault(k, len(keys)) for k in own], np.int64)
        members = np.full((len(keys), max([2, *map(len, keys)]) - 1), of.empty)
        for k, i in keys.items():
            members[i, : len(k) - 1] = k[1:]
        pages = np.array([k[0] for k in keys], np.int64)
        if step == 0:
            lost, start = np.zeros((len(keys), gh, gw), bool), which
        order = np.argsort(which, kind="stable")
        for a in range(0, len(keys), some):
            m, at = members[a : a + some], pages[a : a + some]
            mine = order[slice(*np.searchsorted(which[order], (a, a + some)))]
            single = sum(covered[k].astype(np.int16) for k in m.T) == 1
            if seen is not None:
                glare = seen(of.darkest, m, of.empty + 1 + at)
                if step == 0:
                    lost[a : a + some] = glare & single
                    counts[0, mine] = np.count_nonzero(glare, axis=(1, 2))[which[mine] - a]
                    counts[1, mine] = np.count_nonzero(lost[a : a + some], axis=(1, 2))[which[mine] - a]
                else:
                    for i in range(0, len(mine), some):
                        part = mine[i : i + some]
                        counts[step + 1, part] = np.count_nonzero(lost[start[part]] & glare[which[part] - a], axis=(1, 2))
            found, box = _largest_boxes(single, min_area)
            left[mine] = found[which[mine] - a]
            if step == prompts:
                continue
            most, least = [None] * len(m), [None] * len(m)
            for i, b, w in zip(np.flatnonzero(found).tolist(), *of.prompted(at[found], box[found], m[found], min_cover)):
                most[i], least[i] = b, b if w is None else w
            for i in mine.tolist():
                more = {s for s, by in ((most[which[i] - a], best[i]), (least[which[i] - a], other[i])) if by and s is not None}
                added[i].append(sorted(more))
                shots[i] |= more
    out = {"page_id": t["page_id"], "rid": t["rid"], "kind": t["kind"], "shots": pa.array([sorted(s) for s in shots], pa.list_(pa.int64())), "added": pa.array(added, pa.list_(pa.list_(pa.int64())))}
    out |= {"page_px": pa.array(of.area[page]), "glare_px": pa.array(counts[0]), "single_glare_px": pa.array(counts[1])}
    return out | {f"_left_{k + 1}": pa.array(counts[k + 2]) for k in range(prompts)} | {"warnings_left": pa.array(left)}


def replays(starts: DataFrame, cells: DataFrame, gw: int, gh: int, compose: Callable[[DataFrame], DataFrame], prompts: int = PROMPTS, min_area: float = MIN_SINGLE_AREA) -> DataFrame:
    """Run all replays at once: (page_id, rid, kind, rule, steps, page_px, glare_px, single_glare_px, removed_1.., left).

    ``starts`` is (page_id, rid, rule, shot), one row per starting shot. Each
    step finds the largest single-covered region of every composition, adds the
    prompted shot and goes on; a replay without such a region stays as it is.

    A page's cells and replays are hashed by page once and worked on together, so no composition's cells are shuffled.
    """
    within = getattr(compose, "cells", None) is cells
    shot = cells.select("shot").union(starts.select("shot")).schema["shot"].dataType
    rules = starts.dropna(subset=RID).select(*RID, "rule").distinct()
    is_best, listed = F.coalesce(F.col("rule") == "best", F.lit(False)), F.collect_set(F.col("shot").cast("long"))
    begun = starts.dropna(subset=RID).groupBy(*RID).agg(
        F.array_sort(listed).alias("_shots"), F.when(F.size(listed) + F.max(F.col("shot").isNull().cast("int")) == 2, "stitch").otherwise("single").alias("kind"), F.bool_or(is_best).alias("_best"), F.bool_or(~is_best).alias("_other")
    )
    value = F.col(compose.value).cast("double") if within else F.lit(None).cast("double")
    gone = F.col("y").isNull().cast("int") + 2 * F.col("x").isNull().cast("int")
    there = cells.dropna(subset=["page_id"]).select("page_id", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in "yx"], gone.alias("_gone"), F.col("shot").cast("long").alias("shot"), value.alias("_value"))
    none = {c: F.lit(None).cast(begun.schema[c].dataType).alias(c) for c in ("rid", "_shots", "kind", "_best", "_other")}
    blank = {c: (F.lit(-1) if c in "yx" else F.lit(None)).cast(there.schema[c].dataType).alias(c) for c in ("y", "x", "_gone", "shot", "_value")}
    both = there.select(*there.columns, *none.values()).unionByName(begun.select("page_id", *blank.values(), *none))
    long = ["page_px", "glare_px", "single_glare_px", *[f"_left_{k + 1}" for k in range(prompts)]]
    schema = T.StructType([both.schema["page_id"], *begun.select("rid", "kind").schema.fields, T.StructField("shots", T.ArrayType(T.LongType())), T.StructField("added", T.ArrayType(T.ArrayType(T.LongType())))])
    for c in long:
        schema = schema.add(c, "long")
    schema = schema.add("warnings_left", "boolean")
    types = to_arrow_schema(schema)
    seen = compose.seen if within else None
    run = lambda l: pa.table(_replayed(l, seen, prompts, min_area, MIN_COVER)).cast(types)
    out = layers.on_layers(both, ["page_id"], run, schema, gw, gh)
    if not within:
        out = _composed_apart(out, begun, cells.withColumn("shot", F.col("shot").cast("long")), compose, prompts)
    return out.join(rules, RID).select(
        *RID, "rule", "kind", F.col("shots").cast(T.ArrayType(shot)).alias("shots"), "page_px", "glare_px", "single_glare_px", *[(F.col("single_glare_px") - F.col(f"_left_{k + 1}")).alias(f"removed_{k + 1}") for k in range(prompts)], "warnings_left"
    )


def _composed_apart(done: DataFrame, begun: DataFrame, cells: DataFrame, compose: Callable[[DataFrame], DataFrame], prompts: int) -> DataFrame:
    """The replays ``done`` with the counts of a composer that works on tables."""
    ensure_checkpoint_dir(cells.sparkSession)
    at, done = [*RID, "y", "x"], done.checkpoint()
    counts = lambda df, n: df.groupBy(*RID).agg(F.count(F.lit(1)).alias(n))
    more = done.select(*RID, F.posexplode("added").alias("_step", "_more")).select(*RID, "_step", F.explode("_more").alias("shot"))
    first = begun.select(*RID, F.explode("_shots").alias("shot"))
    covered = first.join(cells.select("page_id", "shot", "y", "x"), ["page_id", "shot"])
    once = covered.groupBy(*at).agg(F.count_distinct("shot").alias("n")).filter("n = 1").select(*at)
    glare = compose(first).checkpoint()
    lost = glare.join(once, at, "left_semi").checkpoint()
    out = done.drop("glare_px", "single_glare_px", *[f"_left_{k + 1}" for k in range(prompts)])
    out = out.join(counts(glare, "glare_px"), RID, "left").join(counts(lost, "single_glare_px"), RID, "left")
    for k in range(1, prompts + 1):
        shots = first.unionByName(more.filter(F.col("_step") < k).select(*RID, "shot"))
        out = out.join(counts(lost.join(compose(shots), at, "left_semi"), f"_left_{k}"), RID, "left")
    return out.fillna(0, subset=["glare_px", "single_glare_px", *[f"_left_{k + 1}" for k in range(prompts)]])


def warned_measures(glare: DataFrame, single: DataFrame, warned: DataFrame, regions: DataFrame, keys: list[str], glare_seen: float = GLARE_SEEN) -> DataFrame:
    """Counts of one detector per replay: glare inside and outside its warnings, flagged regions and clean flagged ones.

    ``glare``, ``single``, ``warned`` are cells; ``regions`` are region cells
    with ``region`` and ``glare_seen``.
    """
    at = [*keys, "y", "x"]
    flagged = regions.filter(F.col("glare_seen") >= glare_seen)
    g = (
        glare.select(*at).join(single.select(*at, F.lit(True).alias("_s")).distinct(), at, "left")
        .join(warned.select(*at, F.lit(True).alias("_w")).distinct(), at, "left").join(flagged.select(*at, F.lit(True).alias("_f")).distinct(), at, "left")
    )
    s, w, f = F.col("_s").isNotNull(), F.col("_w").isNotNull(), F.col("_f").isNotNull()
    cells = g.groupBy(*keys).agg(
        F.count_if(w).alias("glare_in_warned_px"), F.count_if(s & ~w).alias("single_glare_unwarned_px"), F.count_if(~s & ~w).alias("overlap_glare_unwarned_px"), F.count_if(s & f).alias("single_glare_flagged_px")
    )
    lone = glare.select(*at).join(single.select(*at), at, "left_semi").withColumn("_g", F.lit(1))
    per_region = flagged.join(lone, at, "left").groupBy(*keys, "region").agg(F.count("_g").alias("g"), F.count(F.lit(1)).alias("n"))
    reg = per_region.groupBy(*keys).agg(F.count(F.lit(1)).alias("regions_flagged"), F.count_if(F.col("g") < NO_GLARE * F.col("n")).alias("regions_flagged_clean"))
    return cells.join(reg, keys, "full_outer").fillna(0)


def _rate(part: Column, whole: Column) -> Column:
    """A share, null when there is nothing to share."""
    return F.bround(F.when(whole > 0, F.try_divide(part, whole)), 4)


def summarised(results: DataFrame, prompts: int = PROMPTS) -> DataFrame:
    """Area-weighted shares over all replays of a rule, and over each kind of start of it (null kind: all)."""
    s = F.sum
    return results.groupingSets([["rule"], ["rule", "kind"]], "rule", "kind").agg(
        F.count(F.lit(1)).alias("replays"), _rate(s("single_glare_px"), s("page_px")).alias("single_glare"), _rate(s("glare_px"), s("page_px")).alias("glare"),
        *[_rate(s(f"removed_{k + 1}"), s("single_glare_px")).alias(f"removed_{k + 1}") for k in range(prompts)],
    )


def detector_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per detector the shares of glare inside and outside its warnings."""
    s = F.sum
    return results.groupBy(*keys).agg(
        _rate(s("glare_in_warned_px"), s("glare_px")).alias("glare_in_warned"), _rate(s("single_glare_unwarned_px"), s("glare_px")).alias("single_glare_unwarned"),
        _rate(s("overlap_glare_unwarned_px"), s("glare_px")).alias("overlap_glare_unwarned"), _rate(s("single_glare_flagged_px"), s("single_glare_px")).alias("single_glare_flagged"),
        s("regions_flagged").alias("regions_flagged"), _rate(s("regions_flagged_clean"), s("regions_flagged")).alias("flagged_clean"),
    )


def gate(removed: Column, unwarned: Column) -> Column:
    """Whether the prompts are enough: most single-shot glare removed, little left outside the warnings."""
    return removed.isNotNull() & (F.coalesce(removed, F.lit(0.0)) >= GATE_REMOVED) & (F.coalesce(unwarned, F.lit(0.0)) <= GATE_UNWARNED)
