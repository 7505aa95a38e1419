"""Operator 5: shards of even size by balanced label propagation. DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, saved

SHARDS = 40
#: Hash buckets of a shard, for quotas and for slots.
BUCKETS = 1024
#: A group above this share of a shard is dealt over shards as a block.
BLOCK_SHARE = 16
OVERHEAD = 16


def _by_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), shard + 1)


def _per_shard(df: DataFrame, shard: str, value: Column, shards: int) -> list[int]:
    """One number a shard (0 where it has none); ``shards`` numbers come to the driver, whatever the input."""
    out = [0] * shards
    for r in df.groupBy(shard).agg(value.alias("v")).collect():
        if r[0] is not None:
            out[r[0]] = int(r[1] or 0)
    return out


def _interval(position: Column, ends: list[int]) -> Column:
    """The first interval whose end lies above the position; ``ends`` ascend."""
    return F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e <= position))


def _ends(sizes: list[int]) -> list[int]:
    out, total = [], 0
    for s in sizes:
        total += s
        out.append(total)
    return out


def ranked(df: DataFrame, group: Column, order: list[str], name: str, weight: Column | None = None) -> DataFrame:
    """``df`` with the rank (from 0) of each row in its group by hash of ``order``, without one task for a group.

    Rows are numbered inside hash buckets, and a small table of bucket sizes gives where each bucket starts.
    With ``weight`` the rank is the weight of the rows before; ``order`` must then tell the rows of a group apart.
    """
    cut = df.withColumn("_g", group).withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int"))
    sizes = cut.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n") if weight is None else F.sum(weight).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("_g").alias("_sg"), F.col("_b").alias("_sb"), F.coalesce(before, F.lit(0)).alias("_start"))
    bucket = Window.partitionBy("_g", "_b").orderBy(F.xxhash64(*order), *order)
    inside = F.row_number().over(bucket) - 1 if weight is None else F.coalesce(F.sum(weight).over(bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("_in", inside).join(starts, (F.col("_g") == F.col("_sg")) & (F.col("_b") == F.col("_sb"))).withColumn(name, F.col("_start") + F.col("_in")).drop("_g", "_b", "_in", "_sg", "_sb", "_start")


def _cycles(arcs: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """How much of each arc lies on cycles, taken until no cycle is left; what goes in at a node goes out there."""
    left = dict(arcs)
    taken: dict[tuple[int, int], int] = {}

    def take(cycle: list[tuple[int, int]]) -> None:
        least = min(left[a] for a in cycle)
        for a in cycle:
            taken[a] = taken.get(a, 0) + least
            left[a] -= least

    for s, t in sorted(arcs):
        if s < t and (t, s) in left:
            take([(s, t), (t, s)])
    out: dict[int, list[int]] = {}
    for s, t in sorted(arcs):
        out.setdefault(s, []).append(t)
    for first in sorted(out):
        path = [first]
        while path:
            ways = out.get(path[-1], [])
            while ways and not left[path[-1], ways[-1]]:
                ways.pop()
            if not ways:  # no cycle leads through here any more
                path.pop()
                if path:
                    out[path[-1]].pop()
            elif ways[-1] in path:
                i = path.index(ways[-1])
                take(list(zip(path[i:], [*path[i + 1 :], path[i]], strict=True)))
                path = path[: i + 1]
            else:
                path.append(ways[-1])
    return taken


def granted(asked: dict[tuple[int, int, int], int], free: list[int]) -> dict[tuple[int, int, int], int]:
    """How many of the cells that ask to move, by (from, to, size), may do so at once without overfilling a shard.

    Cells of one size swap along cycles of shards, which changes no load; then free room takes further cells, and
    what these leave becomes free room. Nothing that is left could move on its own or swap with cells of its size.
    """
    sizes: dict[int, dict[tuple[int, int], int]] = {}
    for (s, t, n), k in asked.items():
        sizes.setdefault(n, {})[s, t] = k
    yes = {(s, t, n): k for n, arcs in sizes.items() for (s, t), k in _cycles(arcs).items() if k}
    left = {a: k - yes.get(a, 0) for a, k in sorted(asked.items(), key=lambda x: (-x[0][2], x[0]))}
    room, again = list(free), True
    while again:
        again = False
        for (s, t, n), k in left.items():
            some = min(k, room[t] // n)
            if some > 0:
                left[s, t, n] = k - some
                yes[s, t, n] = yes.get((s, t, n), 0) + some
                room[t] -= some * n
                room[s] += some * n
                again = True
    return yes


def propagate(cells: DataFrame, room: list[int], shards: int) -> DataFrame:
    """Moves the cells of groups to the shard that has most of their group, until nothing moves.

    ``cells`` (hub, start, shard, n) says how many members of a group (a star of links around its hub) begin in
    shard ``start`` and now lie in ``shard``; members of a cell are alike, so they move together. No shard may
    hold more than its room to begin with. In a round each group names the shard with most of its members, ties
    by a hash of the round; cells elsewhere ask to move there. ``granted`` nets what comes in against what goes
    out, so full shards swap, and of the cells that ask alike those of the least hashes go. Each move raises the
    sum of squared members a shard of its group, so rounds end by themselves. The driver holds one number for
    each (from, to, cell size) that occurs.
    """
    turn = 0
    while True:
        load = _per_shard(cells, "shard", F.sum("n"), shards)
        free = [r - x for r, x in zip(room, load, strict=True)]
        votes = cells.groupBy("hub", "shard").agg(F.sum("n").alias("v"))
        best = F.max(F.struct(F.col("v"), F.xxhash64("hub", "shard", F.lit(turn)).alias("tie"), F.col("shard")))
        named = votes.groupBy("hub").agg(best["shard"].alias("target"), F.count(F.lit(1)).alias("places")).where("places > 1").select(F.col("hub").alias("_hub"), "target")
        asked = saved(cells.join(named, F.col("hub") == F.col("_hub"), "left").drop("_hub"))
        asking = asked.where("target is not null and target <> shard")
        counts = asking.groupBy("shard", "target", "n").agg(F.count(F.lit(1)).alias("k")).collect()
        yes = granted({(r.shard, r.target, r.n): r.k for r in counts}, free)
        if not yes:
            return cells
        listed = F.from_json(F.lit(json.dumps([[*a, k] for a, k in yes.items()])), "array<array<bigint>>")
        rows = cells.sparkSession.range(1).select(F.explode(listed).alias("x")).select(*[F.col("x")[i].alias(c) for i, c in enumerate(("_from", "_to", "_size", "_most"))])
        ways = (F.col("shard") == F.col("_from")) & (F.col("target") == F.col("_to")) & (F.col("n") == F.col("_size"))
        able = asking.join(checked_broadcast(rows), ways).withColumn("_turn", F.lit(turn))
        going = ranked(able, F.struct("shard", "target", "n"), ["hub", "start", "_turn"], "_rank").where("_rank < _most").select(F.col("hub").alias("_hub"), F.col("start").alias("_start"), F.col("target").alias("_new"))
        here = (F.col("hub") == F.col("_hub")) & (F.col("start") == F.col("_start"))
        cells = saved(asked.join(going, here, "left").select("hub", "start", F.coalesce("_new", "shard").alias("shard"), "n"))
        turn += 1


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """Puts every document into a shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: the shards' row counts are at most one apart. Documents of equal text are linked. Groups
    too large for a sixteenth of a shard (at most 16 * shards of them) are laid as blocks along the shards;
    smaller ones start spread by hash and are drawn together by ``propagate``; the few that it leaves split are
    laid one after another along the free room, so that at most ``shards`` - 1 of all smaller groups are split.
    Documents without links fill what is left, by hash. Slots count from 0 in each shard without gaps.
    A null text has size 16, a null CRC and no links; repeated rows are rows like others; no rows give no rows.
    ``grown_shard`` is null, as the law isn't ``key``.
    """
    binary = F.col(text).cast("binary")
    alone = F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    narrow = saved(docs.select(
        "doc_id", (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"),
        F.unhex(F.coalesce(F.md5(binary), F.md5(alone.cast("binary")))).alias("hub"),
    ))
    n = narrow.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    groups = saved(narrow.groupBy("hub").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    least = max(2, n // shards // BLOCK_SHARE + 1)
    # At most BLOCK_SHARE * shards groups can be this large, so one task orders them and all executors may have them.
    before = F.sum("m").over(Window.orderBy(F.desc("m"), "hub").rowsBetween(Window.unboundedPreceding, -1))
    blocks = F.broadcast(saved(groups.where(F.col("m") >= least).select(F.col("hub").alias("_block"), F.col("m").alias("_m"), F.coalesce(before, F.lit(0)).alias("_from"))))
    split = narrow.join(blocks, F.col("hub") == F.col("_block"), "left")
    share = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(1 << 30)) / float(1 << 30)
    block_home = _interval(F.floor(F.col("_from") + share * F.col("_m")), _ends(quota))
    split = split.withColumn("home", F.when(F.col("_block").isNotNull(), F.least(block_home, F.lit(shards - 1)))).drop("_block", "_m", "_from")
    laid = saved(split)
    room = [max(0, q - x) for q, x in zip(quota, _per_shard(laid, "home", F.count("home"), shards), strict=True)]
    ends = _ends(room)
    small = groups.where(F.col("m") < least).select(F.col("hub").alias("_hub"))
    order = ["doc_id", "text_crc32", "size"]
    linked = saved(ranked(laid.where("home is null").join(small, F.col("hub") == F.col("_hub")).drop("_hub", "home"), F.lit(0), order, "position"))
    # Positions are dealt evenly over all room, so that no shard begins with more than its room.
    step = F.expr(f"cast(position as decimal(38, 0)) * {ends[-1]} div {max(1, linked.count())}")
    linked = saved(linked.withColumn("start", F.least(_interval(step, ends), F.lit(shards - 1))).drop("position"))
    cells = saved(linked.groupBy("hub", "start").agg(F.count(F.lit(1)).alias("n")).select("hub", "start", F.col("start").alias("shard"), "n"))
    found = propagate(cells, room, shards)
    whole = saved(found.groupBy("hub").agg(F.min("shard").alias("home"), F.countDistinct("shard").alias("places"), F.sum("n").alias("m")))
    settled = whole.where("places = 1")
    free = [r - x for r, x in zip(room, _per_shard(settled, "home", F.sum("m"), shards), strict=True)]
    loose = ranked(whole.where("places > 1").select("hub", "m"), F.lit(0), ["hub"], "_from", F.col("m")).select(F.col("hub").alias("_hub"), "_from")
    columns = ["doc_id", "size", "text_crc32", "home"]
    member = F.row_number().over(Window.partitionBy("hub").orderBy(*order)) - 1
    laid_last = linked.join(loose, F.col("hub") == F.col("_hub")).withColumn("home", _interval(F.col("_from") + member, _ends(free)))
    moved = linked.join(settled.select(F.col("hub").alias("_hub"), "home"), F.col("hub") == F.col("_hub")).select(*columns).unionByName(laid_last.select(*columns))
    single = laid.where("home is null").join(small, F.col("hub") == F.col("_hub"), "left_anti").select(*columns)
    homes = laid.where("home is not null").select(*columns).unionByName(moved)
    stay = saved(ranked(homes, F.col("home"), order, "slot"))
    fits = F.col("slot") < _by_shard(quota, F.col("home"))
    kept = [min(q, x) for q, x in zip(quota, _per_shard(stay, "home", F.count(F.lit(1)), shards), strict=True)]
    need = [q - k for q, k in zip(quota, kept, strict=True)]
    pool = ranked(stay.where(~fits).select(*columns).unionByName(single), F.lit(0), order, "position")
    pool = pool.withColumn("home", _interval(F.col("position"), _ends(need)))
    starts = [e - x for e, x in zip(_ends(need), need, strict=True)]
    pool = pool.withColumn("slot", F.col("position") - _by_shard(starts, F.col("home")) + _by_shard(kept, F.col("home")))
    whole = stay.where(fits).select(*columns, "slot").unionByName(pool.select(*columns, "slot"))
    return whole.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("home").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
