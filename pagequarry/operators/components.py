"""Connected components: of grid cells, and of any graph.

The cells of one page layer are bounded by the grid itself (two integers for
each of at most 1000 x 1000 cells), so array operations on row runs label many
layers at a time; Spark spreads the layers. Graphs have no such bound: small ones are labelled the same way, large
ones run as rounds of joins over tables.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..limits import GRID_MAX_SIDE
from ..session import work_folder
from ..session import written as kept
from . import layers
from .ordered import _hot_groups, _with_keys

WHOLE_ROWS = 1 << 20  # nodes and edges of a graph that a task holds at once
_ROW = 1 << 12  # wider than any grid row, so that rows never meet in the run order


def _label_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """The component of each run, as the index of its first run in raster order. Runs come sorted by (y, x0)."""
    n = len(y)
    starts, ends = y * _ROW + x0 + 1, y * _ROW + x1 + 1
    lo = np.searchsorted(ends, (y + 1) * _ROW + x0, "left")
    hi = np.searchsorted(starts, (y + 1) * _ROW + x1 + 2, "right")
    touching = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), touching)
    b = np.arange(touching.sum()) - np.repeat(np.cumsum(touching) - touching, touching) + np.repeat(lo, touching)
    return _smallest(n, a, b)


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``n`` nodes that each can reach over the links of ``a`` and ``b``."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _label_cells(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The component of each cell, as the index of its first cell. Cells come sorted by (y, x), no two the same."""
    pos = y * _ROW + x
    if len(pos) == 0:
        return pos
    opens = np.ones(len(pos), bool)
    opens[1:] = pos[1:] != pos[:-1] + 1
    start = np.flatnonzero(opens)
    end = np.append(start[1:], len(pos)) - 1
    return np.repeat(start[_label_runs(y[start], x[start], x[end])], end - start + 1)


def label_layers(layer: np.ndarray, y: np.ndarray, x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """Component, its pixels and whether any cell of it is ``held``, for cells of many layers; cells may repeat."""
    # Rows of different layers are a row or more apart.
    pos, back = np.unique((layer * _ROW + y) * _ROW + x, return_inverse=True)
    first = _label_cells(pos // _ROW, pos % _ROW)
    pixels = np.bincount(first, minlength=len(pos))[first]
    some = np.zeros(len(pos), bool)
    some[first[back[held]]] = True
    component = pos[first] % (_ROW * _ROW)
    return component[back], pixels[back], some[first][back]


def grid_components(mask: DataFrame, keys: list[str], flag: str | None = None) -> DataFrame:
    """Each set cell with the id of its 8-connected component and that component's ``pixels``.

    The id is the raster position of the component's first cell
    (``y * 4096 + x``), unique within ``keys``. With ``flag``, a boolean column
    of the mask, ``held`` says whether any cell of the component has it.
    A cell without place stands alone.
    """
    held = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    cells = mask.select(*keys, "y", "x", held.alias("_held"))
    placed = F.col("y").isNotNull() & F.col("x").isNotNull()

    def label(l: layers.Layers) -> dict:
        component, pixels, held = label_layers(l.layer, l.y, l.x, l.table["_held"].to_numpy())
        _, first = np.unique((l.layer * _ROW + l.y) * _ROW + l.x, return_index=True)
        keep = np.zeros(len(component), bool)
        keep[first] = True  # a repeated cell counts once
        return {"component": component, "pixels": pixels, "held": held, "_keep": keep}

    added = {"component": "long", "pixels": "long", "held": "boolean"}
    out = layers.with_columns(cells.filter(placed), keys, label, added, GRID_MAX_SIDE, 1).drop("_held")
    alone = cells.filter(~placed).groupBy(*keys, "y", "x").agg(F.lit(None).cast("long").alias("component"), F.lit(1).cast("long").alias("pixels"), F.bool_or("_held").alias("held"))
    out = out.unionByName(alone)
    return out if flag else out.drop("held")


def graph_components(nodes: DataFrame, edges: DataFrame, keys: list[str], whole: int = WHOLE_ROWS) -> DataFrame:
    """The smallest node id each node can reach: (keys, node, component).

    ``nodes`` is (keys, node), ``edges`` (keys, a, b), taken as undirected; an edge to what is no node links nothing.
    The graphs of most keys are small: nodes and edges of keys with at most ``whole`` of both are hashed by key once, and
    a task labels some whole graphs at a time. The graphs of larger keys run as rounds of joins.
    """
    root, step = work_folder(nodes.sparkSession, "components"), itertools.count()
    written = lambda df: kept(df, f"{root}/{next(step)}")
    nodes, links = nodes.select(*keys, "node"), written(edges.select(*keys, "a", "b").dropna())
    if not isinstance(nodes.schema["node"].dataType, T.IntegralType):
        return _in_rounds(nodes, links, keys, written)
    hot = _hot_groups(nodes.select(*keys).unionByName(links.select(*keys)), keys, whole)
    if hot is None:
        return _in_arrays(nodes, links, keys)
    rest = _in_arrays(_with_keys(nodes, hot, keys, "left_anti"), _with_keys(links, hot, keys, "left_anti"), keys)
    return rest.unionByName(_in_rounds(_with_keys(nodes, hot, keys, "left_semi"), _with_keys(links, hot, keys, "left_semi"), keys, written))


def _in_arrays(nodes: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """``graph_components``, some whole graphs a call."""
    kind = nodes.schema["node"].dataType
    rows = nodes.select(*keys, F.col("node").cast("long").alias("_a"), F.lit(None).cast("long").alias("_b"), F.lit(False).alias("_link"))
    rows = rows.unionByName(links.select(*keys, F.col("a").cast("long").alias("_a"), F.col("b").cast("long").alias("_b"), F.lit(True).alias("_link")))
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("node", T.LongType()), T.StructField("component", T.LongType())])
    types = to_arrow_schema(schema)

    def label(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        graph = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        link, none = table["_link"].to_numpy(), table["_a"].is_null().to_numpy()
        a, b = (table[c].fill_null(0).to_numpy() for c in ("_a", "_b"))
        own = ~link & ~none
        # Numbered in order of graph and id, so that the smallest number is the smallest id.
        of, value = np.concatenate([graph[own], graph[link], graph[link]]), np.concatenate([a[own], a[link], b[link]])
        order = np.lexsort((value, of))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(of[order]) != 0) | (value[order][1:] != value[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        n, first = int(new.sum()), order[new]
        is_node = np.zeros(n, bool)
        is_node[number[: own.sum()]] = True
        one, two = number[own.sum() :].reshape(2, -1)
        both = is_node[one] & is_node[two]
        component = _smallest(n, one[both], two[both])
        named = np.flatnonzero(is_node)
        empty = np.unique(graph[~link & none])  # a node without id is one of its own
        ids = lambda v: pa.concat_arrays([pa.array(v, pa.int64()), pa.nulls(len(empty), pa.int64())])
        at = pa.array(np.concatenate([starts[of[first[named]]], starts[empty]]).astype(np.int64))
        out = {k: table[k].take(at) for k in keys} | {"node": ids(value[first[named]]), "component": ids(value[first[component[named]]])}
        yield from pa.table(out).cast(types).to_batches()

    out = layers.on_groups(rows, keys, label, schema)
    return out.select(*keys, F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))


def _in_rounds(nodes: DataFrame, links: DataFrame, keys: list[str], written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``graph_components`` of graphs of any size.

    Each round takes the smallest label among a node and its neighbours and then
    jumps to the label's own label, so long chains shrink quickly. Only nodes
    with an edge enter the rounds, and every round is cut by a table in the
    checkpoint folder, a fraction of a checkpoint's size. A label shared by many nodes is looked
    up once per distinct label, and adaptive execution splits the join back.
    """
    own = nodes.distinct()
    both = written(links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(own.join(both.select(*keys, F.col("a").alias("node")).distinct(), [*keys, "node"], "left_semi").withColumn("component", F.col("node")))
    while True:  # labels only fall, so it ends; rounds grow with the logarithm of the longest chain
        seen = both.join(labels.select(*keys, F.col("node").alias("b"), "component"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        low = labels.join(seen, [*keys, "node"], "left").select(*keys, "node", F.col("component").alias("_old"), F.least("component", F.coalesce("_near", "component")).alias("component"))
        low = written(low)
        if low.filter(F.col("component") < F.col("_old")).isEmpty():
            return own.join(low.select(*keys, "node", "component"), [*keys, "node"], "left").select(*keys, "node", F.coalesce("component", "node").alias("component"))
        wanted = low.select(*keys, F.col("component").alias("node")).distinct()
        jump = low.join(wanted, [*keys, "node"], "left_semi").filter(F.col("component") < F.col("node"))
        jump = jump.select(*keys, F.col("node").alias("component"), F.col("component").alias("_to"))
        labels = written(low.join(jump, [*keys, "component"], "left").select(*keys, "node", F.coalesce("_to", "component").alias("component")))
