"""Problem 3: pairwise matches consolidated into groups by low-diameter decomposition.

Each level draws a shift for every vertex from an exponential distribution (a hash of level and id, so a lost task draws
the same one again) and lets clusters grow: a vertex belongs to the centre whose start time plus distance is least. A few
rounds of growth are joins of the vertices with the edges and a least-value hash aggregation. Clusters become
super-vertices, edges inside them vanish, and the rest is one smaller graph with repeated edges removed. Levels repeat
until no edge is left. A level touches the super-vertices that still have edges and no other; the assignments of all
levels are composed once, from the last level down, so every vertex is relabelled once.

Any growth cut short still leaves a correct partition (a vertex only takes labels that reached it through edges), so the
result is exact for every diameter. Hubs: vertices with more than ``hub_edges`` edges and ``1 / hubs`` of all edge ends, so fewer than ``hubs`` of them, send their label to their edges by a broadcast of that bounded size instead of gathering the edges in one task, and
what any vertex receives is reduced in every task before the shuffle. Tables of a level are deleted when the next one is
written, but for its assignment.

Defined results: null ends, self pairs and other relationships join nothing; repeats and either order count once; the
group's id is the smallest member; records without a partner have no row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.runtime import Scratch, drop_path, materialize, rows_of


def _start(level: int, vertex: Column, rate: float) -> Column:
    """Start time of a cluster: minus an exponential shift, drawn from a hash of level and vertex."""
    unit = (F.pmod(F.xxhash64(F.lit(level), vertex), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    return F.log(unit) / F.lit(rate)


def _least(reached: DataFrame) -> DataFrame:
    """The earliest arrival at every vertex; both values are plain numbers, so this hashes."""
    return reached.groupBy("v").agg(F.min_by("c", "t").alias("c"), F.min("t").alias("t"))


def _grow(edges: DataFrame, level: int, rate: float, rounds: int, hubs: int, hub_edges: int, tmp: Scratch) -> DataFrame:
    """(v, c): the centre of every vertex that has an edge."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # The first step needs no join: a vertex that has not been reached yet starts from itself.
    first = both.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("a").alias("c"), F.lit(0.0).alias("d")), F.struct(F.col("b").alias("v"), F.col("a").alias("c"), F.lit(1.0).alias("d")))).alias("x")).select("x.v", "x.c", "x.d")
    state = _least(first.select("v", "c", (_start(level, F.col("c"), rate) + F.col("d")).alias("t")))
    plain, hot, hub = both, None, None
    if rounds > 1 and rows_of(edges) > hub_edges:
        most = max(hub_edges, 2 * rows_of(edges) // hubs)
        hub = tmp(both.groupBy("a").count().where(F.col("count") > most).select("a"), "ldd-hubs")
        if rows_of(hub):
            plain, hot = both.join(F.broadcast(hub), "a", "left_anti"), both.join(F.broadcast(hub), "a", "left_semi")
    for _ in range(rounds - 1):
        sent = plain.join(state, plain["a"] == state["v"]).select(F.col("b").alias("v"), "c", (F.col("t") + 1).alias("t"))
        if hot is not None:
            now = state.join(F.broadcast(hub), state["v"] == hub["a"], "left_semi")
            sent = sent.unionByName(hot.join(F.broadcast(now), hot["a"] == now["v"]).select(F.col("b").alias("v"), "c", (F.col("t") + 1).alias("t")))
        state = _least(state.unionByName(sent))
        if hot is not None:
            state = tmp(state, "ldd-state")
    return state.select("v", "c")


def components(edges: DataFrame, a: str = "a", b: str = "b", rate: float = 0.4, rounds: int = 2, hubs: int = 10_000, hub_edges: int = 10_000) -> DataFrame:
    """(vertex, group): the smallest vertex reachable from every vertex with an edge.

    ``rate``: of the exponential shifts of the first level; smaller means larger clusters. ``rounds``: steps of growth of
    the first level. As the graph shrinks by a factor a level, each level takes one step more, up to twice ``rounds``, and
    grows its clusters larger.
    """
    spark = edges.sparkSession
    pair = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    left = materialize(pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ldd-edges")
    levels: list[DataFrame] = []  # (v, c) of the vertices that had edges at each level
    while rows_of(left):
        tmp = Scratch(spark)
        grown = materialize(_grow(left, len(levels), rate / 2 ** min(len(levels), 2), min(rounds + len(levels), 2 * rounds), hubs, hub_edges, tmp), f"ldd-grown-{len(levels)}")
        levels.append(grown)
        contracted = left.join(grown.select(F.col("v").alias("a"), F.col("c").alias("x")), "a").join(grown.select(F.col("v").alias("b"), F.col("c").alias("y")), "b").where("x <> y")
        former = left
        left = materialize(contracted.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"ldd-edges-{len(levels)}")
        drop_path(spark, former._written[0])
        tmp.drop()
    if not levels:
        return pair.select(F.col("a").alias("vertex"), F.col("b").alias("group")).limit(0)
    labels = levels.pop()
    while levels:
        below = levels.pop()
        up = labels.select(F.col("v").alias("c"), F.col("c").alias("up"))
        labels = below.join(up, "c", "left").select("v", F.coalesce("up", "c").alias("c"))
    labels = materialize(labels, "ldd-labels")
    smallest = labels.groupBy("c").agg(F.min("v").alias("group"))
    return labels.join(smallest, "c").select(F.col("v").alias("vertex"), "group")


def groups(pairs: DataFrame, a: str = "ci", b: str = "cj", relationship: str = "relationship", same: str = "same_story") -> DataFrame:
    """(group_id, rec_id) of every record in a group of two or more."""
    found = components(pairs.where(F.col(relationship) == same), a, b)
    return found.select(F.col("group").alias("group_id"), F.col("vertex").alias("rec_id"))
