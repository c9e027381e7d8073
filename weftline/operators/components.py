"""Connected components by least-label propagation with pointer jumping, and the cluster operators built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.numbering import number_rows
from weftline.runtime import materialize, rows_of


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, label): the least vertex reachable from every vertex with an edge; null ends and self pairs join nothing.

    Each round takes the least label among the neighbours and then the label of that label, so long chains shorten
    geometrically; every round's labels are written to the shared folder.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    both = materialize(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("u").alias("vertex")).agg(F.min(F.least("u", "v")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("vertex", "v"), "v").groupBy(F.col("u").alias("vertex")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "vertex").select("vertex", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("vertex").alias("label"), F.col("label").alias("up"))
        new = materialize(stepped.join(up, "label").select("vertex", "old", F.least("label", "up").alias("label")), "cc-labels")
        if new.where("old <> label").isEmpty():
            return new.select("vertex", "label")
        labels = new.select("vertex", "label")


def pairs_in_cluster(df: DataFrame, cluster: str = "cluster_pos", member: str = "member_pos") -> DataFrame:
    """(cluster, i, j): every pair of members, i before j, of clusters with two or more."""
    x, y = df.select(cluster, F.col(member).alias("i")), df.select(cluster, F.col(member).alias("j"))
    return x.join(y, cluster).where("i < j")


def refine(clusters: DataFrame, decided: DataFrame, cluster: str = "cluster_pos", member: str = "member_pos", same: str = "same_story") -> DataFrame:
    """(cluster, member, new_cluster, new_member): clusters split into components of confirmed pairs.

    ``decided``: (cluster, i, j, relationship), null where undecided. A cluster with an undecided pair stays whole.
    """
    intact = decided.groupBy(cluster).agg(F.bool_or(F.col("relationship").isNull()).alias("intact"))
    same_edges = decided.where(F.col("relationship") == same).select(F.struct(cluster, F.col("i").alias("m")).alias("a"), F.struct(cluster, F.col("j").alias("m")).alias("b"))
    labels = components(same_edges).select(F.col(f"vertex.{cluster}").alias(cluster), F.col("vertex.m").alias(member), F.col("label.m").alias("part"))
    rows = clusters.select(cluster, member).join(intact, cluster, "left").join(labels, [cluster, member], "left")
    part = F.when(F.coalesce("intact", F.lit(False)), F.lit(0)).otherwise(F.coalesce("part", member))
    return _split(rows.select(cluster, member, part.alias("part")), cluster, member)


def _split(rows: DataFrame, cluster: str, member: str) -> DataFrame:
    """(cluster, member, new_cluster, new_member) from (cluster, member, part)."""
    heads = rows.select(cluster, "part").distinct()
    heads = number_rows(heads, [cluster, "part"], "new_cluster")
    return rows.join(heads, [cluster, "part"]).select(cluster, member, "new_cluster", (F.row_number().over(Window.partitionBy(cluster, "part").orderBy(member)) - 1).alias("new_member"))


def refine_by_rule(clusters: DataFrame, alike: Column, cluster: str = "cluster_pos", member: str = "member_pos", chunk_rows: int = 1024) -> tuple[DataFrame, int]:
    """:func:`refine` for a decision that is an expression over (cluster, i, j), and how many pairs it holds for, without a table of the pairs.

    Every pair is made and judged, then reduced to the least part that each part is joined with. Parts so joined become
    one; the pairs of clusters that changed and still have several parts are judged again, until none joins two parts.
    """
    n, same = 4 * clusters.sparkSession.sparkContext.defaultParallelism, None
    parts = materialize(clusters.select(cluster, member, F.col(member).alias("part")), "parts")
    changed = None
    while True:
        several = parts.groupBy(cluster).agg(F.count("*").alias("_n"), F.min("part").alias("_a"), F.max("part").alias("_b")).where("_a <> _b").select(cluster, F.ceil(F.col("_n") / chunk_rows).cast("int").alias("_n"))
        rows = parts.join(several if changed is None else several.join(changed, cluster, "left_semi"), cluster)
        # The members of a large cluster are cut into chunks, each of which meets all of them.
        left = rows.select(cluster, F.col(member).alias("_l"), F.col("part").alias("_p"), F.pmod(F.xxhash64(member), "_n").cast("int").alias("_c")).repartition(n, cluster, "_c")
        right = rows.select(cluster, F.col(member).alias("_r"), F.col("part").alias("_q"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_c")).repartition(n, cluster, "_c")
        met = left.join(right.hint("shuffle_hash"), [cluster, "_c"]).where("_p <> _q").select(cluster, F.least("_l", "_r").alias("i"), F.greatest("_l", "_r").alias("j"), "_p", "_q")
        near = materialize(met.where(alike).groupBy(cluster, "_p").agg(F.min("_q").alias("_q"), F.count("*").alias("_n")), "near-parts")
        if same is None:
            same = (near.agg(F.sum("_n")).first()[0] or 0) // 2
        if not rows_of(near):
            return _split(parts, cluster, member), same
        joined = components(near.select(F.struct(cluster, F.col("_p").alias("m")).alias("a"), F.struct(cluster, F.col("_q").alias("m")).alias("b")))
        to = joined.select(F.col(f"vertex.{cluster}").alias(cluster), F.col("vertex.m").alias("part"), F.col("label.m").alias("to"))
        parts = materialize(parts.join(to, [cluster, "part"], "left").select(cluster, member, F.coalesce("to", "part").alias("part")), "parts")
        changed = near.select(cluster).distinct()


def merge_confirmed(clusters: DataFrame, pairs: DataFrame, cluster: str = "cluster_pos", member: str = "member_pos", a: str = "ci", b: str = "cj") -> DataFrame:
    """(cluster, member, new_cluster): whole clusters joined by confirmed pairs of their numbers, transitively."""
    labels = components(pairs, a, b).withColumnRenamed("vertex", cluster)
    return clusters.select(cluster, member).join(labels, cluster, "left").select(cluster, member, F.coalesce("label", cluster).alias("new_cluster"))
