"""One surviving story per cluster, as a single hash aggregation (no window, no sort of whole clusters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_key(body: Column, title: Column, links: Column, member_pos: Column) -> Column:
    """Longest body, then a title, then any link, then the first member."""
    return F.struct(F.length(body).alias("len"), title.isNotNull().alias("titled"), (F.size(F.coalesce(links, F.array().cast("array<string>"))) > 0).alias("linked"), (-member_pos).alias("first"))


def merge_links(df: DataFrame, cluster: str = "cluster_pos", order: str = "member_pos", links: str = "links") -> DataFrame:
    """(cluster, links): distinct links of all members in first-seen order.

    Each link is reduced to its first position before anything is gathered, so a huge cluster that repeats its links
    shuffles one row per distinct link and task.
    """
    each = df.select(cluster, order, F.posexplode(links).alias("link_pos", "link"))
    first = each.groupBy(cluster, "link").agg(F.min(F.struct(order, "link_pos")).alias("at"))
    return first.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "link"))), lambda x: x["link"]).alias(links))


def deduplicate(df: DataFrame, cluster: str = "cluster_pos", order: str = "member_pos", max_plain: int = 5) -> DataFrame:
    """One row per cluster: the representative's title, body and newsletter, the earliest known date, merged links, the cluster's size, and whether it is oversized."""
    best = F.max_by(F.struct("title", "body", "newsletter", "date"), rank_key(F.col("body"), F.col("title"), F.col("links"), F.col(order)))
    picked = df.groupBy(cluster).agg(best.alias("rep"), F.min(F.nullif(F.col("date"), F.lit(""))).alias("known"), F.count("*").cast("int").alias("source_count"))
    out = picked.join(merge_links(df, cluster, order), cluster, "left")
    return out.select(
        cluster, "rep.title", "rep.body", F.coalesce("links", F.array().cast("array<string>")).alias("links"), "rep.newsletter",
        F.coalesce("known", "rep.date").alias("date"), "source_count", (F.col("source_count") > max_plain).alias("oversized"),
    )
