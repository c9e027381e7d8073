"""Problem 4: one surviving record per group of duplicates.

Records are ranked by window ordering: completeness first (the distinct story text of the body), then trust (a
non-blank title, then a non-blank link), then the smallest position, so the order has no ties. Recency gives the record
its date: the earliest known one of the group.

Completeness is counted in letters of distinct sentences. Markup, comments, addresses, invisible characters and blank
runs are taken out first; a sentence counts once a body; and sentences found with at least ``notice_stories`` different
stories (and ``notice_share`` of their groups) are prompts and notices, which add nothing. A story that fills many groups
is told from a notice by the sentences around it, not by its frequency.

A group may hold a third of all rows: ranks are taken within (group, salt) first, so no task sorts a whole group, and
only the winners of the salts meet. Links are reduced to their first position before they are gathered.

Defined results: null bodies hold no text; null or blank titles and links count as missing; null or empty dates are
unknown, a group without any has ''; repeated rows count as members of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.folding import fold, letters
from weftline.runtime import bounded_broadcast, materialize, ship

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_SCRIPT = re.compile(r"<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>?")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\S+", re.I)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_SENTENCE = re.compile(r"(?<=[.!?…。])[\"'”“»)\]*_]*\s+|\s*\n\s*")


def sentences(body: str | None) -> list[tuple[str, int]]:
    """(letters, their number) of the distinct sentences of a body, without what adds no story text."""
    if not body:
        return []
    text = body
    if "<" in text:
        text = _TAG.sub(" ", _SCRIPT.sub(" ", _COMMENT.sub(" ", text)))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    text = _ADDRESS.sub(" ", fold(text))
    seen = dict.fromkeys(k for k in map(letters, _SENTENCE.split(text)) if k)
    return [(k, len(k)) for k in seen]


_SENTENCES = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType())]))


@F.pandas_udf(_SENTENCES)
def _sentences(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in bodies:
        yield s.map(sentences)


def survivors(
    df: DataFrame, group: str = "cluster_pos", member: str = "member_pos", key: str = "rec_id", body: str = "body", title: str = "title",
    links: str = "links", date: str = "date", notice_stories: int = 12, notice_share: float = 0.3, least: int = 2, salts: int = 16,
) -> DataFrame:
    """(group, key, date, links, source_count): the surviving record of every group of ``least`` or more members."""
    spark = df.sparkSession
    ship(spark)
    c = lambda n: F.col(f"`{n}`")
    kept = F.filter(F.coalesce(c(links), F.array().cast("array<string>")), lambda x: x.isNotNull() & x.rlike(r"\S"))
    members = df.select(
        c(group).alias("g"), c(key).alias("id"), c(member).alias("m"), F.coalesce(c(title).rlike(r"\S"), F.lit(False)).alias("titled"), kept.alias("links"),
        F.nullif(F.trim(c(date)), F.lit("")).alias("date"), F.transform(_sentences(c(body)), lambda s: F.struct(F.xxhash64(s["k"]).alias("h"), s["n"].alias("n"))).alias("text"),
    )
    members = materialize(members, "members")
    each = members.select("g", "id", "m", F.explode("text").alias("s")).select("g", "id", "m", "s.h", "s.n")
    pairs = each.select("h", "g").distinct()
    # A story's sentences keep the company of its other sentences, so the least hash of its groups takes few values; a notice's groups have as many as there are stories.
    story = each.groupBy("g").agg(F.min("h").alias("story"))
    company = pairs.join(story, "g").groupBy("h", "story").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("groups"), F.count("*").alias("stories"))
    notices = materialize(company.where((F.col("stories") >= notice_stories) & (F.col("stories") >= F.col("groups") * notice_share)).select("h"), "notices")
    complete = each.join(bounded_broadcast(notices), "h", "left_anti").groupBy("g", "id", "m").agg(F.sum("n").alias("complete"))
    ranked = members.join(complete, ["g", "id", "m"], "left").select("g", "id", "m", F.coalesce("complete", F.lit(0)).alias("complete"), "titled", (F.size("links") > 0).alias("linked"))
    order = [F.desc("complete"), F.desc("titled"), F.desc("linked"), "m", "id"]
    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("id", "m"), F.lit(salts)))
    best = salted.withColumn("r", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order))).where("r = 1")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where("r = 1").select("g", "id")
    facts = members.groupBy("g").agg(F.count("*").cast("int").alias("source_count"), F.coalesce(F.min("date"), F.lit("")).alias("date")).where(F.col("source_count") >= least)
    first = members.select("g", "m", F.posexplode("links").alias("i", "link")).groupBy("g", "link").agg(F.min(F.struct("m", "i")).alias("pos"))
    merged = first.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link"))), lambda x: x["link"]).alias("links"))
    out = facts.join(best, "g").join(merged, "g", "left")
    return out.select(F.col("g").alias(group), F.col("id").alias(key), "date", F.coalesce("links", F.array().cast("array<string>")).alias("links"), "source_count")
