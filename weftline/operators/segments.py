"""Markdown of messages to story rows: split, reassembly, list items, links, filters and clean-up, all as Catalyst plans.

The only shuffle is the one by message for the reassembly window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import let
from weftline.functions import text as t
from weftline.functions.urls import is_boilerplate_url, normalize_url

SECTION_END = r"(?md)\n{2,}|^\s*[-*_]{3,}\s*$"
BULLET = r"(?mdU)^\s*[*\-]\s+"
MIN_SECTION, MIN_ITEM = 20, 30


def split_sections(df: DataFrame, markdown: str = "markdown") -> DataFrame:
    """One row per non-blank raw section: the message's columns, ``pos`` and ``text``."""
    keep = [c for c in df.columns if c != markdown]
    return df.select(*keep, F.posexplode(F.split(markdown, SECTION_END)).alias("pos", "_t")).select(*keep, "pos", t.strip(F.col("_t")).alias("text")).where("text <> ''")


def section_kind(text: Column) -> Column:
    """S story heading, H category heading, X links without text, B breaker, null for everything a story may absorb."""
    kind = lambda c: F.when((c == "") & F.contains(text, F.lit("](")), "X").when(t.pipe_share_over(c) | (F.length(c) < MIN_SECTION), "B")
    return F.when(t.is_story_heading(text), "S").when(t.is_heading_only(text), "H").otherwise(let(t.strip_links(text), kind))


def reassemble(sections: DataFrame, message: str = "msg_pos", keep: tuple[str, ...] = ()) -> DataFrame:
    """(message, keep, sec_pos, text), ``keep`` being columns of the message: a story heading takes the sections after it, up to the next heading or breaker.

    Gaps and islands: the last heading or breaker so far decides whether a row belongs to a story, and the number of
    headings so far says to which. Category headings go; everything else stands alone.
    """
    w = Window.partitionBy(message).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = sections.withColumn("kind", section_kind(F.col("text")))
    marked = kinds.withColumn("state", F.last(F.when(F.col("kind").isin("S", "H", "B"), F.col("kind")), True).over(w)).withColumn("story", F.sum(F.when(F.col("kind") == "S", 1).otherwise(0)).over(w))
    rows = marked.where("kind IS NULL OR kind <> 'H'").withColumn("unit", F.when(F.col("state") == "S", F.struct(F.lit(0).alias("alone"), F.col("story").cast("int").alias("n"))).otherwise(F.struct(F.lit(1).alias("alone"), F.col("pos").alias("n"))))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return rows.groupBy(message, "unit").agg(*(F.any_value(k).alias(k) for k in keep), F.min("pos").alias("sec_pos"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text")).drop("unit")


def links_of(text: Column) -> Column:
    """array<struct<url, anchor_text>>: normalised, without boilerplate, first-seen order, longest anchor of equal addresses."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(t.LINK), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(t.LINK), F.lit(2)).alias("u"))
    good = F.transform(F.filter(found, lambda x: ~is_boilerplate_url(x["u"])), lambda x: F.struct(normalize_url(x["u"]).alias("url"), x["a"].alias("anchor_text")))

    def best(g: Column) -> Column:
        urls = F.array_distinct(F.transform(g, lambda x: x["url"]))
        longest = lambda url: F.aggregate(g, F.lit(""), lambda acc, x: F.when((x["url"] == url) & (F.length(x["anchor_text"]) > F.length(acc)), x["anchor_text"]).otherwise(acc))
        return F.transform(urls, lambda u: F.struct(u.alias("url"), longest(u).alias("anchor_text")))

    none = F.array().cast("array<struct<url:string,anchor_text:string>>")
    return F.when(F.contains(text, F.lit("](")), let(good, best)).otherwise(none)


def list_items(text: Column) -> Column:
    """Bullet items of a section with their own links; null unless two kept items have one. Text before the first bullet goes."""
    raw = F.split(text, BULLET)
    items = F.transform(F.slice(raw, 2, F.greatest(F.size(raw) - 1, F.lit(0))), lambda x: F.struct(t.strip_links(t.strip(x)).alias("text"), links_of(x).alias("links")))
    kept = F.filter(items, lambda i: F.length(i["text"]) >= MIN_ITEM)
    return let(kept, lambda k: F.when(F.size(F.filter(k, lambda i: F.size(i["links"]) > 0)) >= 2, k))


def sections(merged: DataFrame, message: str = "msg_pos", keep: tuple[str, ...] = ()) -> DataFrame:
    """(message, keep, sec_pos, item_pos, text, links): filtered sections; aggregator lists become one row an item."""
    base = merged.withColumn("text", t.drop_leading_pipe(F.col("text"))).withColumn("items", F.when(F.regexp_count("text", F.lit(BULLET)) >= 2, list_items(F.col("text"))))
    whole = F.array(F.struct(t.strip_links(F.col("text")).alias("text"), links_of(F.col("text")).alias("links")))
    rows = base.select(message, *keep, "sec_pos", F.col("text").alias("raw"), F.col("items").isNotNull().alias("listed"), F.posexplode(F.coalesce("items", whole)).alias("item_pos", "s"))
    plain = ~t.is_sparse(F.col("raw"), F.size("s.links")) & (F.length("s.text") >= MIN_SECTION) & ~t.pipe_share_over(F.col("s.text"))
    return rows.where((F.col("listed") | plain) & ~t.is_segment_boilerplate(F.col("s.text"))).select(message, *keep, "sec_pos", "item_pos", "s.text", "s.links")


def stories(secs: DataFrame, message: str = "msg_pos", keep: tuple[str, ...] = ()) -> DataFrame:
    """(message, keep, sec_pos, item_pos, title, body, links): titles taken out, bodies cleaned, artefacts dropped."""
    parted = secs.where(t.strip(F.col("text")) != "").withColumn("p", t.title_and_body(F.translate(t.strip(F.col("text")), "\xa0", " ")))
    body = F.when(t.strip(F.col("p.body")) == "", F.translate(t.strip(F.col("text")), "\xa0", " ")).otherwise(F.col("p.body"))
    rows = parted.select(message, *keep, "sec_pos", "item_pos", "p.title", body.alias("body"), F.transform("links", lambda x: x["url"]).alias("links"))
    return rows.where(~t.pipe_share_over(F.col("body"))).withColumn("body", t.clean_body(F.col("body"))).where("body <> ''")


def parse(messages: DataFrame) -> DataFrame:
    """Story rows of parsed messages (``weftline.sources.mail.parse_mime``), in the schema of a story.

    Sender and date travel with the sections, so the messages are read once.
    """
    keep = ("newsletter", "date")
    readable = messages.where("html IS NOT NULL AND (plain IS NOT NULL OR has_text)")
    rows = stories(sections(reassemble(split_sections(readable.select("msg_pos", *keep, "markdown")), keep=keep), keep=keep), keep=keep)
    return rows.select("msg_pos", "sec_pos", "item_pos", "title", "body", "links", "newsletter", "date", F.lit(1).alias("source_count"))
