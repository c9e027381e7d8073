"""Texts of the three decision stages and the reading of their answers; a provider adds the call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOISE = "Each item comes from a newsletter. Answer is_noise = true only for items that hold no news at all: subscription handling, slogans without facts, bare calls to act, greetings, polls. In doubt answer false."
PAIRS = "Each pair shows two items. Answer same_story when both report one event, related_but_distinct when they share a subject but not the event, different otherwise."
FIELDS = {"noise": "is_noise boolean", "pairs": "relationship string", "filter": "keep boolean, confidence string, reasoning string"}
ENUMS = {"relationship": ["same_story", "related_but_distinct", "different"], "confidence": ["high", "borderline"]}


def filter_text(folder: str) -> str:
    return f"The reader collects news about {folder}. Keep items that report something about it; answer borderline when unsure, with a short reason."


def answer_schema(stage: str) -> dict:
    """JSON schema of one answer: a list of decisions in input order."""
    kinds = {"boolean": "boolean", "string": "string"}
    props = {n: {"type": kinds[t]} | ({"enum": ENUMS[n]} if n in ENUMS else {}) for n, t in (f.split() for f in FIELDS[stage].split(", "))}
    return {"type": "object", "properties": {"decisions": {"type": "array", "items": {"type": "object", "properties": props, "required": list(props)}}}, "required": ["decisions"]}


def _story(title: Column, body: Column, newsletter: Column, chars: int, indent: str = "") -> Column:
    return F.concat(
        F.when(title.isNotNull(), F.concat(F.lit(f"{indent}Title: "), title, F.lit("\n"))).otherwise(F.lit("")),
        F.lit(f"{indent}Newsletter: "), F.coalesce(newsletter, F.lit("")), F.lit(f"\n{indent}Body: "), F.coalesce(F.substring(body, 1, chars), F.lit("")),
    )


def _join(items: DataFrame, head: str, block: Column) -> DataFrame:
    numbered = items.select("batch_no", "pos", F.concat(F.lit(f"{head} "), (F.col("pos") + 1).cast("string"), F.lit("\n"), block).alias("b"))
    return numbered.groupBy("batch_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "\n\n").alias("prompt"), F.count("*").cast("int").alias("n"))


def item_prompts(items: DataFrame, chars: int, head: str = "Item") -> DataFrame:
    """(batch_no, prompt, n): the numbered items of each batch, bodies cut to ``chars``."""
    return _join(items, head, _story(F.col("title"), F.col("body"), F.col("newsletter"), chars))


def pair_prompts(pairs: DataFrame, chars: int) -> DataFrame:
    """(batch_no, prompt, n) from pairs with title, body and newsletter of both sides (suffixes _a and _b)."""
    side = lambda s: _story(F.col(f"title_{s}"), F.col(f"body_{s}"), F.col(f"newsletter_{s}"), chars, "  ")
    return _join(pairs, "Pair", F.concat(F.lit("A\n"), side("a"), F.lit("\nB\n"), side("b")))


def read_answers(answers: DataFrame, stage: str) -> DataFrame:
    """(batch_no, pos, ok, decision columns) from (batch_no, answer): JSON read with the stage's fixed schema; an answer that can't be read makes a failed batch."""
    fields = FIELDS[stage]
    nested = ",".join(f.replace(" ", ":") for f in fields.split(", "))
    parsed = answers.withColumn("d", F.from_json("answer", f"struct<decisions:array<struct<{nested}>>>")["decisions"])
    rows = parsed.select("batch_no", F.col("d").isNotNull().alias("ok"), F.posexplode_outer("d").alias("pos", "x"))
    return rows.select("batch_no", F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), "ok", *(F.col(f"x.{f.split()[0]}").alias(f.split()[0]) for f in fields.split(", ")))
