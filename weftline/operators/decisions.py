"""External decisions in batches, with fail-open joins.

A provider turns batches of items into decisions. Providers run once: their output is written before it is used, so a
lost task never repeats an external call that has been answered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.numbering import number_rows
from weftline.runtime import materialize


class DecisionProvider(Protocol):
    """``decide(items)``: (batch_no, pos, ok, decision columns) for numbered items; rows may be missing."""

    def decide(self, items: DataFrame) -> DataFrame: ...


class TableProvider:
    """Decisions computed elsewhere: a table with batch_no, pos and the decision columns; batches in ``failed`` returned an error."""

    def __init__(self, decisions: DataFrame, failed: list[int] | None = None) -> None:
        self.decisions, self.failed = decisions, failed or []

    def decide(self, items: DataFrame) -> DataFrame:
        return self.decisions.join(items.select("batch_no").distinct(), "batch_no", "left_semi").withColumn("ok", ~F.col("batch_no").isin(self.failed) if self.failed else F.lit(True))


class RuleProvider:
    """Deterministic decisions from expressions over the item's columns: name -> Column."""

    def __init__(self, rules: dict, ok=None) -> None:
        self.rules, self.ok = rules, ok

    def decide(self, items: DataFrame) -> DataFrame:
        return items.select("batch_no", "pos", *(c.alias(n) for n, c in self.rules.items()), (F.lit(True) if self.ok is None else self.ok).alias("ok"))

    def expression(self, items: DataFrame, name: str) -> Column | None:
        """The decision where it needs nothing but columns of ``items``, not yet numbered, and no call can fail; else None."""
        if self.ok is not None or name not in self.rules:
            return None
        try:
            items.select(self.rules[name])
        except AnalysisException:
            return None
        return self.rules[name]


class BatchProvider:
    """Calls ``answer(batch)`` once a batch in Python workers; it returns one decision dict an item, or None for a failed call. Other errors fail the job.

    With ``max_tokens``, the cap on an answer's length, ``answer(batch, max_tokens)`` is called. An answer that the cap cuts
    off has fewer decisions than items, so its batch isn't valid.
    """

    def __init__(self, answer: Callable[..., list[dict] | None], fields: str, max_tokens: int | None = None) -> None:
        self.answer, self.fields, self.max_tokens = answer, fields, max_tokens

    def decide(self, items: DataFrame) -> DataFrame:
        cap = () if self.max_tokens is None else (self.max_tokens,)
        answer, names = self.answer, [f.strip().split()[0] for f in self.fields.split(",")]

        def call(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("pos")
            said = answer(p.to_dict("records"), *cap)
            n = range(1) if said is None else range(len(said))
            return pd.DataFrame({"batch_no": p["batch_no"].iloc[0], "pos": list(n), "ok": said is not None} | {f: [None if said is None else said[i].get(f) for i in n] for f in names})

        return materialize(items.groupBy("batch_no").applyInPandas(call, f"batch_no long, pos long, ok boolean, {self.fields}"), "decisions")


def number(items: DataFrame, order: list[str], size: int) -> DataFrame:
    """``items`` with batch_no and pos by global position."""
    rows = number_rows(items, order, "_seq")
    return rows.withColumn("batch_no", F.floor(F.col("_seq") / size).cast("long")).withColumn("pos", F.col("_seq") % size).drop("_seq")


def fail_open(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """``items`` left-joined with the decisions of valid batches, and ``valid``.

    A batch is valid when its call succeeded and it has as many decisions as items; otherwise its decisions are null.
    """
    wanted = items.groupBy("batch_no").agg(F.count("*").alias("_items"))
    given = decisions.groupBy("batch_no").agg(F.count("*").alias("_given"), F.bool_and("ok").alias("_ok"))
    validity = wanted.join(given, "batch_no", "left").select("batch_no", F.coalesce(F.col("_ok") & (F.col("_given") == F.col("_items")), F.lit(False)).alias("valid"))
    names = [c for c in decisions.columns if c not in ("batch_no", "pos", "ok")]
    joined = items.join(validity, "batch_no").join(decisions.drop("ok"), ["batch_no", "pos"], "left")
    return joined.select(*items.columns, "valid", *(F.when(F.col("valid"), F.col(c)).alias(c) for c in names))


def drop_noise(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items not decided to be noise."""
    return fail_open(items, decisions).where(~F.coalesce("is_noise", F.lit(False))).select(*items.columns)


def editorial(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with keep, confidence and reasoning; missing keys of a valid batch mean kept with high confidence."""
    out = fail_open(items, decisions)
    return out.select(*items.columns, F.coalesce("keep", F.lit(True)).alias("keep"), F.coalesce("confidence", F.lit("high")).alias("confidence"), F.coalesce("reasoning", F.lit("")).alias("reasoning"))


def relationships(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs with their relationship: 'different' where a valid batch has none, null where the batch failed."""
    out = fail_open(pairs, decisions)
    return out.select(*pairs.columns, F.when(F.col("valid"), F.coalesce("relationship", F.lit("different"))).alias("relationship"))


def relationship_counts(pairs: DataFrame) -> DataFrame:
    """One row: pairs, those of the same story, those undecided."""
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("relationship") == "same_story").alias("same"), F.count_if(F.col("relationship").isNull()).alias("undecided"))


def prompts(items: DataFrame, chars: int, title: str = "title", body: str = "body") -> DataFrame:
    """(batch_no, prompt): numbered items of each batch with a bounded excerpt; a title line only where there is one."""
    line = F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] "), F.when(F.col(title).isNotNull(), F.concat(F.lit("Title: "), F.col(title), F.lit("\n"))).otherwise(F.lit("")), F.coalesce(F.substring(body, 1, chars), F.lit("")))
    return items.groupBy("batch_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("prompt"))
