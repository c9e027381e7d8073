"""Problem 7: text that looks the same but is built from different characters gets one consistent form.

Every value that can change is mapped by :func:`weftline.llm.folding.fold`. Values of the whole table that share a
mapped form, those that need no mapping too, and mapped forms that are equal under the accent-sensitive Unicode
collation, which also disregards control characters, form one equivalence class in SQL. The class's canonical member is
a form that stands in the table as it is, if there is one, else a mapped one, the least by code point; so it doesn't
depend on partitioning or order. It is joined back to every member. Values without any such partner are never shuffled:
they are found by the hashes of the mapped forms, which are sent to the scan while they are few.

Defined results: null stays null, '' stays '', ASCII values are their own form (they never leave the scan), repeated
rows each get the form of their class, an empty table gives an empty result, extra columns are kept as they are.
Whole values are compared, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.folding import SUSPECT, fold
from weftline.runtime import bounded_broadcast, materialize, ship


@F.pandas_udf(T.StringType())
def fold_text(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in values:
        yield s.map(fold, na_action="ignore")


def suspect(c: Column) -> Column:
    """Only such values can change; evaluated by the JVM, so other texts never reach Python."""
    return c.rlike(SUSPECT)


def variants(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, text, canonical) of every value whose consistent form differs from it."""
    spark = df.sparkSession
    ship(spark)
    values = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("text")) for f in fields))
    each = df.select(F.col(f"`{key}`").alias(key), F.explode(values).alias("v")).select(key, "v.field", "v.text").where("text IS NOT NULL")
    # One scan: values that can change with their text, all others by a hash alone.
    odd = F.when(suspect(F.col("text")), F.col("text"))
    kept = each.select(key, "field", odd.alias("text"), F.when(odd.isNull(), F.xxhash64("text")).alias("h"))
    mapped = materialize(kept.withColumn("mapped", fold_text("text")), "lookalike")
    changed = mapped.where("mapped <> text").select(key, "field", "text", "mapped")
    forms = materialize(changed.select("mapped", F.xxhash64("mapped").alias("h")).distinct(), "lookalike-forms")
    # A plain value of a form's hash is that form as it stands in the table.
    plain = mapped.where("h IS NOT NULL OR mapped = text").select(F.coalesce("h", F.xxhash64("text")).alias("h"))
    plain = plain.join(bounded_broadcast(forms).select("h"), "h", "left_semi").distinct().withColumn("rank", F.lit(0))
    forms = forms.join(plain, "h", "left").select(F.col("mapped").alias("form"), F.coalesce("rank", F.lit(1)).alias("rank"))
    classes = spark.sql(
        "SELECT collate(form, 'UNICODE') AS class, min(struct(rank, form)).form AS canonical FROM {forms} GROUP BY collate(form, 'UNICODE')",
        forms=forms,
    )
    return spark.sql(
        f"SELECT m.`{key}`, m.field, m.text, c.canonical FROM {{changed}} m JOIN {{classes}} c ON collate(m.mapped, 'UNICODE') = c.class WHERE m.text <> c.canonical",
        changed=changed, classes=classes,
    )


def consistent(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``df`` with each of ``fields`` in its consistent form; other columns, nulls and row count stay."""
    found = variants(df, key, fields).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "canonical"))).alias("_forms"))
    out = df.join(found, key, "left")
    return out.select(*(F.coalesce(F.col("_forms")[c], F.col(f"`{c}`")).alias(c) if c in fields else F.col(f"`{c}`") for c in df.columns))
