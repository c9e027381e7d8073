"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import groups, house_lines, lookalikes, markup, packing, page_templates, residue, story_index, survivors, tokens
from weftline.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return story_index.repeats(table(spark, d, "stories"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return page_templates.furniture(table(spark, d, "page_stories"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.groups(table(spark, d, "match_pairs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "cluster_stories")).select("cluster_pos", "rec_id", "date")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.residues(table(spark, d, "stories"), "rec_id", ["title", "body"]).select("rec_id", "field")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean(table(spark, d, "stories").select("rec_id", "title", "body"), ["title", "body"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return house_lines.repeated_lines(table(spark, d, "stories"), "rec_id", "newsletter", "body")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.variants(table(spark, d, "stories"), "rec_id", ["title", "body"]).select("rec_id", "field")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id")


_SQL = {
    "p3_found": """
        WITH RECURSIVE e AS (SELECT ci AS a, cj AS b FROM match_pairs WHERE relationship = 'same_story' AND ci <> cj UNION SELECT cj, ci FROM match_pairs WHERE relationship = 'same_story' AND ci <> cj),
        r AS (SELECT a AS root, a AS v FROM e UNION SELECT r.root, e.b FROM r JOIN e ON r.v = e.a)
        SELECT min(v) AS group_id, root AS rec_id FROM r GROUP BY root""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
