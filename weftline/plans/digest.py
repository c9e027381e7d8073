"""The whole run: messages to one digest, its JSON, flags and HTML."""

from __future__ import annotations

import datetime as dt
import json
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import Settings
from weftline.functions.text import cp1252, escape_html, normalize_body, normalize_title, strip
from weftline.operators import components, decisions, representative, segments, similarity
from weftline.runtime import materialize, rows_of
from weftline.sources import mail
from weftline.sources.runlog import RunLog

log_ = logging.getLogger(__name__)


@dataclass
class Providers:
    noise: decisions.DecisionProvider
    pairs: decisions.DecisionProvider
    filter: decisions.DecisionProvider


def primary_link(links: Column) -> Column:
    return F.try_element_at(links, F.lit(1))


def shape(kept: DataFrame, order_by: str = "cluster") -> DataFrame:
    """Digest rows in output order: presentation forms, first link, all links."""
    order = [F.col("date").asc(), "cluster_pos"] if order_by == "date" else ["cluster_pos"]
    return kept.orderBy(*order).select(normalize_title(F.col("title")).alias("title"), normalize_body(F.col("body")).alias("body"), primary_link(F.col("links")).alias("link"), "links", "newsletter", "date", F.col("source_count").cast("int").alias("source_count"))


def flags(decided: DataFrame) -> DataFrame:
    """Borderline decisions, kept or not."""
    item = F.struct("title", "body", primary_link(F.col("links")).alias("link"), "newsletter", "date")
    return decided.where("confidence = 'borderline'").select(F.when(F.col("keep"), "KEEP").otherwise("DROP").alias("decision"), "confidence", F.col("reasoning").alias("llm_reasoning"), item.alias("item"))


def write_flags(decided: DataFrame, path: str) -> None:
    flags(decided).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def display_links(links: Column, link: Column, cap: int | None = 5) -> Column:
    """All links with the single link first if it is missing; at most ``cap``."""
    out = F.when(link.isNotNull() & ~F.array_contains(links, link), F.concat(F.array(link), links)).otherwise(links)
    return F.slice(out, 1, cap) if cap else out


def story_html(title: Column, body: Column, newsletter: Column, date: Column, links: Column, link: Column) -> Column:
    """One story's block."""
    items = F.transform(display_links(links, link), lambda u, i: F.concat(F.lit('<li><a href="'), escape_html(u), F.lit('">Link '), (i + 1).cast("string"), F.lit("</a></li>")))
    listed = F.when(F.size(items) > 0, F.concat(F.lit('<p class="links">Resources:</p><ul>'), F.array_join(items, ""), F.lit("</ul>"))).otherwise(F.lit(""))
    name = F.coalesce(F.nullif(title, F.lit("")), F.lit("(untitled)"))
    return F.concat(F.lit("<article><h2>"), escape_html(name), F.lit('</h2><p class="meta">'), escape_html(newsletter), F.lit(" &middot; "), date, F.lit("</p><p>"), escape_html(body), F.lit("</p>"), listed, F.lit("</article>"))


def body_lines(body: Column) -> Column:
    """array<struct<bullet, text>>: non-blank lines for a printed page."""
    rows = F.filter(F.transform(F.split(body, "\n"), strip), lambda x: x != "")
    return F.transform(rows, lambda x: F.struct(x.rlike(r"^[*-] ").alias("bullet"), cp1252(F.regexp_replace(x, r"^[*-] ", "")).alias("text")))


def page(digest: dict, blocks: list[str]) -> str:
    """The digest as one HTML page; ``blocks`` are its stories' blocks in order."""
    esc = lambda s: str(s or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    head = f"<h1>Digest &mdash; {esc(digest.get('folder'))}</h1><p>{esc(digest.get('date_start'))} to {esc(digest.get('date_end'))} &middot; {len(blocks)} stories</p>"
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Digest</title></head><body>{head}{"".join(blocks)}</body></html>'


def file_name(date_start: Column, run_id: Column, suffix: str = "pdf") -> Column:
    """The name a run's file is offered under, for a table of runs."""
    return F.concat(F.lit("digest-"), F.coalesce(date_start.cast("string"), run_id), F.lit(f".{suffix}"))


def filename(date_start: str | None, run_id: str, suffix: str = "pdf") -> str:
    return f"digest-{run_id if date_start is None else date_start}.{suffix}"


def to_pdf(source: str) -> bytes:
    """PDF by whichever renderer is installed; both errors in the message when none works."""
    try:
        import weasyprint

        return weasyprint.HTML(string=source).write_pdf()
    except Exception as first:
        try:
            import io
            import re

            from reportlab.lib.styles import getSampleStyleSheet
            from reportlab.platypus import Paragraph, SimpleDocTemplate

            out, style = io.BytesIO(), getSampleStyleSheet()["BodyText"]
            SimpleDocTemplate(out).build([Paragraph(x, style) for x in re.findall(r"<(?:h1|h2|p|li)[^>]*>(.*?)</(?:h1|h2|p|li)>", source, re.S)])
            return out.getvalue()
        except Exception as second:
            raise RuntimeError(f"PDF rendering failed: {first}; {second}") from second


def cluster(records: DataFrame, settings: Settings, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Records (with rec_pos) plus cluster_pos and member_pos by threshold communities of their embeddings.

    ``embed``: records -> (rec_pos, embedding), for a model of one's own; without it words are hashed.
    """
    embedded = embed(records) if embed else similarity.hashed_embedding(records, chars=settings.encode_chars)
    found = similarity.vector_communities(embedded.select("rec_pos", "embedding"), settings.similarity, "rec_pos")
    own = records.select("rec_pos").join(found, records["rec_pos"] == found["id"], "left")
    # Records without any word have no vector: each is a cluster of its own, after the others.
    return records.join(own.select("rec_pos", F.coalesce("cluster_pos", F.col("rec_pos") + (1 << 40)).alias("cluster_pos"), F.coalesce("member_pos", F.lit(0)).alias("member_pos")), "rec_pos")


def refine(clustered: DataFrame, provider: decisions.DecisionProvider, settings: Settings) -> DataFrame:
    """Clusters split by the provider's decisions on their pairs; how many pairs were judged alike is logged.

    A rule over the pair alone is applied where pairs are made. All others are numbered into batches and written.
    """
    pairs = components.pairs_in_cluster(clustered)
    rule = provider.expression(pairs, "relationship") if isinstance(provider, decisions.RuleProvider) else None
    if rule is not None:
        parts, same = components.refine_by_rule(clustered, rule == "same_story")
        made = clustered.groupBy("cluster_pos").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
        log_.info("pairs judged: %d, same story: %d, undecided: %d", made, same, 0)
    else:
        pairs = materialize(decisions.number(pairs, ["cluster_pos", "i", "j"], settings.pair_batch), "pairs")
        decided = materialize(decisions.relationships(pairs, materialize(provider.decide(pairs), "pair-decisions")), "relationships")
        n = decisions.relationship_counts(decided).first()
        log_.info("pairs judged: %d, same story: %d, undecided: %d", n["pairs"], n["same"], n["undecided"])
        parts = components.refine(clustered, decided)
    return clustered.join(parts, ["cluster_pos", "member_pos"]).drop("cluster_pos", "member_pos").withColumnsRenamed({"new_cluster": "cluster_pos", "new_member": "member_pos"})


def build(messages: DataFrame, folder: str, start: dt.date, end: dt.date, providers: Providers, log: RunLog, settings: Settings | None = None, flags_path: str | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, require_folder: bool = False, counts: dict[str, int] | None = None) -> dict:
    """Run every stage, record the run and return the digest. An error marks the run as failed and is raised again.

    ``embed``: see :func:`cluster`. ``require_folder``: a folder that isn't there is an error of the run that names those
    there are; else it is an empty one. ``counts`` receives the rows after each stage, which are logged too; they come
    with the writes of the stages and cost no job.
    """
    settings, counts = settings or Settings(), {} if counts is None else counts

    def counted(stage: str, df: DataFrame) -> DataFrame:
        counts[stage] = rows_of(df)
        log_.info("%s: %d", stage, counts[stage])
        return df

    chosen = mail.select(messages, folder, start, end, settings.max_messages)
    run = log.begin(folder, start, end)
    try:
        if require_folder:
            mail.check_folder(messages, folder.strip())
        read = counted("messages", materialize(mail.parse_mime(chosen, messages.sparkSession.sparkContext.defaultParallelism), "mime"))
        parsed = counted("parsed", materialize(segments.parse(read), "stories"))
        items = materialize(decisions.number(parsed, ["msg_pos", "sec_pos", "item_pos"], settings.noise_batch), "noise-items")
        records = decisions.drop_noise(items, materialize(providers.noise.decide(items), "noise-decisions")).withColumn("rec_pos", F.col("batch_no") * settings.noise_batch + F.col("pos")).drop("batch_no", "pos")
        records = counted("after noise", materialize(records, "records"))
        clustered = materialize(cluster(records, settings, embed), "clusters")
        counts["clusters"] = clustered.select("cluster_pos").distinct().count()
        refined = refine(clustered, providers.pairs, settings)
        chosen_rows = materialize(decisions.number(representative.deduplicate(refined), ["cluster_pos"], settings.filter_batch), "representatives")
        decided = materialize(decisions.editorial(chosen_rows, materialize(providers.filter.decide(chosen_rows), "filter-decisions")), "decided")
        counted("representatives", chosen_rows)
        if flags_path:
            write_flags(decided, flags_path)
        # A digest is one document of at most a few hundred stories.
        rows = [r.asDict() for r in shape(decided.where("keep")).collect()]
        digest = {"id": run["id"], "generated_at": run["run_at"].strftime("%Y-%m-%dT%H:%M:%SZ"), "folder": folder, "date_start": start.isoformat(), "date_end": end.isoformat(), "story_count": len(rows), "stories": rows}
        counts |= {"kept": len(rows), "dropped": counts["representatives"] - len(rows), "borderline": decided.where("confidence = 'borderline'").count()}
        log_.info("kept %(kept)d, dropped %(dropped)d, borderline %(borderline)d", counts)
        log.complete(run, len(rows), json.dumps(digest))
        return digest
    except Exception as error:
        log.fail(run, error)
        raise
