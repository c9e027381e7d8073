"""Queries over the driver tables, one for each operator, and the SQL each is checked against.

Queries without SQL hold steps that DuckDB's patterns can't express (emphasis by look-around), that run in Python (MIME,
HTML, embedding) or the whole run; they are tested against worked cases instead.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import Settings
from weftline.functions import text as t
from weftline.functions import urls
from weftline.operators import components, decisions, prompts, segments, similarity
from weftline.operators import representative as rep
from weftline.plans import digest
from weftline.runtime import materialize, table
from weftline.sources import mail, runlog

# Unicode white space for RE2, which only knows the ASCII one.
_WS = r"\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# What Python and Java take for a word character.
_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{24b6}-\x{24e9}\x{200c}\x{200d}"
_LINK = t.LINK.replace("'", "''")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _solid(x: str) -> str:
    return f"length(regexp_replace({x}, '[{_WS}]', '', 'g'))"


def _piped(x: str) -> str:
    return f"coalesce((length({x}) - length(replace({x}, '|', ''))) / nullif({_solid(x)}, 0) > 0.15, true)"


def _bare(x: str) -> str:
    h = _strip(f"regexp_replace({x}, '^#+', '')")
    return f"coalesce(starts_with({x}, '#') AND NOT (starts_with({h}, '**') AND ends_with({h}, '**') AND length({h}) > 4), false)"


def _heading(x: str) -> str:
    return _strip(f"regexp_replace({x}, '^#+', '')")


def _wholly_bold(x: str) -> str:
    return f"(starts_with({x}, '**') AND ends_with({x}, '**') AND length({x}) > 4)"


def _titled(src: str) -> str:
    """Tables that end in ``titled``: the columns of ``src`` and its text ``x`` parted into ``title`` and ``body``."""
    after = lambda i: _strip(f"array_to_string(ls[{i} + 1:], chr(10))")
    return f"""lined AS (SELECT *, string_split(x, chr(10)) AS ls FROM {src}),
    placed AS (SELECT *, list_filter(list_transform(ls, lambda l, i: CASE WHEN {_strip("l")} <> '' THEN i END), lambda i: i IS NOT NULL) AS spots FROM lined),
    two AS (SELECT *, {_strip("ls[spots[1]]")} AS s1, coalesce({_strip("ls[spots[2]]")}, '') AS s2 FROM placed),
    titled AS (SELECT * EXCLUDE (ls, spots, s1, s2),
        nullif(CASE WHEN starts_with(s1, '#') THEN {_heading("s1")} WHEN {_wholly_bold("s1")} THEN {_strip("substr(s1, 3, length(s1) - 4)")} WHEN {_bare("s2")} THEN {_heading("s2")} END, '') AS title,
        CASE WHEN starts_with(s1, '#') OR {_wholly_bold("s1")} THEN {after("spots[1]")} WHEN {_bare("s2")} THEN {_strip(f"{_strip('array_to_string(ls[1:spots[2] - 1], chr(10))')} || chr(10) || chr(10) || {after('spots[2]')}")} ELSE x END AS body FROM two)"""


def _cleaned(src: str) -> str:
    """Tables that end in ``cleaned``: ``src`` with its text ``body`` cleaned."""
    solid = _strip("l")
    artefact = f"coalesce({solid} <> '' AND ({_piped(solid)} OR regexp_matches({solid}, '^\\|[{_WS}|]+[^{_WS}]')), false)"
    last = f"coalesce(list_max(list_filter(list_transform(ls, lambda l, i: CASE WHEN {artefact} THEN NULL ELSE i END), lambda i: i IS NOT NULL)), 0)"
    return f"""uncut AS (SELECT *, regexp_replace(body, '^\\|[{_WS}]*', '') AS cut FROM {src}),
    starred AS (SELECT * EXCLUDE (body, cut), regexp_replace(CASE WHEN {_strip("cut")} <> '' THEN cut ELSE body END, '\\*{{4,}}', '', 'g') AS body FROM uncut),
    ended AS (SELECT *, contains(body, '|') AS piped, string_split({_strip(f"regexp_replace(body, '([{_WS}]*\\|)+[{_WS}]*$', '')")}, chr(10)) AS ls FROM starred),
    kept AS (SELECT * EXCLUDE (body, ls, piped), CASE WHEN piped THEN array_to_string(ls[1:{last}], chr(10)) ELSE body END AS body FROM ended),
    cleaned AS (SELECT * EXCLUDE (body), array_to_string(list_transform(string_split({_strip("body")}, chr(10)), lambda y: regexp_replace(y, '[{_WS}]+$', '')), chr(10)) AS body FROM kept)"""


def _q(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


# Sources, sinks and the run log


def q_scan_range_cap(spark: SparkSession, d: str) -> DataFrame:
    return mail.select(_q(spark, d, "messages"), "Energy", dt.date(2025, 10, 1), dt.date(2026, 3, 31), 50).select("msg_pos", "msg_id", F.col("internal_date").cast("string").alias("internal_date"))


def q_latest_run(spark: SparkSession, d: str) -> DataFrame:
    return runlog.latest(_q(spark, d, "digest_runs")).select("id", "folder", "story_count", "output_json")


def q_run_by_id(spark: SparkSession, d: str) -> DataFrame:
    runs = _q(spark, d, "digest_runs")
    return runlog.by_id(runs, runs.agg(F.min("id")).first()[0]).select("id", "folder", "status", "story_count")


def q_run_states(spark: SparkSession, d: str) -> DataFrame:
    """Append-only log: a pending row and a final one for each run; the last one is its state."""
    runs = _q(spark, d, "digest_runs").select("id", "folder", "status", "story_count", F.lit(1).alias("seq"))
    log = runs.unionByName(runs.select("id", "folder", F.lit("pending").alias("status"), F.lit(0).alias("story_count"), F.lit(0).alias("seq")))
    return runlog.states(log)


def q_digest_json(spark: SparkSession, d: str) -> DataFrame:
    x = runlog.digest(_q(spark, d, "digest_runs").where("output_json IS NOT NULL"))
    return x.select("id", F.col("digest.folder").alias("folder"), F.col("digest.date_start").alias("date_start"), F.col("digest.story_count").alias("story_count"), F.get("digest.stories", F.lit(0))["title"].alias("first_title"), F.get("digest.stories", F.lit(0))["source_count"].alias("first_size"))


def q_pdf_name(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d, "digest_runs").select("id", digest.file_name(F.col("date_start"), F.col("id")).alias("filename"))


def q_stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return decisions.relationship_counts(_q(spark, d, "match_pairs"))


# Addresses


def _links(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d, "stories").select("rec_id", F.posexplode("links").alias("pos", "url"))


def q_url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("rec_id", "pos", urls.normalize_url(F.col("url")).alias("url"))


_NORMAL_URL = """lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) || '://' || lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1))
    || CASE WHEN regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') END
    || CASE WHEN len(good) > 0 THEN '?' || array_to_string(good, '&') ELSE '' END"""
_GOOD = f"""list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x LIKE '%=_%' AND NOT starts_with(x, 'utm_') AND NOT list_contains({urls.TRACKING!r}, split_part(x, '=', 1)))"""


def _variant(url: Column, n: Column) -> Column:
    return F.when(n % 4 == 0, F.lit("https://www.x.com/a")).when(n % 4 == 1, F.lit("https://m.facebook.com/b")).when(n % 4 == 2, F.concat(url, F.lit("/Unsubscribe"))).otherwise(url)


def q_url_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("rec_id", "pos", urls.is_boilerplate_url(_variant(F.col("url"), F.col("rec_id") + F.col("pos"))).alias("boilerplate"))


def q_boilerplate_link(spark: SparkSession, d: str) -> DataFrame:
    anchor = F.when(F.col("rec_id") % 5 == 0, F.lit(" Read More ")).when(F.col("rec_id") % 5 == 1, F.lit("Manage your subscriptions here")).otherwise(F.coalesce("title", F.lit("")))
    s = _q(spark, d, "stories").select("rec_id", F.posexplode("links").alias("pos", "url"), anchor.alias("anchor"))
    return s.select("rec_id", "pos", urls.is_boilerplate_link(F.col("url"), F.col("anchor")).alias("boilerplate"))


# Segmentation


def q_section_split(spark: SparkSession, d: str) -> DataFrame:
    return segments.split_sections(_q(spark, d, "stories").select("rec_id", F.col("body").alias("markdown")))


def _raw_sections(spark: SparkSession, d: str) -> DataFrame:
    s = _q(spark, d, "stories")
    w = F.concat(F.coalesce(F.concat(F.lit("# "), "title", F.lit("\n\n")), F.lit("")), F.col("body"))
    return segments.split_sections(s.select("msg_pos", "rec_id", w.alias("markdown"))).select("msg_pos", (F.col("rec_id") * 1000 + F.col("pos")).alias("pos"), "text")


def q_section_kind(spark: SparkSession, d: str) -> DataFrame:
    return _raw_sections(spark, d).select("msg_pos", "pos", segments.section_kind(F.col("text")).alias("kind"))


def q_reassembly(spark: SparkSession, d: str) -> DataFrame:
    return segments.reassemble(_raw_sections(spark, d))


_RAW = f"""raw AS (SELECT msg_pos, rec_id, regexp_split_to_array(coalesce('# ' || title || chr(10) || chr(10), '') || body, '(?m)\\n{{2,}}|^\\s*[-*_]{{3,}}\\s*$') AS parts FROM stories),
    sec AS (SELECT msg_pos, rec_id * 1000 + i AS pos, {_strip("part")} AS text FROM (SELECT msg_pos, rec_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS i FROM raw) WHERE {_strip("part")} <> ''),
    ln AS (SELECT *, list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {_strip("x")} <> '') AS ls, {_strip(f"regexp_replace(text, '{_LINK}', chr(92) || '1', 'g')".replace("chr(92) || '1'", "'\\1'"))} AS clean FROM sec),
    kinds AS (SELECT *, CASE WHEN {_bare("ls[1]")} OR {_bare("ls[2]")} THEN 'S' WHEN len(list_filter(ls, lambda x: NOT starts_with(x, '#'))) = 0 THEN 'H'
        WHEN clean = '' AND regexp_matches(text, '{_LINK}') THEN 'X' WHEN {_piped("clean")} OR length(clean) < 20 THEN 'B' END AS kind FROM ln)"""


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """Stories' links as a bullet list, one item a link, with a line before the first bullet."""
    s = _q(spark, d, "stories").where("size(links) > 0")
    item = lambda u: F.concat(F.lit("* ["), F.coalesce("title", F.lit("x")), F.lit("]("), u, F.lit(") by "), F.col("newsletter"))
    return s.where("title IS NULL OR NOT title RLIKE r'[\\[\\]*()\\n]'").select("rec_id", F.concat(F.lit("Quick links\n"), F.array_join(F.transform("links", item), "\n")).alias("text"))


def _listed_any(spark: SparkSession, d: str) -> DataFrame:
    """As ``_listed``, with every story that has links, whatever its title holds."""
    s = _q(spark, d, "stories").where("size(links) > 0")
    item = lambda u: F.concat(F.lit("* ["), F.coalesce("title", F.lit("x")), F.lit("]("), u, F.lit(") by "), F.coalesce("newsletter", F.lit("")))
    return s.select("rec_id", F.concat(F.lit("Quick links\n"), F.array_join(F.transform("links", item), "\n")).alias("text"))


def q_list_items_all(spark: SparkSession, d: str) -> DataFrame:
    items = _listed_any(spark, d).select("rec_id", F.posexplode(segments.list_items(F.col("text"))).alias("item_pos", "s"))
    return items.select("rec_id", "item_pos", "s.text", F.array_join(F.transform("s.links", lambda x: x["url"]), " ").alias("links"))


def q_links_of_all(spark: SparkSession, d: str) -> DataFrame:
    found = _listed_any(spark, d).select("rec_id", F.posexplode(segments.links_of(F.col("text"))).alias("pos", "l"))
    return found.select("rec_id", "pos", "l.url", "l.anchor_text")


def q_list_items(spark: SparkSession, d: str) -> DataFrame:
    items = _listed(spark, d).select("rec_id", F.posexplode(segments.list_items(F.col("text"))).alias("item_pos", "s"))
    return items.select("rec_id", "item_pos", "s.text", F.array_join(F.transform("s.links", lambda x: x["url"]), " ").alias("links"))


def q_links_of(spark: SparkSession, d: str) -> DataFrame:
    found = _listed(spark, d).select("rec_id", F.posexplode(segments.links_of(F.col("text"))).alias("pos", "l"))
    return found.select("rec_id", "pos", "l.url", "l.anchor_text")


_LISTED = "listed AS (SELECT rec_id, coalesce(title, 'x') AS title, newsletter, links FROM stories WHERE len(links) > 0 AND (title IS NULL OR NOT regexp_matches(title, '[\\[\\]*()\\n]')))"


def q_filters(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("body")
    n = F.size(F.regexp_extract_all(b, F.lit(t.LINK), F.lit(0)))
    return _q(spark, d, "stories").select("rec_id", t.pipe_share_over(b).alias("artefact"), t.is_segment_boilerplate(F.replace(b, F.lit("'"), F.lit("’"))).alias("boilerplate"), t.is_sparse(b, n + 3).alias("sparse"), (F.length(b) >= segments.MIN_SECTION).alias("long_enough"))


def q_title_body(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.when(F.col("rec_id") % 3 == 0, F.lit("LABEL\n\n# ")).when(F.col("rec_id") % 3 == 1, F.lit("**")).otherwise(F.lit("")), F.coalesce("title", F.lit("none")), F.when(F.col("rec_id") % 3 == 1, F.lit("**")).otherwise(F.lit("")), F.lit("\n"), F.col("body"))
    return _q(spark, d, "stories").select("rec_id", t.title_and_body(x).alias("p")).select("rec_id", "p.title", "p.body")


def q_body_clean(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d, "stories").select("rec_id", t.clean_body(F.concat(F.lit("| "), F.translate("body", "\xa0", " "), F.lit(" ****  \n| |  SUBSCRIBE\n | |"))).alias("body"))


def q_story_rows(spark: SparkSession, d: str) -> DataFrame:
    """Reassembled sections to titles and cleaned bodies: body fallback, artefacts and empty bodies out."""
    merged = segments.reassemble(_raw_sections(spark, d)).withColumn("item_pos", F.lit(0)).withColumn("links", F.array().cast("array<struct<url:string,anchor_text:string>>"))
    return segments.stories(merged).select("msg_pos", "sec_pos", "title", "body")


def q_body_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d, "stories").select("rec_id", t.normalize_body(F.col("body")).alias("body"))


def q_title_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d, "stories").select("rec_id", t.normalize_title(F.concat(F.lit("■ "), "title")).alias("title"))


def q_parse_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = segments.parse(materialize(mail.parse_mime(_q(spark, d, "messages"), spark.sparkContext.defaultParallelism), "mime"))
    return rows.withColumn("links", F.array_join("links", " "))


# Decisions


def _items(spark: SparkSession, d: str) -> DataFrame:
    return decisions.number(_q(spark, d, "documents").select("doc_id", "title", "text"), ["doc_id"], Settings.noise_batch)


def _noise(items: DataFrame) -> DataFrame:
    """Every seventh batch fails, every fifth answers one decision short, every third item has no key."""
    rule = decisions.RuleProvider({"is_noise": F.when(F.col("pos") % 3 > 0, F.coalesce(F.length("text"), F.lit(0)) < 200)}, ok=F.col("batch_no") % 7 != 3)
    return rule.decide(items).where("batch_no % 5 <> 4 OR pos > 0")


def q_excerpt_batches(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("doc_id", "batch_no", "pos", t.excerpt(F.col("text"), Settings.noise_chars).alias("excerpt"))


def q_noise_fail_open(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return decisions.drop_noise(items, _noise(items)).select("doc_id", "batch_no", "pos")


def _editorial(spark: SparkSession, d: str) -> DataFrame:
    items = decisions.number(rep.deduplicate(_q(spark, d, "cluster_stories")), ["cluster_pos"], Settings.filter_batch)
    rule = decisions.RuleProvider({"keep": F.length("body") > 400, "confidence": F.when(F.length("body") % 4 == 0, "borderline"), "reasoning": F.when(F.col("source_count") > 1, "several")}, ok=F.col("batch_no") % 6 != 5)
    return decisions.editorial(items, rule.decide(items))


def q_editorial(spark: SparkSession, d: str) -> DataFrame:
    return _editorial(spark, d).select("cluster_pos", "keep", "confidence", "reasoning")


def q_flags(spark: SparkSession, d: str) -> DataFrame:
    x = digest.flags(_editorial(spark, d))
    return x.select("decision", "confidence", "llm_reasoning", F.col("item.title").alias("title"), F.length("item.body").alias("chars"), F.col("item.link").alias("link"), F.col("item.date").alias("date"))


_REP = """r AS (SELECT *, row_number() OVER (PARTITION BY cluster_pos ORDER BY length(body) DESC, title IS NOT NULL DESC, len(links) > 0 DESC, member_pos) AS rn, count(*) OVER (PARTITION BY cluster_pos) AS n, min(nullif(date, '')) OVER (PARTITION BY cluster_pos) AS known FROM cluster_stories),
    m AS (SELECT cluster_pos, list(link ORDER BY pos) AS links FROM (SELECT cluster_pos, link, min((member_pos, i)) AS pos FROM (SELECT cluster_pos, member_pos, unnest(links) AS link, generate_subscripts(links, 1) AS i FROM cluster_stories) GROUP BY ALL) GROUP BY 1),
    rep AS (SELECT r.cluster_pos, title, body, coalesce(m.links, []) AS links, newsletter, coalesce(known, date) AS date, n::INT AS source_count FROM r LEFT JOIN m USING (cluster_pos) WHERE rn = 1)"""
_EDITED = f"""{_REP}, b AS (SELECT *, (row_number() OVER (ORDER BY cluster_pos) - 1) // 25 AS batch_no FROM rep),
    e AS (SELECT *, CASE WHEN batch_no % 6 <> 5 THEN length(body) > 400 ELSE true END AS keep, CASE WHEN batch_no % 6 <> 5 AND length(body) % 4 = 0 THEN 'borderline' ELSE 'high' END AS confidence, CASE WHEN batch_no % 6 <> 5 AND source_count > 1 THEN 'several' ELSE '' END AS reasoning FROM b)"""


def q_prompts(spark: SparkSession, d: str) -> DataFrame:
    return decisions.prompts(_items(spark, d), 100, "title", "text")


def q_item_prompts(spark: SparkSession, d: str) -> DataFrame:
    items = decisions.number(_q(spark, d, "cluster_stories").select("rec_id", "title", "body", "newsletter"), ["rec_id"], Settings.filter_batch)
    return prompts.item_prompts(items, Settings.filter_chars, "Story")


def q_pair_prompts(spark: SparkSession, d: str) -> DataFrame:
    c = _q(spark, d, "cluster_stories")
    pairs = components.pairs_in_cluster(c)
    for side, s in (("i", "a"), ("j", "b")):
        pairs = pairs.join(c.select("cluster_pos", F.col("member_pos").alias(side), *(F.col(x).alias(f"{x}_{s}") for x in ("title", "body", "newsletter"))), ["cluster_pos", side])
    return prompts.pair_prompts(decisions.number(pairs, ["cluster_pos", "i", "j"], Settings.pair_batch), Settings.pair_chars)


def q_read_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers as JSON, one a batch, every eleventh cut off; read back as decisions."""
    items = _items(spark, d)
    one = F.struct((F.length("text") < 200).alias("is_noise"))
    said = items.groupBy("batch_no").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("d")))), lambda x: x["d"]).alias("decisions")), {"ignoreNullFields": "false"}).alias("answer"))
    cut = said.select("batch_no", F.when(F.col("batch_no") % 11 == 10, F.substring("answer", 1, 20)).otherwise(F.col("answer")).alias("answer"))
    return prompts.read_answers(cut, "noise")


# Similarity and clusters


def q_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.cosine_pairs(_q(spark, d, "embeddings"), 0.4).where("i < j").select("i", "j", F.round("cos", 6).alias("cos"))


def q_communities(spark: SparkSession, d: str) -> DataFrame:
    return similarity.communities(materialize(similarity.cosine_pairs(_q(spark, d, "embeddings"), 0.35), "neighbours")).select("id", "center", "cluster_pos", "member_pos")


def q_pairs_in_cluster(spark: SparkSession, d: str) -> DataFrame:
    return components.pairs_in_cluster(_q(spark, d, "cluster_stories"))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within clusters with the latest judgement of their records; pairs never judged are different."""
    c = _q(spark, d, "cluster_stories").select("rec_id", "cluster_pos", "member_pos")
    pairs = components.pairs_in_cluster(c)
    for side in ("i", "j"):
        pairs = pairs.join(c.select("cluster_pos", F.col("member_pos").alias(side), F.col("rec_id").alias(f"rec_{side}")), ["cluster_pos", side])
    judged = _q(spark, d, "match_pairs").where("ci <> cj").groupBy(F.least("ci", "cj").alias("lo"), F.greatest("ci", "cj").alias("hi"))
    last = judged.agg(F.max(F.struct("decided_at", F.coalesce("relationship", F.lit("")).alias("relationship"))).alias("r"))
    joined = pairs.join(last, (F.least("rec_i", "rec_j") == F.col("lo")) & (F.greatest("rec_i", "rec_j") == F.col("hi")), "left")
    # Each pair is a batch; one judged without a result is a call that failed, one never judged an answer without the key.
    said = F.nullif("r.relationship", F.lit(""))
    items = materialize(decisions.number(joined.select("cluster_pos", "i", "j", said.alias("said"), (F.col("r").isNull() | said.isNotNull()).alias("ok")), ["cluster_pos", "i", "j"], 1), "judged-pairs")
    rule = decisions.RuleProvider({"relationship": F.col("said")}, ok=F.col("ok"))
    return decisions.relationships(items, rule.decide(items)).select("cluster_pos", "i", "j", "relationship")


_DECIDED = """p AS (SELECT x.cluster_pos, x.member_pos AS i, y.member_pos AS j, least(x.rec_id, y.rec_id) AS lo, greatest(x.rec_id, y.rec_id) AS hi FROM cluster_stories x JOIN cluster_stories y ON x.cluster_pos = y.cluster_pos AND x.member_pos < y.member_pos),
    judged AS (SELECT least(ci, cj) AS lo, greatest(ci, cj) AS hi, max((decided_at, coalesce(relationship, '')))[2] AS rel FROM match_pairs WHERE ci <> cj GROUP BY 1, 2),
    decided AS (SELECT cluster_pos, i, j, CASE WHEN judged.lo IS NULL THEN 'different' ELSE nullif(rel, '') END AS relationship FROM p LEFT JOIN judged USING (lo, hi))"""


def q_pair_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d)


def q_refine_components(spark: SparkSession, d: str) -> DataFrame:
    return components.refine(_q(spark, d, "cluster_stories"), materialize(_decided(spark, d), "decided"))


def q_merge_confirmed(spark: SparkSession, d: str) -> DataFrame:
    c = _q(spark, d, "cluster_stories")
    ends = c.select("rec_id", F.col("cluster_pos"))
    pairs = _q(spark, d, "match_pairs").where("relationship = 'same_story'").join(ends.withColumnsRenamed({"rec_id": "ci", "cluster_pos": "a"}), "ci").join(ends.withColumnsRenamed({"rec_id": "cj", "cluster_pos": "b"}), "cj")
    return components.merge_confirmed(c, pairs, a="a", b="b")


def q_representative(spark: SparkSession, d: str) -> DataFrame:
    return rep.deduplicate(_q(spark, d, "cluster_stories")).withColumn("links", F.array_join("links", " "))


def q_merge_links(spark: SparkSession, d: str) -> DataFrame:
    return rep.merge_links(_q(spark, d, "cluster_stories")).select("cluster_pos", F.array_join("links", " ").alias("links"), F.size("links").alias("n"))


def q_embedding(spark: SparkSession, d: str) -> DataFrame:
    return similarity.hashed_embedding(_q(spark, d, "cluster_stories").select("rec_id", "body")).select("rec_id", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


# Output


def q_story_html(spark: SparkSession, d: str) -> DataFrame:
    r = rep.deduplicate(_q(spark, d, "cluster_stories"))
    return r.select("cluster_pos", digest.story_html(F.col("title"), F.col("body"), F.col("newsletter"), F.col("date"), F.col("links"), F.lit(None).cast("string")).alias("html"))


def q_body_lines(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d, "cluster_stories").select("rec_id", F.posexplode(digest.body_lines(F.concat(F.lit("* "), "body"))).alias("pos", "l")).select("rec_id", "pos", "l.bullet", "l.text")


def q_display_links(spark: SparkSession, d: str) -> DataFrame:
    link = F.when(F.col("rec_id") % 2 == 0, F.lit("https://first.example/")).otherwise(digest.primary_link(F.col("links")))
    return _q(spark, d, "stories").select("rec_id", F.array_join(digest.display_links(F.col("links"), link), " ").alias("links"))


def q_digest(spark: SparkSession, d: str) -> DataFrame:
    """A whole run over all messages of all folders as one digest, with rule providers."""
    s = Settings()
    parsed = materialize(segments.parse(materialize(mail.parse_mime(_q(spark, d, "messages"), spark.sparkContext.defaultParallelism), "mime")), "stories")
    items = decisions.number(parsed, ["msg_pos", "sec_pos", "item_pos"], s.noise_batch)
    rule = decisions.RuleProvider({"is_noise": F.length("body") < 30})
    records = decisions.drop_noise(items, rule.decide(items)).withColumn("rec_pos", F.col("batch_no") * s.noise_batch + F.col("pos")).drop("batch_no", "pos")
    same = decisions.RuleProvider({"relationship": F.when((F.col("i") + F.col("j")) % 2 == 1, "same_story")})
    refined = digest.refine(materialize(digest.cluster(materialize(records, "records"), s), "clusters"), same, s)
    return digest.shape(rep.deduplicate(refined)).withColumn("links", F.array_join("links", " "))


_SQL = {
    "q_scan_range_cap": "SELECT msg_pos, msg_id, internal_date::VARCHAR AS internal_date FROM messages WHERE folder = 'Energy' AND internal_date >= DATE '2025-10-01' AND internal_date < DATE '2026-04-01' ORDER BY msg_pos LIMIT 50",
    "q_latest_run": "SELECT id, folder, story_count, output_json FROM digest_runs WHERE status = 'complete' ORDER BY run_at DESC, id DESC LIMIT 1",
    "q_run_by_id": "SELECT id, folder, status, story_count FROM digest_runs WHERE id = (SELECT min(id) FROM digest_runs)",
    "q_run_states": "SELECT id, folder, status, story_count FROM digest_runs",
    "q_digest_json": "SELECT id, output_json->>'$.folder' AS folder, output_json->>'$.date_start' AS date_start, (output_json->>'$.story_count')::INT AS story_count, output_json->>'$.stories[0].title' AS first_title, (output_json->>'$.stories[0].source_count')::INT AS first_size FROM digest_runs WHERE output_json IS NOT NULL",
    "q_pdf_name": "SELECT id, 'digest-' || coalesce(date_start::VARCHAR, id) || '.pdf' AS filename FROM digest_runs",
    "q_stage_counts": "SELECT count(*) AS pairs, count(*) FILTER (relationship = 'same_story') AS same, count(*) FILTER (relationship IS NULL) AS undecided FROM match_pairs",
    "q_url_normalize": f"SELECT rec_id, pos, {_NORMAL_URL} AS url FROM (SELECT *, {_GOOD} AS good FROM (SELECT rec_id, unnest(links) AS url, (generate_subscripts(links, 1) - 1)::INT AS pos FROM stories))",
    "q_url_boilerplate": f"""SELECT rec_id, pos, list_contains({urls.SOCIAL!r}, regexp_replace(lower(regexp_extract(v, '^[^:]+://([^/?#]*)', 1)), '^www\\.', '')) OR len(list_filter({urls.MANAGING!r}, lambda m: contains(lower(v), m))) > 0 AS boilerplate
        FROM (SELECT rec_id, pos, CASE (rec_id + pos) % 4 WHEN 0 THEN 'https://www.x.com/a' WHEN 1 THEN 'https://m.facebook.com/b' WHEN 2 THEN url || '/Unsubscribe' ELSE url END AS v FROM (SELECT rec_id, unnest(links) AS url, (generate_subscripts(links, 1) - 1)::INT AS pos FROM stories))""",
    "q_section_split": f"SELECT rec_id, (i - 1)::INT AS pos, {_strip('part')} AS text FROM (SELECT rec_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT rec_id, regexp_split_to_array(body, '(?m)\\n{{2,}}|^\\s*[-*_]{{3,}}\\s*$') AS parts FROM stories)) WHERE {_strip('part')} <> ''",
    "q_section_kind": f"WITH {_RAW} SELECT msg_pos, pos, kind FROM kinds",
    "q_reassembly": f"""WITH {_RAW}, st AS (SELECT *, last_value(CASE WHEN kind IN ('S', 'H', 'B') THEN kind END IGNORE NULLS) OVER w AS state, sum((kind IS NOT DISTINCT FROM 'S')::INT) OVER w AS story FROM kinds WINDOW w AS (PARTITION BY msg_pos ORDER BY pos ROWS UNBOUNDED PRECEDING))
        SELECT msg_pos, min(pos) AS sec_pos, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM st WHERE kind IS DISTINCT FROM 'H' GROUP BY msg_pos, CASE WHEN state = 'S' THEN story ELSE -pos - 1 END""",
    "q_title_body": f"""WITH src AS (SELECT rec_id, CASE rec_id % 3 WHEN 0 THEN 'LABEL' || chr(10) || chr(10) || '# ' WHEN 1 THEN '**' ELSE '' END || coalesce(title, 'none') || CASE rec_id % 3 WHEN 1 THEN '**' ELSE '' END || chr(10) || body AS x FROM stories), {_titled("src")}
        SELECT rec_id, title, body FROM titled""",
    "q_body_clean": f"""WITH src AS (SELECT rec_id, '| ' || replace(body, chr(160), ' ') || ' ****  ' || chr(10) || '| |  SUBSCRIBE' || chr(10) || ' | |' AS body FROM stories), {_cleaned("src")} SELECT rec_id, body FROM cleaned""",
    "q_story_rows": f"""WITH {_RAW}, st AS (SELECT *, last_value(CASE WHEN kind IN ('S', 'H', 'B') THEN kind END IGNORE NULLS) OVER w AS state, sum((kind IS NOT DISTINCT FROM 'S')::INT) OVER w AS story FROM kinds WINDOW w AS (PARTITION BY msg_pos ORDER BY pos ROWS UNBOUNDED PRECEDING)),
        merged AS (SELECT msg_pos, min(pos) AS sec_pos, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM st WHERE kind IS DISTINCT FROM 'H' GROUP BY msg_pos, CASE WHEN state = 'S' THEN story ELSE -pos - 1 END),
        src AS (SELECT msg_pos, sec_pos, replace({_strip("text")}, chr(160), ' ') AS x FROM merged WHERE {_strip("text")} <> ''), {_titled("src")},
        filled AS (SELECT msg_pos, sec_pos, title, CASE WHEN {_strip("body")} = '' THEN x ELSE body END AS body FROM titled), real AS (SELECT * FROM filled WHERE NOT {_piped("body")}), {_cleaned("real")}
        SELECT msg_pos, sec_pos, title, body FROM cleaned WHERE body <> ''""",
    "q_title_normalize": f"""WITH bold AS (SELECT rec_id, regexp_replace(regexp_replace(regexp_replace('■ ' || title, '\\*\\*([^*\\n]+)\\*\\*', '\\1', 'g'), '__([^_\\n]+)__', '\\1', 'g'), '\\*+', '', 'g') AS x FROM stories)
        SELECT rec_id, nullif({_strip(f"regexp_replace(regexp_replace(x, '^[^{_WORD}''\"(]+([^{_WS}])', '\\1'), '[ \\t]{{2,}}', ' ', 'g')")}, '') AS title FROM bold""",
    "q_body_lines": f"""WITH l AS (SELECT rec_id, list_filter(list_transform(string_split('* ' || body, chr(10)), lambda l: {_strip("l")}), lambda l: l <> '') AS ls FROM cluster_stories), e AS (SELECT rec_id, (generate_subscripts(ls, 1) - 1)::INT AS pos, unnest(ls) AS x FROM l)
        SELECT rec_id, pos, regexp_matches(x, '^[*-] ') AS bullet, regexp_replace(regexp_replace(x, '^[*-] ', ''), '[^\\x00-\\x7f\\x{{a0}}-\\x{{ff}}{t.CP1252}]', '', 'g') AS text FROM e""",
    "q_list_items": f"""WITH {_LISTED}, item AS (SELECT rec_id, title || ' by ' || newsletter AS text, url, i, {_GOOD} AS good FROM (SELECT rec_id, title, newsletter, unnest(links) AS url, generate_subscripts(links, 1) AS i FROM listed)),
        kept AS (SELECT rec_id, text, {_NORMAL_URL} AS links, (row_number() OVER (PARTITION BY rec_id ORDER BY i) - 1)::INT AS item_pos, count(*) OVER (PARTITION BY rec_id) AS n FROM item WHERE length({_strip("text")}) >= 30)
        SELECT rec_id, item_pos, {_strip("text")} AS text, links FROM kept WHERE n >= 2""",
    "q_links_of": f"""WITH {_LISTED}, one AS (SELECT rec_id, title, url, i, {_GOOD} AS good FROM (SELECT rec_id, title, unnest(links) AS url, generate_subscripts(links, 1) AS i FROM listed)),
        norm AS (SELECT rec_id, title, i, {_NORMAL_URL} AS url FROM one)
        SELECT rec_id, url, any_value(title) AS anchor_text, (row_number() OVER (PARTITION BY rec_id ORDER BY min(i)) - 1)::INT AS pos FROM norm GROUP BY rec_id, url""",
    "q_filters": f"""SELECT rec_id, {_piped("body")} AS artefact, len(list_filter({[s.replace("'", "’") for s in t.SEGMENT_SIGNALS]!r}, lambda s: contains(lower(replace(body, chr(39), '’')), s))) > 0 AS boilerplate,
        length(regexp_replace(body, '\\[([^\\]]*)\\]\\([^\\)]+\\)|[0-9.*#:{_WS}-]', '', 'g')) < 30 AS sparse, length(body) >= 20 AS long_enough FROM stories""",
    "q_excerpt_batches": "SELECT doc_id, n // 30 AS batch_no, n % 30 AS pos, left(text, 300) AS excerpt FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)",
    "q_noise_fail_open": """WITH x AS (SELECT doc_id, coalesce(length(text), 0) AS chars, n // 30 AS batch_no, n % 30 AS pos FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents))
        SELECT doc_id, batch_no, pos FROM x WHERE NOT (batch_no % 7 <> 3 AND batch_no % 5 <> 4 AND pos % 3 > 0 AND chars < 200)""",
    "q_editorial": f"WITH {_EDITED} SELECT cluster_pos, keep, confidence, reasoning FROM e",
    "q_flags": f"WITH {_EDITED} SELECT CASE WHEN keep THEN 'KEEP' ELSE 'DROP' END AS decision, confidence, reasoning AS llm_reasoning, title, length(body)::INT AS chars, links[1] AS link, date FROM e WHERE confidence = 'borderline'",
    "q_prompts": "SELECT n // 30 AS batch_no, string_agg('[' || (n % 30 + 1) || '] ' || coalesce('Title: ' || title || chr(10), '') || coalesce(left(text, 100), ''), chr(10) || chr(10) ORDER BY n) AS prompt FROM (SELECT title, text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) GROUP BY 1",
    "q_boilerplate_link": f"""SELECT rec_id, pos, list_contains({urls.ANCHORS!r}, lower(trim(a))) OR len(list_filter({urls.MANAGING!r}, lambda m: contains(lower(url), m))) > 0 OR len(list_filter({urls.ANCHOR_PARTS!r}, lambda m: contains(lower(a), m))) > 0 AS boilerplate
        FROM (SELECT rec_id, unnest(links) AS url, (generate_subscripts(links, 1) - 1)::INT AS pos, CASE rec_id % 5 WHEN 0 THEN ' Read More ' WHEN 1 THEN 'Manage your subscriptions here' ELSE coalesce(title, '') END AS a FROM stories)""",
    "q_item_prompts": "SELECT n // 25 AS batch_no, string_agg('Story ' || (n % 25 + 1) || chr(10) || coalesce('Title: ' || title || chr(10), '') || 'Newsletter: ' || newsletter || chr(10) || 'Body: ' || left(body, 300), chr(10) || chr(10) ORDER BY n) AS prompt, count(*)::INT AS n FROM (SELECT *, row_number() OVER (ORDER BY rec_id) - 1 AS n FROM cluster_stories) GROUP BY n // 25",
    "q_pair_prompts": """WITH p AS (SELECT x.title AS ta, x.body AS ba, x.newsletter AS na, y.title AS tb, y.body AS bb, y.newsletter AS nb, row_number() OVER (ORDER BY x.cluster_pos, x.member_pos, y.member_pos) - 1 AS k FROM cluster_stories x JOIN cluster_stories y ON x.cluster_pos = y.cluster_pos AND x.member_pos < y.member_pos)
        SELECT k // 20 AS batch_no, string_agg('Pair ' || (k % 20 + 1) || chr(10) || 'A' || chr(10) || coalesce('  Title: ' || ta || chr(10), '') || '  Newsletter: ' || na || chr(10) || '  Body: ' || left(ba, 350) || chr(10) || 'B' || chr(10) || coalesce('  Title: ' || tb || chr(10), '') || '  Newsletter: ' || nb || chr(10) || '  Body: ' || left(bb, 350), chr(10) || chr(10) ORDER BY k) AS prompt, count(*)::INT AS n FROM p GROUP BY 1""",
    "q_read_answers": """WITH x AS (SELECT length(text) < 200 AS is_noise, n // 30 AS batch_no, n % 30 AS pos FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents))
        SELECT batch_no, pos, true AS ok, is_noise FROM x WHERE batch_no % 11 <> 10 UNION ALL SELECT DISTINCT batch_no, 0, false, NULL::BOOLEAN FROM x WHERE batch_no % 11 = 10""",
    "q_cosine_pairs": "SELECT x.vec_id AS i, y.vec_id AS j, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cos FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.4",
    "q_communities": """WITH nb AS (SELECT x.vec_id AS i, y.vec_id AS j, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS cos FROM embeddings x, embeddings y WHERE x.vec_id = y.vec_id OR list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.35),
        s AS (SELECT *, count(*) OVER (PARTITION BY i) AS sz FROM nb), a AS (SELECT j AS id, i AS center, cos, sz FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY sz DESC, i) AS rn FROM s) WHERE rn = 1),
        h AS (SELECT center, row_number() OVER (ORDER BY count(*) DESC, any_value(sz) DESC, center) - 1 AS cluster_pos FROM a GROUP BY center)
        SELECT id, center, cluster_pos::INT AS cluster_pos, (row_number() OVER (PARTITION BY center ORDER BY round(cos, 9) DESC, id) - 1)::INT AS member_pos FROM a JOIN h USING (center)""",
    "q_pairs_in_cluster": "SELECT x.cluster_pos, x.member_pos AS i, y.member_pos AS j FROM cluster_stories x JOIN cluster_stories y ON x.cluster_pos = y.cluster_pos AND x.member_pos < y.member_pos",
    "q_pair_decisions": f"WITH {_DECIDED} SELECT * FROM decided",
    "q_refine_components": f"""WITH RECURSIVE {_DECIDED}, e AS (SELECT cluster_pos, i AS a, j AS b FROM decided WHERE relationship = 'same_story' UNION SELECT cluster_pos, j, i FROM decided WHERE relationship = 'same_story'),
        reach AS (SELECT cluster_pos, member_pos AS a, member_pos AS b FROM cluster_stories UNION SELECT reach.cluster_pos, reach.a, e.b FROM reach JOIN e ON e.cluster_pos = reach.cluster_pos AND e.a = reach.b),
        whole AS (SELECT cluster_pos, bool_or(relationship IS NULL) AS intact FROM decided GROUP BY 1),
        part AS (SELECT cluster_pos, a AS member_pos, CASE WHEN coalesce(any_value(intact), false) THEN 0 ELSE min(b) END AS part FROM reach LEFT JOIN whole USING (cluster_pos) GROUP BY 1, 2)
        SELECT cluster_pos, member_pos, (dense_rank() OVER (ORDER BY cluster_pos, part) - 1)::INT AS new_cluster, (row_number() OVER (PARTITION BY cluster_pos, part ORDER BY member_pos) - 1)::INT AS new_member FROM part""",
    "q_merge_confirmed": """WITH RECURSIVE c AS (SELECT x.cluster_pos AS a, y.cluster_pos AS b FROM match_pairs JOIN cluster_stories x ON x.rec_id = ci JOIN cluster_stories y ON y.rec_id = cj WHERE relationship = 'same_story' AND x.cluster_pos <> y.cluster_pos),
        e AS (SELECT a, b FROM c UNION SELECT b, a FROM c), reach AS (SELECT a AS root, a AS v FROM e UNION SELECT reach.root, e.b FROM reach JOIN e ON reach.v = e.a), label AS (SELECT root, min(v) AS v FROM reach GROUP BY 1)
        SELECT cluster_pos, member_pos, coalesce(label.v, cluster_pos) AS new_cluster FROM cluster_stories LEFT JOIN label ON root = cluster_pos""",
    "q_representative": f"WITH {_REP} SELECT cluster_pos, title, body, array_to_string(links, ' ') AS links, newsletter, date, source_count, source_count > 5 AS oversized FROM rep",
    "q_merge_links": f"WITH {_REP} SELECT cluster_pos, array_to_string(links, ' ') AS links, len(links)::INT AS n FROM m",
    "q_story_html": f"""WITH {_REP}, h AS (SELECT *, list_transform(links, lambda u: replace(replace(replace(replace(replace(u, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;'))[1:5] AS u FROM rep)
        SELECT cluster_pos, '<article><h2>' || replace(replace(replace(replace(replace(coalesce(nullif(title, ''), '(untitled)'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') || '</h2><p class="meta">'
        || replace(newsletter, '&', '&amp;') || ' &middot; ' || date || '</p><p>' || replace(replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') || '</p>'
        || CASE WHEN len(u) > 0 THEN '<p class="links">Resources:</p><ul>' || array_to_string(list_transform(u, lambda x, i: '<li><a href="' || x || '">Link ' || i || '</a></li>'), '') || '</ul>' ELSE '' END || '</article>' AS html FROM h""",
    "q_display_links": "SELECT rec_id, array_to_string((CASE WHEN rec_id % 2 = 0 THEN list_concat(['https://first.example/'], links) ELSE links END)[1:5], ' ') AS links FROM stories",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
