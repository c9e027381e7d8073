"""Problem 2: the article of a page without the furniture around it, by equivalence-class template deduction.

Every non-blank line gives tokens in four roles: the whole line with numbers and link targets masked (L), its opening up
to a separator (S), its first two words (W) and the name of its own site (N); every link outside the text gives its host (U). A token's occurrence
vector over the pages of its host is kept as two numbers, page count and an order-free hash of the page ids, so a host
with a third of all pages is pre-aggregated in every task and no vector is ever gathered.

1. Tokens of one host with equal vectors form an equivalence class.
2. A class is valid when one of its tokens is too frequent for prose on its host and, unless very frequent, missing
   from most comparable hosts (same language): prose frames and section heads are spread evenly over all hosts, while
   page furniture is one host's choice.
3. Nesting is kept to single lines, positions and order of classes are not compared: a line's opening belongs to the template of the line when their vectors are equal, and an
   opening that is valid on its own leaves the rest of the line as a slot (a teaser's title, a breadcrumb's last step).
4. Lines with a token of a valid class are furniture. Lines are then ordered around it: an ending (last two words) whose
   lines nearly always stand right before furniture or the page's end is nested in the template, as its closing note
   (about the author and the like), when the lower bound of that share, given how often it was seen, reaches
   ``note_share``. What is left is the article.

Defined results: null or empty bodies give no lines; a page's own headline is never furniture; hosts with fewer than
``min_pages`` matching pages have no template; null sites form one host; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import let
from weftline.runtime import bounded_broadcast, materialize

# Function words that tell the language of a host.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "for"],
    "de": ["der", "die", "und", "für", "von", "nicht"],
    "es": ["el", "los", "las", "por", "que", "una"],
    "fr": ["le", "les", "des", "et", "pour", "une"],
}


def _empty() -> Column:
    return F.array().cast("array<string>")



def mask(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"\]\([^)]*\)", "]()"), r"\d+(?:[.,]\d+)*", "0"))


def _opening(masked: Column) -> Column:
    """Up to the first separator within the first five words, or a leading list number; null without one."""
    o = F.regexp_extract(masked, r"^(?:0[.)](?=\s)|(?:[^\s\[:]+ ?){0,4}?[^\s\[:]*:(?=\s)|(?:[^\s\[|/»>—–·]+ ){1,3}[|/»>—–·](?=\s))", 0)
    return F.when(masked.rlike(r"^(?:0[.)]|[^:|/»>—–·]{0,120}[:|/»>—–·])"), F.nullif(o, F.lit("")))


def _names(site: Column) -> Column:
    """What a line may call its own site: the host, or its label as words."""
    label = F.lower(F.regexp_extract(site, r"^(?:www\.)?([^.]+)", 1))
    both = F.array(F.lower(site), F.when(F.contains(label, F.lit("-")), F.replace(label, F.lit("-"), F.lit(" "))))
    return F.filter(both, lambda n: n.isNotNull())


def _self_reference(line: Column, names: Column) -> Column:
    """Names its own site outside a link target."""
    within = lambda text: F.exists(names, lambda n: F.contains(text, n))
    return F.when(within(F.lower(line)), within(F.lower(F.regexp_replace(line, r"\]\([^)]*\)|https?://\S+", "]")))).otherwise(False)


def _languages(body: Column) -> Column:
    """struct with the number of function words of each language."""
    among = lambda ws: lambda w: w.isin(ws)
    known = F.filter(F.split(F.lower(body), r"\s+"), lambda w: w.isin([w for ws in FUNCTION_WORDS.values() for w in ws]))
    return let(known, lambda k: F.struct(*(F.size(F.filter(k, among(ws))).alias(g) for g, ws in FUNCTION_WORDS.items())))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:www\.)?([^/?#]+)", 1))


def _lower_bound(m: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of the 95 % interval (Wilson) of a share seen ``m`` times in ``n``, so few sightings count for little at any size of the table."""
    share = m / n
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _token(kind: str, text: Column) -> Column:
    return F.when(text.isNotNull(), F.struct(F.lit(kind).alias("k"), F.xxhash64(text).alias("t")))


def furniture(
    pages: DataFrame, key: str = "page_id", site: str = "site", body: str = "body", links: str = "links", title: str = "title",
    min_pages: int = 3, host_share: float = 0.8, rates: dict[str, tuple[float, float]] | None = None, note_share: float = 0.8,
) -> DataFrame:
    """(key, field, pos): the lines of ``body`` and the positions in ``links`` that are not the article.

    ``rates``: by role, the share of a host's pages from which a token is template when it is missing from most
    comparable hosts, and from which it is template anyway.
    """
    rates = rates or {"L": (0.02, 0.067), "S": (0.05, 0.2), "W": (0.15, 2.0), "N": (0.02, 0.02), "U": (0.02, 0.02)}
    spark = pages.sparkSession
    c = lambda n: F.col(f"`{n}`")
    base = pages.select(c(key).alias("_id"), F.coalesce(c(site), F.lit("")).alias("_site"), F.coalesce(c(body), F.lit("")).alias("_body"), F.coalesce(c(links), _empty()).alias("_links"), F.trim(F.coalesce(c(title), F.lit(""))).alias("_title"))
    words = F.split(F.col("_m"), r"\s+")
    base = base.withColumn("_names", _names(F.col("_site")))
    numbered = F.filter(F.transform(F.split("_body", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda x: x["line"].rlike(r"\S"))
    # Each line learns the number of the next one before the page is taken apart, so no line carries its page.
    linked = let(numbered, lambda ls: F.transform(ls, lambda x, i: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), F.get(ls, i + 1)["pos"].alias("next"))))
    lines = (
        base.select("_id", "_site", "_title", "_names", F.explode(linked).alias("_l"))
        .select("_id", "_site", "_title", "_names", "_l.pos", F.col("_l.line").alias("_line"), "_l.next")
        .withColumn("_m", mask(F.col("_line")))
        .withColumn("_w", words)
        .select(
            "_id", "_site", "pos", "next", F.xxhash64(F.concat_ws(" ", F.slice("_w", F.greatest(F.size("_w") - 1, F.lit(1)), 2))).alias("ending"),
            F.filter(F.array(_token("L", F.col("_m")), _token("S", _opening(F.col("_m"))), _token("W", F.when(F.size("_w") > 2, F.concat_ws(" ", F.slice("_w", 1, 2)))), _token("N", F.when(_self_reference(F.col("_line"), F.col("_names")), F.lit("site")))), lambda t: t.isNotNull()).alias("toks"),
            (F.trim("_line") == F.col("_title")).alias("head"),
        )
    )
    lines = materialize(lines, "page-lines")
    hosts = base.select("_id", "_site", F.explode(F.array_distinct(F.transform("_links", host))).alias("_h")).where("_h <> '' AND _h <> lower(_site)")
    tokens = lines.select("_site", "_id", F.explode("toks").alias("x")).unionByName(hosts.select("_site", "_id", _token("U", F.col("_h")).alias("x"))).select("_site", "_id", "x.k", "x.t").distinct()
    vectors = tokens.groupBy("_site", "k", "t").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("_id")).alias("vec"))
    vectors = materialize(vectors.where(F.col("n") >= min_pages), "page-vectors")
    langs = list(FUNCTION_WORDS)
    # Pages with a line; each is told by the language of its words once.
    sites = base.where(F.col("_body").rlike(r"\S")).select("_site", _languages(F.col("_body")).alias("fw")).groupBy("_site").agg(F.count("*").alias("total"), *(F.sum(f"fw.{g}").alias(g) for g in langs))
    sites = bounded_broadcast(materialize(sites.select("_site", "total", F.array_max(F.array(*(F.struct(F.col(g).alias("n"), F.lit(g).alias("g")) for g in langs)))["g"].alias("lang")), "page-sites"))
    rated = vectors.join(sites, "_site").withColumn("rate", F.col("n") / F.col("total"))
    spread = rated.groupBy("lang", "k", "t").agg(F.count("*").alias("seen"))
    judged = rated.join(spread, ["lang", "k", "t"]).join(F.broadcast(sites.groupBy("lang").agg(F.count("*").alias("hosts"))), "lang")
    # A host without others of its language has nothing to be compared with.
    few = (F.col("hosts") == 1) | (F.col("seen") < F.col("hosts") * host_share)
    limit = lambda i: F.create_map(*(x for k, v in rates.items() for x in (F.lit(k), F.lit(v[i]))))[F.col("k")]
    valid = judged.where((few & (F.col("rate") >= limit(0))) | (F.col("rate") >= limit(1))).select("_site", "n", "vec").distinct()
    template = materialize(vectors.join(valid, ["_site", "n", "vec"], "left_semi").select("_site", "k", "t"), "page-template")
    template = bounded_broadcast(template)
    hit = lines.where("NOT head").select("_site", "_id", "pos", F.explode("toks").alias("x")).select("_site", "_id", "pos", "x.k", "x.t").join(template, ["_site", "k", "t"], "left_semi").select("_id", "pos")
    first = materialize(hit.distinct(), "page-hits")
    left = lines.where("NOT head").join(first, ["_id", "pos"], "left_anti").select("_id", "pos", "next", "ending")
    after = left.join(first.select("_id", F.col("pos").alias("next"), F.lit(1).alias("hit")), ["_id", "next"], "left")
    closed = after.groupBy("ending").agg(F.count("*").alias("n"), F.sum(F.when(F.col("next").isNull() | F.col("hit").isNotNull(), 1).otherwise(0)).alias("m"))
    closed = materialize(closed.where(_lower_bound(F.col("m"), F.col("n")) >= note_share).select("ending"), "page-notes")
    notes = left.join(bounded_broadcast(closed), "ending", "left_semi").select("_id", "pos")
    gone = first.unionByName(notes).groupBy("_id").agg(F.collect_set("pos").alias("gone"))
    hosts_gone = hosts.select("_site", "_id", "_h", _token("U", F.col("_h")).alias("x")).select("_site", "_id", "_h", "x.k", "x.t").join(template, ["_site", "k", "t"], "left_semi").groupBy("_id").agg(F.collect_set("_h").alias("hosts_gone"))
    out = base.join(gone, "_id", "left").join(hosts_gone, "_id", "left").withColumn("_l", F.split("_body", "\n"))
    gone_, hosts_ = F.coalesce("gone", F.array().cast("array<int>")), F.coalesce("hosts_gone", _empty())

    def kept(u: Column) -> Column:
        inline = lambda x: F.contains(x, F.concat(F.lit("]("), u, F.lit(")")))
        return F.when(F.exists("_l", inline), F.exists(F.filter("_l", lambda x, i: ~F.array_contains(gone_, i)), inline)).otherwise((host(u) != F.lower("_site")) & ~F.array_contains(hosts_, host(u)))

    bad = F.filter(F.transform("_links", lambda u, i: F.when(F.coalesce(u, F.lit("")).rlike(r"\S") & ~kept(u), i)), lambda i: i.isNotNull())
    both = F.array(F.struct(F.lit("body").alias("field"), gone_.alias("at")), F.struct(F.lit("links").alias("field"), bad.alias("at")))
    return out.select(F.col("_id").alias(key), F.explode(both).alias("x")).select(key, "x.field", F.explode("x.at").alias("pos"))


def article(pages: DataFrame, found: DataFrame, key: str = "page_id", body: str = "body", links: str = "links") -> DataFrame:
    """``pages`` with only the article's lines and links left."""
    gone = found.groupBy(key).agg(*(F.collect_list(F.when(F.col("field") == f, F.col("pos"))).alias(f"_{f}") for f in ("body", "links")))
    out = pages.join(gone, key, "left")
    none = F.array().cast("array<int>")
    new = {
        body: F.array_join(F.filter(F.split(F.col(f"`{body}`"), "\n"), lambda x, i: ~F.array_contains(F.coalesce("_body", none), i)), "\n"),
        links: F.filter(F.col(f"`{links}`"), lambda x, i: ~F.array_contains(F.coalesce("_links", none), i)),
    }
    return out.select(*(new.get(n, F.col(f"`{n}`")).alias(n) for n in pages.columns))
