"""Text functions on columns: pure expressions, no Python per row.

Java patterns carry (?U) where Unicode classes are meant and (?d) where only a line feed ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import let

# Phrases of segments that only run the subscription.
SEGMENT_SIGNALS = [
    "manage your subscriptions",
    "manage your email",
    "update your email preferences",
    "email preferences or unsubscribe",
    "don't unsubscribe",
    "free subscriber to",
    "currently a free subscriber",
    "support this newsletter",
    "all rights reserved",
    "referral link",
    "forward this email",
    "share this newsletter",
    "recommend this newsletter",
    "in today's issue",
    "in this issue",
    "what's inside",
    "today's top stories",
    "in today's newsletter",
]

#: [anchor](address), one level of brackets within the anchor.
LINK = r"\[([^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*)\]\((https?://[^\)]+)\)"


def strip(c: Column) -> Column:
    """Both ends without any Unicode white space."""
    return F.when(c.rlike(r"(?U)^\s|\s\z"), F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")).otherwise(c)


def lines(c: Column) -> Column:
    """Non-blank lines, split at every line end."""
    return F.filter(F.split(c, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"), lambda x: strip(x) != "")


def strip_links(c: Column) -> Column:
    return let(F.when(F.contains(c, F.lit("](")), F.regexp_replace(c, LINK, "$1")).otherwise(c), strip)


def pipe_share_over(c: Column, limit: float = 0.15) -> Column:
    """Table artefact: nothing but white space, or pipes above ``limit`` of the rest."""
    solid = F.length(F.regexp_replace(c, r"(?U)\s", ""))
    pipes = F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))
    return F.when(solid == 0, True).otherwise(pipes / F.greatest(solid, F.lit(1)) > limit)


def is_segment_boilerplate(c: Column) -> Column:
    plain = F.lower(F.translate(c, "‘’“”", "''\"\""))
    out = F.lit(False)
    for s in SEGMENT_SIGNALS:
        out = out | F.contains(plain, F.lit(s))
    return out


def is_sparse(c: Column, n_links: Column) -> Column:
    """Three or more links and under 30 characters besides them."""
    return (n_links >= 3) & (F.length(F.regexp_replace(c, r"(?U)\[([^\]]*)\]\([^\)]+\)|[\d\.\-\*\#\:\s]", "")) < 30)


def drop_leading_pipe(c: Column) -> Column:
    cut = F.regexp_replace(c, r"(?U)^\|\s*", "")
    return F.when(strip(cut) != "", cut).otherwise(c)


def _bold(c: Column) -> Column:
    return F.startswith(c, F.lit("**")) & F.endswith(c, F.lit("**")) & (F.length(c) > 4)


def _bare_heading(line: Column) -> Column:
    return F.coalesce(F.startswith(line, F.lit("#")) & ~_bold(strip(F.regexp_replace(line, "^#+", ""))), F.lit(False))


def is_story_heading(c: Column) -> Column:
    """One of the first two non-blank lines is a heading that isn't wholly bold."""
    # Without a '#' at the start of a line there is nothing to look at.
    return F.contains(c, F.lit("#")) & let(F.slice(lines(c), 1, 2), lambda ls: _bare_heading(F.get(ls, F.lit(0))) | _bare_heading(F.get(ls, F.lit(1))))


def is_heading_only(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("#")) | ~c.rlike(r"(?U)^\S"), F.forall(lines(c), lambda x: F.startswith(x, F.lit("#")))).otherwise(False)


def title_and_body(c: Column) -> Column:
    """struct<title, body>: a heading or a wholly bold first line, or a heading right after the first line, becomes the title."""

    def parted(ls: Column) -> Column:
        at = F.slice(F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), strip(x).alias("s"))), lambda x: x["s"] != ""), 1, 2)
        after = lambda i: strip(F.array_join(F.slice(ls, i + 2, F.greatest(F.size(ls) - i - 1, F.lit(0))), "\n"))
        before = lambda i: strip(F.array_join(F.slice(ls, 1, i), "\n"))
        heading = lambda s: strip(F.regexp_replace(s, "^#+", ""))
        made = lambda t, b: F.struct(F.nullif(t, F.lit("")).alias("title"), b.alias("body"))

        def chosen(two: Column) -> Column:
            one, nxt = F.get(two, F.lit(0)), F.get(two, F.lit(1))
            return (
                F.when(F.startswith(one["s"], F.lit("#")), made(heading(one["s"]), after(one["i"])))
                .when(_bold(one["s"]), made(strip(F.substr(one["s"], F.lit(3), F.length(one["s"]) - 4)), after(one["i"])))
                .when(_bare_heading(nxt["s"]), made(heading(nxt["s"]), strip(F.concat(before(nxt["i"]), F.lit("\n\n"), after(nxt["i"])))))
                .otherwise(F.struct(F.lit(None).cast("string").alias("title"), c.alias("body")))
            )

        return let(at, chosen)

    return let(F.split(c, "\n"), parted)


def clean_body(c: Column) -> Column:
    """Story body without layout artefacts: pipes at its ends, empty emphasis, trailing table lines, trailing blanks."""
    artefact = lambda x: (x != "") & (pipe_share_over(x) | x.rlike(r"(?U)^\|[\s\|]+\S"))

    def trailing(ls: Column) -> Column:
        keep = F.array_max(F.filter(F.transform(ls, lambda x, i: F.when(~let(strip(x), artefact), i + 1)), lambda i: i.isNotNull()))
        return F.array_join(F.slice(ls, 1, F.coalesce(keep, F.lit(0))), "\n")

    t = let(drop_leading_pipe(c), lambda x: F.regexp_replace(x, r"\*{4,}", ""))
    # Pipes only stand at the end of what holds any.
    t = let(t, lambda x: F.when(F.contains(x, F.lit("|")), let(strip(F.regexp_replace(x, r"(?U)(\s*\|)+\s*\z", "")), lambda y: trailing(F.split(y, "\n")))).otherwise(x))
    return let(t, lambda x: F.array_join(F.transform(F.split(strip(x), "\n"), lambda y: F.rtrim(F.regexp_replace(y, r"(?U)\s+\z", ""))), "\n"))


_BOLD = (r"\*\*([^*\n]+)\*\*", r"__([^_\n]+)__")


def normalize_body(c: Column) -> Column:
    """Presentation form of a body: no markdown marks, tidy blanks."""
    t = F.regexp_replace(c, r"(?mdU)^#{1,6}\s+", "")
    for p in _BOLD:
        t = F.regexp_replace(t, p, "$1")
    t = F.regexp_replace(t, r"(?U)(?<![*\w])\*(?! )([^*\n]+?)(?<! )\*(?![*\w])", "$1")
    t = F.regexp_replace(t, r"(?U)(?<!\w)_([^_\n]+)_(?!\w)", "$1")
    t = F.regexp_replace(F.replace(t, F.lit("**"), F.lit("")), r"(?U)(?<!\w)_(?!\w)", "")
    t = F.replace(t, F.lit(" * "), F.lit("\n* "))
    t = F.translate(F.regexp_replace(t, r"(?mdU)^\s*[-|:]{3,}\s*$", ""), "■▪", "")
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def normalize_title(c: Column) -> Column:
    """Presentation form of a title; null when nothing is left."""
    t = c
    for p in _BOLD:
        t = F.regexp_replace(t, p, "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\*+", ""), r"(?U)^[^\w'\"(]+(?=\S)", "")
    return F.nullif(strip(F.regexp_replace(t, r"[ \t]{2,}", " ")), F.lit(""))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# Fixed value: the letters of code page 1252 beyond Latin-1.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def cp1252(c: Column) -> Column:
    """Without characters that code page 1252 can't hold."""
    return F.regexp_replace(c, "[^\\x00-\\x7f\\xa0-\\xff" + CP1252 + "]", "")


def excerpt(c: Column, chars: int) -> Column:
    return F.substring(c, 1, chars)
