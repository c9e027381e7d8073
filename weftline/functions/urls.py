"""Address functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import let

# Parameters that only track, parts of addresses that manage a subscription, social hosts.
TRACKING = ["fbclid", "gclid", "msclkid", "yclid", "twclid", "igshid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "mkt_tok", "li_fat_id", "ref"]
MANAGING = ["unsubscribe", "optout", "opt-out", "manage-subscription", "email-preference", "email-prefs", "email-settings"]
SOCIAL = ["twitter.com", "x.com", "t.co", "facebook.com", "fb.com", "instagram.com", "linkedin.com", "youtube.com", "youtu.be", "tiktok.com"]

_SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*?)(;[^/?#]*)?(?:\?([^#]*))?(?:#(?s:.*))?\z"


def _part(url: Column, i: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, i), F.lit(""))


def authority(url: Column) -> Column:
    return F.lower(_part(url, 2))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(raw: Column) -> Column:
    """The parameters that stay, encoded again, equal keys together at the first one's place."""
    decoded = F.transform(F.filter(F.split(raw, "&"), lambda x: x.rlike("^[^=]*=(?s:.)")), lambda x: F.struct(_decode(F.substring_index(x, "=", 1)).alias("k"), _decode(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    pairs = F.filter(decoded, lambda p: ~F.startswith(p["k"], F.lit("utm_")) & ~p["k"].isin(TRACKING))

    def grouped(p: Column) -> Column:
        keys = F.array_distinct(F.transform(p, lambda x: x["k"]))
        return F.when(F.size(keys) == F.size(p), p).otherwise(F.flatten(F.transform(keys, lambda k: F.filter(p, lambda x: x["k"] == k))))

    return F.array_join(F.transform(let(pairs, grouped), lambda x: F.concat(_encode(x["k"]), F.lit("="), _encode(x["v"]))), "&")


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, fragment, blank or tracking parameter; repeated keys stand together."""
    parts = F.struct(*(_part(url, i).alias(f"p{i}") for i in range(1, 6)))

    def build(p: Column) -> Column:
        path = F.regexp_replace(p["p3"], "/+$", "")
        query = F.when(p["p5"] != "", _query(p["p5"])).otherwise(F.lit(""))
        return F.concat(
            F.when(p["p1"] != "", F.concat(F.lower(p["p1"]), F.lit(":"))).otherwise(F.lit("")),
            F.when(p["p2"] != "", F.concat(F.lit("//"), F.lower(p["p2"]))).otherwise(F.lit("")),
            F.when(path == "", F.lit("/")).otherwise(path), p["p4"],
            let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))),
        )

    # The pattern matches every string, so nothing is left to fall back to.
    return let(parts, build)


def is_boilerplate_url(url: Column) -> Column:
    """Manages a subscription, or leads to a social platform."""
    low = F.lower(url)
    out = F.regexp_replace(authority(url), r"^www\.", "").isin(SOCIAL)
    for x in MANAGING:
        out = out | F.contains(low, F.lit(x))
    return out


# Anchors of links that lead to no story, and parts of such anchors.
ANCHORS = [
    "unsubscribe", "opt out", "opt-out",
    "manage preferences", "update preferences", "email preferences",
    "view online", "view in browser", "view as web page", "view this email",
    "read online", "read in browser",
    "privacy policy", "privacy notice",
    "terms of service", "terms of use", "terms & conditions",
    "all rights reserved",
    "contact us", "forward to a friend",
    "advertise", "advertise with us",
    "sponsored", "sponsor", "advertisement", "ad", "advertorial",
    "presented by", "powered by", "brought to you by",
    "facebook", "twitter", "linkedin", "instagram", "youtube",
    "tweet this", "share on twitter", "share on facebook",
    "share", "tweet", "retweet", "pin", "pin it",
    "subscribe", "home", "about", "archive", "archives", "blog", "newsletter",
    "back", "back to top", "next", "previous",
    "read more", "learn more", "click here", "here", "more", "see more",
    "find out more", "get started", "sign up", "try now", "try for free",
    "try it free", "try it now", "buy now", "shop now", "download now",
]
ANCHOR_PARTS = ["your preferences", "your subscription", "your email preferences", "manage your email", "manage your subscriptions"]


def is_boilerplate_link(url: Column, anchor: Column) -> Column:
    """A footer or navigation link, told by its address or anchor. A utility: segmentation judges by address alone."""
    low, a = F.lower(url), F.lower(F.regexp_replace(anchor, r"(?U)^\s+|\s+\z", ""))
    out = a.isin(ANCHORS)
    for x in MANAGING:
        out = out | F.contains(low, F.lit(x))
    for x in ANCHOR_PARTS:
        out = out | F.contains(a, F.lit(x))
    return out
