import pytest
from pyspark.sql import functions as F

from weftline.functions import text as t
from weftline.functions import urls


def one(spark, fn, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_normalize_body(spark):
    cases = {
        "## Heading\ntext": "Heading\ntext", "a **bold** b": "a bold b", "a __bold__ b": "a bold b", "an *italic* word": "an italic word", "an _italic_ word": "an italic word",
        "snake_case_name": "snake_case_name", "2 * 3": "2\n* 3", "one * two * three": "one\n* two\n* three", "a\n---\nb": "a\n\nb", "■ x ▪ y": "x y", "a   b": "a b", "a\n\n\n\nb": "a\n\nb", "stray ** here": "stray here", "x ._. y": "x .. y",
    }
    assert one(spark, t.normalize_body, *cases) == list(cases.values())


def test_normalize_title(spark):
    cases = {"**T**": "T", "■ T": "T", "► (T)": "(T)", "*": None, "": None, "“Quoted”": "Quoted”", "Été  là": "Été là"}
    assert one(spark, t.normalize_title, *cases) == list(cases.values())
    assert one(spark, t.normalize_title, None) == [None]


@pytest.mark.parametrize(("text", "title", "body"), [
    ("# Title\n\nbody", "Title", "body"), ("**Bold title**\nbody", "Bold title", "body"), ("LABEL\n\n# T\n\nbody", "T", "LABEL\n\nbody"), ("plain\ntext", None, "plain\ntext"),
    ("# \nbody", None, "body"), ("LABEL\n# **x long**\nbody", None, "LABEL\n# **x long**\nbody"), ("a\nb\n# late", None, "a\nb\n# late"), ("", None, ""), ("****", None, "****"),
])
def test_title_and_body(spark, text, title, body):
    assert one(spark, t.title_and_body, text)[0] == (title, body)


def test_artefacts(spark):
    # 3 of 20 is exactly the limit, 4 of 20 is above it.
    assert one(spark, t.pipe_share_over, "|" * 3 + "x" * 17, "|" * 4 + "x" * 16, "  \n", "text") == [False, True, True, False]
    assert one(spark, t.is_segment_boilerplate, "In today’s newsletter: all", "All rights reserved", "A story") == [True, True, False]
    sparse = lambda n: lambda c: t.is_sparse(c, F.lit(n))
    assert one(spark, sparse(3), "1. [a](https://a.x) 2. [b](https://b.x)", "word " * 12) == [True, False]
    assert one(spark, sparse(2), "[a](https://a.x)") == [False]


def test_headings(spark):
    assert one(spark, t.is_story_heading, "# T", "LABEL\n\n# T", "# **Category**", "text", "a\nb\n# T", "") == [True, True, False, False, False, False]
    assert one(spark, t.is_heading_only, "# a\n## b", "# a\ntext", "", " \n ") == [True, False, True, True]


def test_clean_body(spark):
    assert one(spark, t.clean_body, "|  text ****here | |", "line   \nnext\n| |  SUBSCRIBE", "x\n\n| a | b |", "|", "a\n| | | |\n\n") == ["text here", "line\nnext", "x", "", "a"]


def test_links_are_stripped(spark):
    assert one(spark, t.strip_links, "[a [b] c](https://e.x/g) d", "[](https://e.x/a)", "[x](ftp://no)") == ["a [b] c d", "", "[x](ftp://no)"]


def test_urls(spark):
    cases = {
        "HTTPS://Example.COM/Path/?utm_source=x&b=2&a=1&b=3#frag": "https://example.com/Path?b=2&b=3&a=1", "https://e.x": "https://e.x/", "https://e.x/?ref=nl&q=a%20b": "https://e.x/?q=a+b",
        "https://e.x/a?blank=&k": "https://e.x/a", "https://e.x/a;p?x=%7E*": "https://e.x/a;p?x=~%2A", "https://e.x/p?bad=%zz": "https://e.x/p?bad=%25zz", "not a url": "not a url", "": "/",
    }
    got = one(spark, urls.normalize_url, *cases)
    assert got == list(cases.values())
    assert one(spark, urls.normalize_url, *got) == got
    assert one(spark, urls.is_boilerplate_url, "https://www.x.com/a", "https://m.facebook.com/a", "https://x.com:443/a", "https://e.x/UNSUBSCRIBE", "https://e.x/a") == [True, False, False, True, False]


def test_escape_and_cp1252(spark):
    assert one(spark, t.escape_html, "<a href=\"x\">'&'</a>") == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"]
    assert one(spark, t.cp1252, "naïve “x” 東 €") == ["naïve “x”  €"]
