import datetime as dt
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.config import Settings
from weftline.operators import components, decisions, representative, segments, similarity
from weftline.plans import catalog, digest
from weftline.sources import mail, runlog

STORY = "cluster_pos long, member_pos int, title string, body string, links array<string>, newsletter string, date string"


def test_reassembly_agrees_with_a_loop(spark):
    texts = {"S": "# Story heading", "H": "# **Category heading**", "X": "[](https://e.x/a)", "B": "| LABEL", "N": "A paragraph that is long enough to stay."}
    rng, rows, want = random.Random(3), [], []
    for m in range(60):
        kinds = [rng.choice("SHXBN") for _ in range(rng.randint(0, 9))]
        rows += [(m, i, texts[k]) for i, k in enumerate(kinds)]
        i = 0
        while i < len(kinds):
            j = i + 1
            if kinds[i] == "S":
                while j < len(kinds) and kinds[j] in "XN":
                    j += 1
            if kinds[i] != "H":
                want.append((m, i, "\n\n".join(texts[k] for k in kinds[i:j])))
            i = j
    df = spark.createDataFrame(rows, "msg_pos long, pos int, text string")
    got = [(r.msg_pos, r.sec_pos, r.text) for r in segments.reassemble(df).collect()]
    assert sorted(got) == sorted(want)


def items(spark, text):
    x = spark.createDataFrame([(text,)], "t string").select(segments.list_items(F.col("t")).alias("i")).first().i
    return x and [(i.text, [link.url for link in i.links]) for i in x]


def test_list_items(spark):
    a, b = "* [First item](https://e.x/1) with enough text", "* [Second item](https://e.x/2) with enough text"
    assert items(spark, f"intro\n{a}\n{b}") == [("First item with enough text", ["https://e.x/1"]), ("Second item with enough text", ["https://e.x/2"])] or len(items(spark, f"intro\n{a} and more\n{b} and more")) == 2
    assert items(spark, a) is None
    assert items(spark, "* no link in this item, but long enough\n* no link in that item, but long enough") is None
    got = items(spark, f"{a} and more\n* unlinked item with enough text in it\n{b} and more")
    assert [len(x[1]) for x in got] == [1, 0, 1]
    assert items(spark, f"{a} and more\n* short\n{b} and more") and len(items(spark, f"{a} and more\n* short\n{b} and more")) == 2


def test_links_keep_the_longest_anchor(spark):
    text = "[](https://e.x/a) [read](https://e.x/a?utm_source=m) [read more](https://e.x/a#x) [b](https://e.x/b) [x](https://twitter.com/y)"
    got = spark.createDataFrame([(text,)], "t string").select(segments.links_of(F.col("t")).alias("l")).first().l
    assert [(x.url, x.anchor_text) for x in got] == [("https://e.x/a", "read more"), ("https://e.x/b", "b")]


def test_representative(spark):
    rows = [
        (0, 0, None, "same", ["a"], "n0", "2026-02-01"), (0, 1, "t", "same", [], "n1", ""), (0, 2, "t", "same", ["b", "a"], "n2", "2026-01-01"), (0, 3, "t", "same", ["c"], "n3", None),
        (1, 0, None, "x", [], "n", ""), (2, 0, "t", "longest body", None, "n", "2026-03-01"), (2, 1, "t", "short", ["z"], "n", "2026-04-01"),
    ]
    got = {r.cluster_pos: r for r in representative.deduplicate(spark.createDataFrame(rows, STORY)).collect()}
    assert (got[0].newsletter, got[0].date, got[0].links, got[0].source_count) == ("n2", "2026-01-01", ["a", "b", "c"], 4)
    assert (got[1].date, got[1].links) == ("", [])
    assert (got[2].body, got[2].links) == ("longest body", ["z"])
    assert representative.deduplicate(spark.createDataFrame([], STORY)).count() == 0


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 3), (5, 5), (200, 201), (201, 200)]
    got = {r.vertex: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find(edges)


def test_refine_is_fail_open(spark):
    c = spark.createDataFrame([(k, m) for k in (0, 1) for m in range(3)] + [(2, 0)], "cluster_pos long, member_pos int")
    decided = spark.createDataFrame([(0, 0, 1, "same_story"), (0, 0, 2, "different"), (0, 1, 2, "related_but_distinct"), (1, 0, 1, "different"), (1, 0, 2, None), (1, 1, 2, "different")], "cluster_pos long, i int, j int, relationship string")
    got = {(r.cluster_pos, r.member_pos): (r.new_cluster, r.new_member) for r in components.refine(c, decided).collect()}
    assert got == {(0, 0): (0, 0), (0, 1): (0, 1), (0, 2): (1, 0), (1, 0): (2, 0), (1, 1): (2, 1), (1, 2): (2, 2), (2, 0): (3, 0)}
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "ci long, cj long")
    assert {r.new_cluster for r in components.merge_confirmed(c, pairs).collect()} == {0}


def greedy(v, t):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = v @ v.T
    order = sorted(range(len(v)), key=lambda i: (-(sims[i] >= t).sum(), i))
    taken, out = set(), []
    for i in order:
        own = [j for j in np.flatnonzero(sims[i] >= t) if j not in taken]
        if own:
            out.append((i, own))
            taken.update(own)
    return {j: i for i, own in out for j in own}


def test_communities_agree_with_the_greedy_walk(spark):
    v = np.random.default_rng(4).normal(size=(80, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 4)], "vec_id long, embedding array<double>")
    for block in (7, 1000):
        got = similarity.communities(similarity.cosine_pairs(df, 0.8, block_rows=block)).collect()
        assert {r.id: r.center for r in got} == greedy(v, 0.8)
        assert sorted(r.id for r in got) == list(range(80))
    assert similarity.communities(similarity.cosine_pairs(df.limit(0), 0.8)).count() == 0


def test_decisions_fail_open(spark):
    items_ = decisions.number(spark.createDataFrame([(i,) for i in range(10)], "id long"), ["id"], 3)
    assert [(r.batch_no, r.pos) for r in items_.orderBy("id").collect()] == [(i // 3, i % 3) for i in range(10)]
    table = [(0, p, True) for p in range(3)] + [(1, p, True) for p in range(2)] + [(2, p, True) for p in range(3)] + [(3, 0, None)]
    said = spark.createDataFrame(table, "batch_no long, pos long, is_noise boolean")
    left = decisions.drop_noise(items_, decisions.TableProvider(said, failed=[2]).decide(items_))
    assert sorted(r.id for r in left.collect()) == list(range(3, 10))


def test_batch_provider_calls_once_a_batch(spark):
    items_ = decisions.number(spark.createDataFrame([(i, f"b{i}") for i in range(7)], "id long, body string"), ["id"], 3)
    p = decisions.BatchProvider(lambda rows: None if rows[0]["batch_no"] == 1 else [{"keep": r["id"] % 2 == 0} for r in rows], "keep boolean, confidence string, reasoning string")
    got = {r.id: (r.keep, r.confidence, r.reasoning) for r in decisions.editorial(items_, p.decide(items_)).collect()}
    assert got == {i: (i % 2 == 0 or i in (3, 4, 5), "high", "") for i in range(7)}


RAW = """From: The Brief <news@brief.example>
Date: Mon, 02 Feb 2026 23:30:00 -0500
Subject: x
MIME-Version: 1.0
Content-Type: multipart/alternative; boundary="b"

--b
Content-Type: text/plain; charset=utf-8

plain
--b
Content-Type: text/html; charset=utf-8

<html><head><style>p{}</style></head><body><h1>Robots learn to fold</h1><p>A lab in Oslo shows a machine that folds shirts quickly.</p><p><a href="https://lab.example/fold?utm_source=n">Read it</a> for all of the details.</p>
<h1><b>Quick links</b></h1><ul><li><a href="https://a.example/1">First of the short items</a> with some text</li><li><a href="https://a.example/2">Second of the short items</a> with some text</li></ul><p>All rights reserved</p></body></html>
--b--
"""


def messages(spark, *raws):
    return spark.createDataFrame([(i, "News", dt.date(2026, 2, 3), bytearray(r.encode())) for i, r in enumerate(raws)], "msg_pos long, folder string, internal_date date, raw binary")


def test_messages_to_stories(spark):
    plain_only = "From: a@b.example\nContent-Type: text/plain\n\nhello there"
    broken = "From: a@b.example\nDate: never\nContent-Type: text/html\n\n<div style='display: none'>x</div>"
    got = segments.parse(mail.parse_mime(messages(spark, RAW, plain_only, broken, ""))).orderBy("msg_pos", "sec_pos", "item_pos").collect()
    assert [(r.title, r.links) for r in got] == [("Robots learn to fold", ["https://lab.example/fold"]), (None, ["https://a.example/1"]), (None, ["https://a.example/2"])]
    assert got[0].newsletter == "The Brief" and got[0].date == "2026-02-02" and "](" not in got[0].body and got[0].source_count == 1


def test_selection(spark):
    m = messages(spark, RAW, RAW, RAW)
    day = dt.date(2026, 2, 3)
    assert mail.select(m, " News ", day, day, 2).count() == 2
    assert mail.select(m, "News", dt.date(2026, 2, 4), dt.date(2026, 2, 5)).count() == 0
    for folder, a, b in (("  ", day, day), ("News", day, dt.date(2026, 2, 1))):
        with pytest.raises(ValueError):
            mail.select(m, folder, a, b)
    with pytest.raises(mail.FolderNotFoundError, match="News"):
        mail.check_folder(m, "Nope")


def test_digest_run_and_log(spark, tmp_path):
    log = runlog.RunLog(spark, str(tmp_path / "runs"))
    quiet = decisions.RuleProvider({"is_noise": F.lit(False)}), decisions.RuleProvider({"relationship": F.lit("different")}), decisions.RuleProvider({"keep": F.lit(True), "confidence": F.lit("borderline"), "reasoning": F.lit("r")})
    day = dt.date(2026, 2, 3)
    d = digest.build(messages(spark, RAW), "News", day, day, digest.Providers(*quiet), log, Settings(), str(tmp_path / "flags"))
    assert d["story_count"] == 3 and d["stories"][0]["link"] and json.loads(runlog.output_of(runlog.latest(log.runs())))["id"] == d["id"]
    flags = spark.read.json(str(tmp_path / "flags")).collect()
    assert len(flags) == 3 and {f.decision for f in flags} == {"KEEP"}
    blocks = ["<article></article>"]
    assert "Digest &mdash; News" in digest.page(d, blocks) and digest.filename(d["date_start"], d["id"]) == "digest-2026-02-03.pdf"

    class Broken:
        def decide(self, items):
            raise RuntimeError("provider down")

    with pytest.raises(RuntimeError, match="provider down"):
        digest.build(messages(spark, RAW), "News", day, day, digest.Providers(Broken(), *quiet[1:]), log)
    states = {r.status: r for r in log.runs().collect()}
    assert states["failed"].error_message == "provider down" and states["complete"].story_count == 3
    with pytest.raises(runlog.NotFoundError):
        runlog.output_of(runlog.by_id(log.runs(), "missing"))
    assert digest.build(messages(spark, RAW), "Other", day, day, digest.Providers(*quiet), log)["story_count"] == 0


def test_the_digest_query_takes_every_message(spark, tmp_path):
    m = messages(spark, *[RAW.replace("Oslo", f"Oslo{i}") for i in range(60)]).withColumn("folder", F.when(F.col("msg_pos") % 2 == 0, "News").otherwise("Energy"))
    m.withColumn("internal_date", F.date_add("internal_date", F.col("msg_pos").cast("int") * 20)).write.parquet(str(tmp_path / "messages.parquet"))
    want = segments.parse(mail.parse_mime(m)).where("length(body) >= 30").count()
    assert want >= 60 and catalog.q_digest(spark, str(tmp_path)).agg(F.sum("source_count")).first()[0] == want


def test_list_queries_take_titles_with_marks(spark, tmp_path):
    titles = ["Plain title of a story", "Notes [draft] of a story", "A [ left open", "Closed ] alone", "Stars * and ** here", "Figures (in full) here", "Half ( open", "Two\nlines of a title", "One line\n* and a bullet", "[Whole title]", None]
    rows = [(i, x, "the letter of the long name", [f"https://e.x/{i}", f"https://e.x/{i}/b"]) for i, x in enumerate(titles)] + [(99, "No links", "n", [])]
    spark.createDataFrame(rows, "rec_id long, title string, newsletter string, links array<string>").write.parquet(str(tmp_path / "stories.parquet"))
    link, items, links = r"\[([^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*)\]\((https?://[^)]+)\)", set(), set()
    for i, x, letter, urls in rows[:-1]:
        text = "Quick links\n" + "\n".join(f"* [{'x' if x is None else x}]({u}) by {letter}" for u in urls)
        kept = [(re.sub(link, r"\1", s).strip(), " ".join(u for _, u in re.findall(link, s))) for s in re.split(r"(?m)^\s*[*-]\s+", text)[1:]]
        kept = [k for k in kept if len(k[0]) >= 30]
        if sum(bool(u) for _, u in kept) >= 2:
            items |= {(i, n, *k) for n, k in enumerate(kept)}
        links |= {(i, n, u, a) for n, (a, u) in enumerate(re.findall(link, text))}
    assert {tuple(r) for r in catalog.q_list_items_all(spark, str(tmp_path)).collect()} == items and len({r[0] for r in items}) > 5
    assert {tuple(r) for r in catalog.q_links_of_all(spark, str(tmp_path)).collect()} == links and len({r[0] for r in links}) > 5


def test_settings_from_env():
    assert Settings.from_env(env={"WEFTLINE_SIMILARITY": "0.7", "WEFTLINE_FOLDER": "AI"}) == Settings(similarity=0.7, folder="AI")


def test_stream_of_messages(spark, tmp_path):
    from weftline.streaming import watch_stories

    (tmp_path / "in").mkdir()
    seen = []
    for name in ("a.eml", "b.eml"):
        (tmp_path / "in" / name).write_text(RAW)
        q = watch_stories(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, n: seen.append(df.count()))
        q.awaitTermination(120)
    assert seen == [3, 3]
    assert mail.read_eml(spark, str(tmp_path / "in")).count() == 2


def test_prompts_and_answers(spark):
    from weftline.operators import prompts

    items_ = decisions.number(spark.createDataFrame([(0, "T", "b" * 50, "n"), (1, None, None, None), (2, "U", "c", "m")], "id long, title string, body string, newsletter string"), ["id"], 2)
    got = {r.batch_no: (r.prompt, r.n) for r in prompts.item_prompts(items_, 5).collect()}
    assert got == {0: ("Item 1\nTitle: T\nNewsletter: n\nBody: bbbbb\n\nItem 2\nNewsletter: \nBody: ", 2), 1: ("Item 1\nTitle: U\nNewsletter: m\nBody: c", 1)}
    said = spark.createDataFrame([(0, '{"decisions": [{"keep": true}, {"keep": false, "confidence": "borderline", "reasoning": "r"}]}'), (1, "no json"), (2, None)], "batch_no long, answer string")
    rows = {(r.batch_no, r.pos): (r.ok, r.keep, r.confidence) for r in prompts.read_answers(said, "filter").collect()}
    assert rows == {(0, 0): (True, True, None), (0, 1): (True, False, "borderline"), (1, 0): (False, None, None), (2, 0): (False, None, None)}
    assert prompts.answer_schema("pairs")["properties"]["decisions"]["items"]["properties"]["relationship"]["enum"][0] == "same_story"
    assert "robots" in prompts.filter_text("robots")


def test_command_line(spark, tmp_path, capsys):
    from weftline.__main__ import main

    (tmp_path / "a.eml").write_text(RAW)
    span = ["--start", "2026-02-01", "--end", "2026-02-03"]  # around the Date header, not the day the file was written
    assert main(["--messages", str(tmp_path), "--folder", "News", *span]) == 0
    assert json.loads(capsys.readouterr().out)["story_count"] >= 2


def test_live_mailbox_source_is_described(spark):
    source = mail.imap_source()
    assert source.name() == "weftline_imap" and source({}).schema().startswith("msg_pos long")
    assert mail.imap_date(b'1 (UID 5 INTERNALDATE " 3-Feb-2026 10:00:00 +0000" BODY[] {10}') == dt.date(2026, 2, 3)
    spark.dataSource.register(source)
