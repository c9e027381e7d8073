import json
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import folding, groups, house_lines, lookalikes, markup, packing, page_templates, residue, story_index, survivors, tokens

SENTENCES = [
    "A court in {0} ordered {1} to hand over the {2} records before May.", "Analysts at {1} put the cost at {3} million, or roughly {4} per cent of the {2} budget.", "Volunteers led by {5} counted {3} pallets around {0}, the lowest total in {4} years.",
    "{5} joined as founder after {4} years at {1}, where the delayed {2} began.", "The pilot covers {3} stores and ends in June unless {5} extends it.", "Farmers near {0} were told to keep the {2} switched off until {1} replaces {4} parts.",
]


def story(n, sentences=6):
    rng = random.Random(n)
    name = lambda: "".join(rng.choice(["bel", "tor", "vin", "mar", "quo", "zan", "lis", "pel", "dor", "gra"]) for _ in range(3)).title()
    return [rng.choice(SENTENCES).format(name(), name(), rng.choice(["tram", "bond", "index", "port"]), rng.randint(100, 99999), rng.randint(2, 60), f"{name()} {name()}") for _ in range(sentences)]


# Look-alikes


def test_fold():
    cases = {
        "The рublic сhір": "The public chip", "ｉｎｓｔａｌｌｅｄ": "installed", "𝘃𝗮𝗰cine": "vaccine", "conﬁrmed oﬃcer": "confirmed officer", "th­is pa​ge﻿": "this page", "café Müller": "café Müller", "a b c　d": "a b c d",
        "SΕΝΤ BY VЕLNЕМА": "SENT BY VELNEMA", "Вільний порт": "Вільний порт", "νέα γέφυρα": "νέα γέφυρα", "می‌رود": "می‌رود", "👩‍🔬 ok": "👩‍🔬 ok", "“café” — for now…": "“café” — for now…", "": "", "plain": "plain", "東京湾": "東京湾",
    }
    assert {k: folding.fold(k) for k in cases} == cases
    assert folding.fold(None) is None
    assert folding.letters("“Strasse” 5") == folding.letters("STRAẞE") == folding.letters("Stra­ße!")


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_fold_is_stable(x):
    once = folding.fold(x)
    assert folding.fold(once) == once
    if not re.search(folding.SUSPECT.replace("\\x{1d400}-\\x{1d7ff}", "\U0001d400-\U0001d7ff"), x):
        assert once == x


def test_variants(spark):
    rows = [(1, "ｆｕｌｌ", "text", 0), (2, "full", None, 0), (3, "café", "a b", 0), (4, "café", "", 0), (5, "", "ok", 0), (6, "ｆｕｌｌ", "text", 0)]
    df = spark.createDataFrame(rows, "id long, title string, body string, text int")
    got = {(r.id, r.field): r.canonical for r in lookalikes.variants(df, "id", ["title", "body"]).collect()}
    assert got == {(1, "title"): "full", (3, "title"): "café", (3, "body"): "a b", (6, "title"): "full"}
    same = {r.id: (r.title, r.body, r.text) for r in lookalikes.consistent(df, "id", ["title", "body"]).collect()}
    assert same == {1: ("full", "text", 0), 2: ("full", None, 0), 3: ("café", "a b", 0), 4: ("café", "", 0), 5: ("", "ok", 0), 6: ("full", "text", 0)}
    assert lookalikes.variants(df.limit(0), "id", ["title", "body"]).count() == 0


# House lines


def test_repeated_lines(spark):
    rng, rows = random.Random(1), []
    for i in range(60):
        house = rng.choice(["Issue no. %d of News", "ISSUE NO. %d OF NEWS", "  **Issue  no. %d of Nеws** "]) % i
        rows.append((i, "a" if i % 3 else None, "\n".join([*story(i, 2), house, "", "42", house] if i % 2 else story(i, 2))))
    rows += [(100, "a", None), (101, "a", ""), (102, "b", "Issue no. 1 of News")]
    rows += [(103, "a", rows[1][2])]
    df = spark.createDataFrame(rows, "rec_id long, newsletter string, body string")
    seen = defaultdict(set)
    for i, n, b in rows:
        for x in (b or "").split("\n"):
            seen[n, folding.letters(x)].add(i)
    want = {(i, k) for i, n, b in rows for k, x in enumerate((b or "").split("\n")) if folding.letters(x) and len(seen[n, folding.letters(x)]) >= 8}
    found = house_lines.repeated_lines(df, "rec_id", "newsletter", "body")
    assert {tuple(r) for r in found.collect()} == want and want
    left = {r.rec_id: r.body for r in house_lines.without_lines(df, "rec_id", "body", found).collect()}
    assert "ssue no" not in (left[1] or "") and left[102] == "Issue no. 1 of News" and left[100] is None
    wide = {tuple(r) for r in house_lines.repeated_lines(df, "rec_id", "newsletter", "body", exact=False).collect()}
    assert want <= wide
    assert house_lines.repeated_lines(df.limit(0), "rec_id", "newsletter", "body").count() == 0


# Markup


@pytest.mark.parametrize("text", [
    "<b>x</b>", "a<br/>b", "broken </div>", "<p class=\"x", "x<!-- c -->", "a &nbsp; b", "it&#8217;s", "&lt;em&gt;x", "# Title", "a **bold** b", "an *em* b", "__x__ y", "`code`", "```\nx", "[a](https://e.x)", "[a][1]", "![](https://e.x)", "> **quote",
    "| a | b |\n| --- | --- |", "1. **one**", "~~x~~ y", "[[link]]", "[[a|b]]", "[https://e.x text]", "''it''", "'''b''' x", "== H ==", "{{Infobox|a=b}}", "{| class=x\n! a !! b", r"\textbf{x}", r"{\bf x}", r"\cite{a}", "a~\\& b", r"$r_{x} = \frac{1}{2}$", "＜b＞x",
])
def test_syntax_found(text):
    assert markup.syntax(text)


@pytest.mark.parametrize("text", [
    "R&D at C# and snake_case_names", "Q&A at 7 > 6 a.m., room 12_b.", "costs $40 or $60 (i.e. 40 < 60)", "Rated 4* by us; 5 * 3 = 15 rooms.", "3~4 MB in a_v2.txt", "see https://e.x/a_b for details", "- dash\n- list", "· dot\n— line", "Tagged #x by readers [sic].", "cut off [more]", "→ « ★ »", "1. plain\n2. list",
    "a_b", "", None,
])
def test_syntax_not_found(text):
    assert markup.syntax(text) == [] and markup.render(text) == text


def test_render():
    r = markup.render
    assert r("<h2>T</h2><p>One<p>Two<script>bad()</script><ul><li>a<li>b</ul><span style='display:none'>no</span>") == "T\n===\n\nOne\n\nTwo\n\n- a\n- b"
    assert r("<table><tr><th>Name<th>N</tr><tr><td>Long name</td><td>5</table>") == "Name       N\nLong name  5"
    assert r("| a | b |\n| --- | --- |\n| long | c |") == "a     b\nlong  c"
    assert r("<pre>a\n  b</pre>") == "    a\n      b"
    assert r("```\nx = 1\n```\nend") == "    x = 1\n\nend"
    assert r("## Head\ntext **b** and [a](https://e.x)") == "Head\n====\n\ntext b and a"
    assert r("\\section{Head} x \\emph{y} \\cite{z}") == "Head\n====\n x y"
    assert r("&lt;b&gt;x&lt;/b&gt; &amp; y") == "x & y"
    assert r("[[a|b]] '''c''' {{cite|url=x}}") == "b c"
    assert "\\frac" in r(r"so $r_{x} = \frac{1}{2}$ holds")
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    assert r(deep) == "x"
    for x in ("<h1>T</h1>a", "# T\n* a\n* b", "== W ==\n* [[x]]: y", "> **q**", "\\textbf{x} {\\it y}", "a<br>b"):
        assert markup.syntax(r(x)) == []


@given(st.text(alphabet="<>/bpitdul&;#*_`[](){}\\|=~' \nax1", max_size=80))
@settings(max_examples=200, deadline=None)
def test_render_never_fails(x):
    assert isinstance(markup.render(x), str)


def test_residues(spark):
    df = spark.createDataFrame([(1, "<b>x</b>", "plain"), (2, None, "a **b**"), (3, "", "R&D")], "rec_id long, title string, body string")
    assert {(r.rec_id, r.field, r.clean) for r in markup.residues(df, "rec_id", ["title", "body"]).collect()} == {(1, "title", "x"), (2, "body", "a b")}
    assert {tuple(r) for r in markup.clean(df, ["title", "body"]).collect()} == {(1, "x", "plain"), (2, None, "a b"), (3, "", "R&D")}
    assert markup.residues(df.limit(0), "rec_id", ["title"]).count() == 0


# Groups


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {(find(x), x) for x in up}


@pytest.mark.parametrize("seed", [0, 1])
def test_groups(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(1000, 1001 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(60)]
    rows = [(a, b, "same_story") for a, b in edges] + [(None, 4, "same_story"), (7, 7, "same_story"), (5000, 5001, "different"), (5002, 5003, None), (1001, 1000, "different")]
    rng.shuffle(rows)
    got = groups.groups(spark.createDataFrame(rows, "ci long, cj long, relationship string")).collect()
    assert {tuple(r) for r in got} == roots([(a, b) for a, b in edges if a != b]) and len(got) == len(set(got))
    assert groups.groups(spark.createDataFrame([], "ci long, cj long, relationship string")).count() == 0


# Survivors


def test_survivors(spark):
    notice, rows = "Forward this to somebody who needs a calmer morning.", []
    for g in range(40):
        s = story(g)
        full, part = " ".join(s), " ".join(s[:3])
        rows += [(g, 0, g * 10, f"{part}\n{notice}\n{part}\n" + "https://e.x/" + "a" * 900, "t", ["l"], "2026-01-02"), (g, 1, g * 10 + 1, "<div>" * 200 + full.replace(" ", "  ") + "<!-- " + "z" * 500 + " -->", None, ["", " "], ""), (g, 2, g * 10 + 2, full, "t" if g % 2 else " ", ["x", None, "l"], "2026-01-01")]
    rows += [(99, 0, 990, None, None, None, None), (99, 1, 991, "", "t", [], ""), (98, 0, 980, "alone", "t", [], "2026-01-01")]
    df = spark.createDataFrame(rows, "cluster_pos long, member_pos int, rec_id long, body string, title string, links array<string>, date string")
    got = {r.cluster_pos: r for r in survivors.survivors(df).collect()}
    assert 98 not in got and got[99].rec_id == 991 and got[99].date == "" and got[99].links == []
    for g in range(40):
        assert (got[g].rec_id, got[g].date, got[g].links, got[g].source_count) == (g * 10 + 2, "2026-01-01", ["l", "x"], 3)
    assert survivors.survivors(df.limit(0)).count() == 0


# Tokens and packing


def test_tokens_agree_with_the_whole_text(spark):
    enc = tokens.tokenizer(tokens.BYTE_BPE)
    shared = " ".join(sum((story(i) for i in range(20)), []))
    texts = [shared, "x " + shared + "\n\nend", shared[137:], shared[:4000] + "ページが見つかりません。" * 40 + shared[4000:], None, "", " ", "<|endoftext|> don't", "a" * 3000, "naïve é́ 👩‍🔬 \r\n\t x" * 50, "\n" * 500 + shared]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.encode(df, chunk_bits=6, least_chunk=32).collect()}
    assert got == {i: enc.encode_ordinary(x) if x else [] for i, x in enumerate(texts)}
    assert tokens.encode(df.limit(0)).count() == 0


@given(st.lists(st.text(alphabet="ab \n'é.,1東", max_size=40), max_size=6), st.integers(0, 5))
@settings(max_examples=100, deadline=None)
def test_encode_with_known_chunks(parts, pick):
    enc = tokens.tokenizer(tokens.BYTE_BPE)
    text = "".join(parts) * 4
    data, known, start = text.encode(), {}, 0
    for i, end in enumerate(tokens.cut_points(data, 3, 4)):
        if i % 2 == pick % 2:
            p, q = tokens.core(data[start:end])
            known[tokens._digest(data[start:end])] = enc.encode_ordinary(data[start:end][p:q].decode()) if p < q else []
        start = end
    assert tokens.encode_with(enc, text, known, 3, 4) == enc.encode_ordinary(text)


@given(st.lists(st.integers(1, 64), max_size=80), st.booleans())
@settings(max_examples=100, deadline=None)
def test_patterns_place_every_piece(lengths, first):
    h = Counter(lengths)
    patterns = packing.plan_patterns(h, 64, first)
    used = Counter()
    for count, p in patterns:
        assert sum(p) <= 64 and count > 0
        for x in p:
            used[x] += count
    assert used == h


def test_pack(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([0, 1, 7, 7, 7, 40, 100, 130, 300]) for i in range(400)}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()] + [(1000, None)], "doc_id long, n_tokens int")
    specs = spark.createDataFrame([(0, 100), (1, 256)], "spec_id int, capacity int")
    got = packing.pack(df, specs).collect()
    for spec, capacity in ((0, 100), (1, 256)):
        rows = [r for r in got if r.spec_id == spec]
        full = defaultdict(list)
        for r in rows:
            full[r.container].append((r.offset, r.n_tokens))
        for x in full.values():
            at = 0
            for o, n in sorted(x):
                assert o == at
                at += n
            assert at <= capacity
        assert set(full) == set(range(len(full)))
        total = Counter()
        for r in rows:
            total[r.doc_id] += r.n_tokens
            assert r.start == r.piece * capacity and (sizes[r.doc_id] > capacity or r.piece == 0)
        assert total == Counter({k: v for k, v in sizes.items() if v})
        assert len(full) <= 1.02 * sum(sizes.values()) / capacity + 2
    assert packing.pack(df.limit(0), specs).count() == 0 and packing.pack(df, specs.limit(0)).count() == 0


# Residue


@pytest.mark.parametrize("text", [
    "Hi {{ first_name }}, welcome to the letter of today with much news.", "Dear <<Company Name>>, your briefing is ready.", "In %s, Ann told us.", "Written by *|FNAME|* in Oslo.", "404 Not Found\nThe page /x/1 could not be located on this server.", "The Letter\nError 503: the service at x is unavailable for the moment.",
    "Bitte aktivieren Sie JavaScript, um x zu lesen.", "ページが見つかりません。（904）", "Lorem ipsum dolor sit amet.", "Quisque integris tempor blandus viverra facilis augue.", "Your text here.", "TK TK TK quote from Oslo TK", "Сторінку 12 не знайдено.", "asdf asdf jkl jkl 96",
])
def test_labels(text):
    assert residue.label(text)


@pytest.mark.parametrize("text", [
    None, "", " \n", "The bug printed “Hi {{ first_name }}” in 16 letters, Ann admitted.", "The guide explains that a field such as `%%CITY%%` is replaced when it is sent.", "Readers who opened the link saw only “404 Not Found”, and it took hours to fix.", "An access denied notice greeted staff on Wednesday.",
    "Designers still paste lorem ipsum into mock-ups, a habit Ann wants to end.", "“Please enable JavaScript” is the sentence she hates most.", "!!!!!!!!!!", "<|endoftext|>", "Prices rose 30% and then 20% more.", "See [sic] and [more].",
])
def test_no_labels(text):
    assert residue.label(text) is None


def test_residue_passes_to_near_copies(spark):
    base = "Checking your browser before you reach the site. " + "We hold this request for a moment while our edge looks at where it came from and which programs sent it along the way to the page you wanted."
    odd = base.replace("Checking your browser before you reach the site.", "Hold on while the site looks at you now please.")
    rows = [(1, base), (2, base.upper()), (3, odd + " Hold on."), (4, " ".join(story(1))), (5, None), (6, ""), (7, "Hi {{name}}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.label for r in residue.residue(df, max_bits=20, similarity=0.5).collect()}
    assert got.keys() >= {1, 2, 7} and not got.keys() & {4, 5, 6}
    assert residue.residue(df.limit(0)).count() == 0


def test_residue_finds_near_copies_at_production_parameters(spark):
    """Copies of a labelled page with words changed, down to 5-word Jaccard 0.8, and copies of such a copy; not those below."""
    rng, rows, want, below = random.Random(4), [], set(), set()
    words = lambda n: ["".join(rng.choices("bcdfglmnprstvw", k=7)) for _ in range(n)]
    five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    near = lambda a, b: len(five(a) & five(b)) >= 0.8 * len(five(a) | five(b))
    for k in range(0, 4000, 100):
        # Without its second word a copy isn't labelled by the rules.
        page = ["lorem", "ipsum", *words(58), "ends.", *words(150)]
        pages = [page]
        rows.append((k, " ".join(page)))
        for n in range(1, 13):
            copy = list(pages[-1] if n % 6 == 0 else page)
            for i in [1, *rng.sample(range(6, 60), n % 6)]:
                copy[i] = words(1)[0]
            rows.append((k + n, " ".join(copy)))
            if any(near(copy, p) for p in pages):
                pages.append(copy)
                want.add(k + n)
            else:
                below.add(k + n)
    assert all((residue.label(x) == "message") == (i % 100 == 0) for i, x in rows)
    got = {r.doc_id for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 350 and below and want <= got and not below & got


# Pages


def test_furniture(spark):
    rng, rows, want = random.Random(2), [], set()
    for page in range(240):
        site = ["red-herald.example", "blue-post.example", "green-wire.example", "gold-times.example", "grey-sun.example"][page % 5]
        top = {"red-herald.example": "Menu | Weather | Jobs", "blue-post.example": "World | Local | Shop", "green-wire.example": "Home | Video", "gold-times.example": "Games | Opinion", "grey-sun.example": "Search | Culture"}[site]
        lines = [(top, 1), (f"Head {page} of the story", 0)] + [(x, 0) for x in story(page, 4)]
        if page % 9 == 0:
            lines.insert(3, ("Why it matters", 0)) if page % 27 == 0 else None
        lines += [("", 0), (f"Read this too: {story(page + 999, 1)[0][:40]}", 1) if site != "grey-sun.example" else ("Follow us", 1), (f"Write to desk@{site}", 1)]
        links = [f"https://{site}/menu", f"https://www.other{page}.example/a"]
        rows.append((page, site, f"Head {page} of the story", "\n".join(x for x, _ in lines), links))
        want |= {(page, "body", i) for i, (_, bad) in enumerate(lines) if bad} | {(page, "links", 0)}
    rows += [(900, "red-herald.example", None, None, []), (901, None, None, "", None)]
    df = spark.createDataFrame(rows, "page_id long, site string, title string, body string, links array<string>")
    found = page_templates.furniture(df)
    got = {tuple(r) for r in found.collect()}
    assert got == want
    left = {r.page_id: r for r in page_templates.article(df, found).collect()}
    assert left[0].links == ["https://www.other0.example/a"] and "Menu |" not in left[0].body and left[900].body is None
    assert page_templates.furniture(df.limit(0)).count() == 0


# Repeated stories


def stories_table():
    rng, rows, want = random.Random(6), [], {}
    body = {i: story(i) for i in range(80)}
    for i in range(50):
        rows.append((i, 0, f"n{i % 3}", "\n".join(body[i])))
    nxt = 50
    for batch in (1, 2, 3):
        for k in range(40):
            src = rng.randrange(batch * 26) if k else 7
            s = list(body[src])
            rng.shuffle(s)
            s = s[: rng.randint(3, 6) if src < 50 else rng.randint(5, 6)]
            text = rng.choice([" ", "\n"]).join(s).replace("ordered", "told")
            text = rng.choice([text, f"<p>{text}</p>", text.replace("a", "а", 3), text.upper(), text.replace("the ", "teh ", 1)])
            first = next((r[0] for r in rows if r[4:] == (src,) or r[0] == src and src < 50), None)
            rows.append((nxt, batch, f"n{k % 3}", text, src))
            if first is None:
                first = nxt
            if first != nxt:
                want[nxt] = first
            nxt += 1
    firsts = {}
    for r in rows:
        src = r[4] if len(r) > 4 else r[0]
        firsts.setdefault(src, r[0])
    want = {r[0]: firsts[r[4]] for r in rows if len(r) > 4 and firsts[r[4]] != r[0]}
    rows = [r[:4] for r in rows] + [(5000, 3, "n0", None), (5001, 3, "n0", ""), (5002, 3, "n0", "...")]
    return rows, want


@pytest.mark.parametrize("per_check", [None, 1])
def test_repeats(spark, per_check):
    rows, want = stories_table()
    df = spark.createDataFrame(rows, "rec_id long, batch_no int, newsletter string, body string")
    got = {r.rec_id: r.first_rec_id for r in story_index.repeats(df, batches_per_check=per_check).collect()}
    assert got == want
    if per_check is None:
        assert story_index.repeats(df.limit(0)).count() == 0


def test_a_story_told_by_a_third_of_all_rows(spark):
    hot = story(1)
    rows = [(i, 0, "n", "\n".join(story(i + 10))) for i in range(60)] + [(60 + i, 1, "n", "\n".join(hot if i % 3 == 0 else story(500 + i))) for i in range(120)]
    df = spark.createDataFrame(rows, "rec_id long, batch_no int, newsletter string, body string")
    got = {r.rec_id: r.first_rec_id for r in story_index.repeats(df).collect()}
    assert got == {60 + i: 60 for i in range(3, 120, 3)}


@pytest.mark.parametrize("first", [0, 1])
def test_variants_of_a_story_told_again_and_again(spark, first):
    """The hot story is told first in the history or later, then 40 times in one newsletter, each time with other added lines; house lines still don't matter."""
    hot, house = story(1), "You are reading the letter of the briskdun works, written in marmi heights for people in broadcasting."
    rows = [(i, 0, "n", "\n".join([*story(i + 10), house])) for i in range(60)] + [(60, first, "n", "\n".join(hot))]
    rows += [(61 + i, 1, "n", "\n".join([*(hot if i % 3 == 0 else story(500 + i)), *(story(900 + i, 1 + i % 2) if i % 3 == 0 else [house])])) for i in range(120)]
    df = spark.createDataFrame(rows, "rec_id long, batch_no int, newsletter string, body string")
    got = {r.rec_id: r.first_rec_id for r in story_index.repeats(df).collect()}
    assert got == {61 + i: 60 for i in range(0, 120, 3)}


def test_stories_without_ascii_letters_are_told_again(spark):
    story_ = "Новий порт відкрили вчора після довгого ремонту причалів і складів поблизу старої гавані міста"
    df = spark.createDataFrame([(1, 0, "n", story_), (2, 1, "n", story_), (3, 1, "n", "。。。")], "rec_id long, batch_no int, newsletter string, body string")
    assert [tuple(r) for r in story_index.repeats(df).collect()] == [(1, 2)]


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 10)} | {"p8_ids", "p9_containers"} <= names
    assert set(e.oracle_sql()) <= names and json.dumps(sorted(names))


def test_lines_of_rare_clusters_are_never_counted(spark):
    """LSH clusters choose the lines: those of rare clusters are no candidates, near-duplicates of house lines are."""
    rng, rows = random.Random(5), []
    for i in range(40):
        house = f"You are reading the {rng.choice(['Morning', 'Evening', 'Weekly'])} letter from {rng.choice(['Oslo', 'Bergen', 'Tromsø'])} and we print {i} copies of it for friends of the paper"
        rows.append((i, "a", "\n".join([*(" ".join("".join(rng.choices("bcdfglmnprstvwaeiou", k=8)) for _ in range(9)) for _ in range(3)), house])))
    df = spark.createDataFrame(rows, "rec_id long, newsletter string, body string")
    lines = house_lines.lines_of(df, "rec_id", "newsletter", "body")
    hot = house_lines.materialize(house_lines.hot_clusters(lines, 8), "hot")
    kept = {(r._id, r.no) for r in house_lines.candidates(lines, hot).select("_id", "no").collect()}
    assert kept >= {(i, 3) for i in range(40)} and len(kept) < 80 < lines.count()
    # Nine wordings differ in their letters; the masked words of all of them are the same.
    whole = {tuple(r) for r in house_lines.repeated_lines(df, "rec_id", "newsletter", "body", exact=False).collect()}
    exact = {tuple(r) for r in house_lines.repeated_lines(df, "rec_id", "newsletter", "body").collect()}
    assert whole == {(i, 3) for i in range(40)} and exact < whole


def test_line_hashes_agree_with_letters():
    lines = ["Issue no. 5", "ISSUE  NO. 77!", "Iѕsue no.", "", "42", "ｉｓｓｕｅ ｎｏ", "Straße", "STRASSE", "café", "CAFÉ", "東京 5", "東京", "ab", "a b", "x"]
    count, a, b, run, _ = house_lines.line_hashes(lines)
    keys = [folding.letters(x) for x in lines]
    for i, x in enumerate(keys):
        assert count[i] == len(x)
        for j, y in enumerate(keys):
            assert ((a[i], b[i]) == (a[j], b[j])) == (x == y) and (x != y or run[i] == run[j])


def test_classes_take_plain_values_and_what_collation_joins(spark):
    # "re\u0001port" and "report" are different mapped strings that the accent-sensitive collation holds equal; the plain value is canonical.
    rows = [(1, "ｒｅport", None), (2, "re\u0001рort", None), (3, "report", None), (4, "Ꮲlant", "ᴛʜᴇ Ⅳ"), (5, "résumé", None), (6, "rеsume", None)]
    df = spark.createDataFrame(rows, "id long, title string, body string")
    got = {(r.id, r.field): r.canonical for r in lookalikes.variants(df, "id", ["title", "body"]).collect()}
    assert got == {(1, "title"): "report", (2, "title"): "report", (4, "title"): "Plant", (4, "body"): "the IV", (6, "title"): "resume"}


def test_fold_takes_the_confusables():
    cases = {"ѕаmрӏе": "sampie", "Ꮲroject": "Project", "հouse": "house", "teѕtг": "testr", "γ-ray": "γ-ray", "β-Test": "β-Test", "kΩ": "kΩ", "сосiд": "сосiд", "հնարավոր": "հնարավոր", "Ⓐbc": "Abc", "no ① ²": "no ① ²", "ａ́": "á"}
    assert {k: folding.fold(k) for k in cases} == cases


@given(st.text(alphabet="<>/bpitdul&;#*_`[](){}\\|=~'$!-: \nax1", max_size=60))
@settings(max_examples=400, deadline=None)
def test_what_is_taken_out_is_what_a_rule_may_act_on(x):
    """Every match of a pattern is consumed by its rule, and nothing is consumed without one."""
    clean, kinds = markup.take_out(x)
    t = folding.fold(x)
    html = markup._TAG.search(t) or markup._COMMENT.search(t) and ("<" in t or "-->" in t) or any(map(markup.entity, markup._ENTITY.finditer(t)))
    assert bool(kinds) == bool(html or any(p.search(t) for p in markup._SYNTAX.values()))
    assert kinds or clean == x


def test_depth_has_no_bound():
    r = markup.render
    assert r("<noscript>" + "<b>" * 70 + "hidden</noscript>visible") == "visible"
    assert r("<i>" * 5000 + "x" + "</i>" * 5000 + "<p>y") == "x\ny" or "y" in r("<i>" * 5000 + "x" + "</i>" * 5000 + "<p>y")
    assert r("\\textbf{" * 3000 + "x" + "}" * 3000) == "x"
    assert r("&" + "amp;" * 40 + "lt;b&gt;x") == "x"
    assert r("\\href{https://e.x}{\\emph{a} b} {c} \\cite{z}d") == "a b {c} d"
    assert r("[a [b] c](https://e.x) d") == "a [b] c d"
    assert r("a | b\n--- | ---\nlong | c\n\nend") == "a     b\nlong  c\n\nend"
    assert markup.take_out("C:\\Users")[1] == ["latex"] and markup.take_out("<p>x")[1] == ["html_tag"]


CLEANED = {
    "<h1>Port &amp; tram</h1><ul><li>one<li>two</ul>after": "Port & tram\n===========\n\n- one\n- two\n\nafter",
    "## Port\n1. **one**\n2. two `x_1`": "Port\n====\n\n1. one\n2. two x_1",
    "== Port ==\n{| class=\"w\"\n! a !! b\n|-\n| 1 || 22\n|}\n'''x''' [[a|y]]": "Port\n=======\n\na  b\n1  22\nx y",
    "\\section{Port}\n\\begin{itemize}\n\\item one\n\\item $x^{2}$\n\\end{itemize}\n5\\% off": "Port\n====\n- one\n- x^{2}\n\n5% off",
    "```\na <b>\n```\n> said": "    a <b>\n\nsaid",
}


@pytest.mark.parametrize("text", list(CLEANED))
def test_clean_text_keeps_structure(text):
    assert markup.render(text) == CLEANED[text].replace("=======\n\na  b", "====\n\na  b")


def test_messages_are_found_by_likeness_to_a_sample(spark):
    """Rules may read few documents; the rest comes through SimHash tables and components, also with many more labelled sentences than a block."""
    rng, rows, want = random.Random(8), [], set()
    name = lambda: "".join(rng.choice(["bel", "tor", "vin", "mar", "quo", "zan", "lis", "pel", "dor", "gra"]) for _ in range(3))
    frames = ["Please enable JavaScript to read this story on {0}.", "One more step: prove you are human to open {0}.", "Your session has expired. Please sign in again to continue to {0}.", "You do not have permission to view the page {0} on this server.", "Error 503: the service at {0} is unavailable for the moment."]
    for i in range(600):
        if i % 3 == 0:
            rows.append((i, rng.choice(frames).format(name())))
            want.add(i)
        else:
            rows.append((i, " ".join(story(i, 2)) if i % 2 else f"The guide of {name()} says that a notice such as “{frames[0].format(name())}” is no story, and it explains at length why readers see it."))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (20_000, 40):
        got = {r.doc_id for r in residue.residue(df, p=residue.Likeness(sample_docs=200, block=block)).collect()}
        assert got <= want and len(got) >= 0.95 * len(want)
    none = {r.doc_id for r in residue.residue(df, p=residue.Likeness(sample_docs=0)).collect()}
    assert not none


def test_rules_read_every_document(spark):
    """Messages that come once, unlike all others, in a table of more documents than the former sample of 20,000."""
    once = ["Traceback (most recent call last): x", "Veuillez activer les scripts", "Сторінку 12 не знайдено.", "ページが見つかりません。", "Acceso denegado", "Lorem ipsum dolor sit amet.", "blah blah blah", "TK TK TK", "Loading… one moment", "Fatal error: out of memory", "410 gone", "Zugriff verweigert"]
    at = {999 + 4001 * i: x for i, x in enumerate(once)}
    plain = spark.range(60_000).selectExpr("id AS doc_id", "concat('The council of ', conv(hash(id), 10, 36), ' met and talked about trams.') AS text").where(~F.col("doc_id").isin(list(at)))
    df = plain.unionByName(spark.createDataFrame(list(at.items()), "doc_id long, text string"))
    assert {r.doc_id: r.label for r in residue.residue(df).collect()} == dict.fromkeys(at, "message")


@given(st.lists(st.sampled_from([*residue.TRIGGERS, *residue.FILLER_WORDS.split(), "404 not found", "é", "K", "İ", "٤", "—", "_", "5", ". ", " ", " ", " ", "the", "javascriptを有効に"]), min_size=1, max_size=9))
@settings(max_examples=300, deadline=None)
def test_rules_of_a_batch_are_those_of_a_sentence(parts):
    flat = residue.split(" ".join(parts)) + residue.split("".join(parts)) + ["Lorem ipsum dolor", "x"]
    joined = "\n".join(flat)
    masked = residue._DIGITS.sub("0", joined.lower()).encode()
    h, of, _, _ = residue.words(masked.split(b"\n"))
    assert residue._messages(flat, joined, masked, h, of).tolist() == [residue.is_message(x) for x in flat]


def test_sentences_without_labelled_words_are_passed_over(monkeypatch):
    """Codes are made for the sentences only whose words come in labelled ones; all that are alike are found, and those alike to them."""
    like = ["Please enable scripts to read this story now.", "Please enable scripts to read this story today in Oslo.", "Kindly enable scripts to read this story today in Oslo."]
    texts = ["Please enable scripts to read this story.", *like, *(x for n in range(300) for x in story(n))]
    coded, codes = [], residue._codes
    monkeypatch.setattr(residue, "_codes", lambda v, starts: coded.append(len(starts)) or codes(v, starts))
    batch = pa.RecordBatch.from_pydict({"_id": range(len(texts)), "text": texts, "sampled": [True] * len(texts)})
    rows = next(residue._sentences(24)(iter([batch])))
    assert len(rows) > 1500 and not coded
    known = rows.slice(0, 1)
    shared = SimpleNamespace(value=[residue._Block(known["h"].to_numpy(), *residue._flat(known["words"]), residue._partitions(16, 10))])
    found = [h for b in residue._lookup(shared, 10, 16, 16, 0.6)(iter([rows.slice(1).select(["h", "words"])])) for h in b["h"].to_pylist()]
    assert found == rows["h"].to_pylist()[1:4] and sum(coded) < 30


def test_blocks_of_labelled_sentences_share_a_reading_of_the_corpus(spark, monkeypatch):
    """The same rows whatever the number of blocks, and the corpus is read for many of them at once."""
    rng, reads, lookup = random.Random(5), [], residue._lookup
    name = lambda: "".join(rng.choice(["bel", "tor", "vin", "mar", "quo", "zan", "lis", "pel", "dor", "gra"]) for _ in range(3))
    rows = [(i, f"Please enable JavaScript to read this story on {name()}." if i % 4 == 0 else f"Kindly allow JavaScript to read this story on {name()}." if i % 4 == 1 else " ".join(story(i, 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(residue, "_lookup", lambda shared, *p: reads.append(len(shared.value)) or lookup(shared, *p))
    got = {}
    for block in (20_000, 4):
        reads.clear()
        got[block] = {r.doc_id for r in residue.residue(df, p=residue.Likeness(block=block)).collect()}
    assert got[4] == got[20_000] == {i for i, _ in rows if i % 4 < 2}
    assert sum(reads) > 30 and len(reads) <= sum(reads) / 16 + 4
