"""What surrounds a run: files and mailboxes, folder checks, counters, logging, a model of one's own, scratch folders."""

import datetime as dt
import logging
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.test_operators import RAW, messages
from weftline import logs, runtime
from weftline.operators import decisions, segments
from weftline.plans import digest
from weftline.sources import mail, runlog

DAY = dt.date(2026, 2, 3)


def quiet(confidence="high"):
    return digest.Providers(
        decisions.RuleProvider({"is_noise": F.lit(False)}), decisions.RuleProvider({"relationship": F.lit("same_story")}),
        decisions.RuleProvider({"keep": F.col("source_count") > 1, "confidence": F.lit(confidence), "reasoning": F.lit("r")}),
    )


def test_files_have_the_day_of_their_header(spark, tmp_path):
    for name, head in (("b", "Date: Mon, 02 Feb 2026 23:30:00 -0500"), ("a", "date:  7 Mar 2026 10:00:00 +0000"), ("c", "Subject: x\n\nDate: Mon, 01 Jan 2001 00:00:00 +0000"), ("d", "Date: never"), ("e", "Subject: y")):
        (tmp_path / f"{name}.eml").write_text(f"From: a@b.example\n{head}\n\nhello")
    got = [(r.msg_pos, r.internal_date) for r in mail.read_eml(spark, str(tmp_path), "News").orderBy("msg_pos").collect()]
    today = dt.datetime.now(dt.UTC).date()
    assert [p for p, _ in got] == [0, 1, 2, 3, 4] and [d for _, d in got[:2]] == [dt.date(2026, 3, 7), dt.date(2026, 2, 2)]
    assert all(abs((d - today).days) <= 1 for _, d in got[2:])
    assert mail.select(mail.read_eml(spark, str(tmp_path), "News"), "News", dt.date(2026, 2, 1), dt.date(2026, 2, 28)).count() == 1


class Box:
    """A mailbox that answers a fetch in reverse order and counts what it is asked."""

    asked: list = []

    def __init__(self, host):
        Box.asked.append(("connect", host))

    def login(self, user, password):
        Box.asked.append(("login", user))

    def select(self, name, readonly):
        assert readonly
        return ("OK", []) if name == '"News"' else ("NO", [])

    def list(self):
        return "OK", [b'(\\HasNoChildren) "/" "News"', b'(\\HasNoChildren) "/" "Energy"']

    def uid(self, command, *args):
        Box.asked.append((command, *args))
        if command == "SEARCH":
            return "OK", [b"11 12 15 19"]
        return "OK", [x for u in reversed(args[0].split(b",")) for x in ((b'1 (UID %s INTERNALDATE "03-Feb-2026 10:00:00 +0000" BODY[] {5}' % u, b"raw" + u), b")")]

    def logout(self):
        pass


def test_a_mailbox_is_read_with_one_fetch_a_chunk():
    Box.asked.clear()
    options = {"host": "h", "user": "u", "password": "p", "folder": "News", "start": "2026-02-01", "end": "2026-02-28", "cap": "3", "chunk": "2"}
    reader = mail.imap_source(Box)(options).reader(None)
    parts = reader.partitions()
    assert Box.asked[-1] == ("SEARCH", None, "SINCE", "01-Feb-2026", "BEFORE", "01-Mar-2026") and [p.uids for p in parts] == [[b"11", b"12"], [b"15"]]
    Box.asked.clear()
    rows = [r for p in parts for r in reader.read(p)]
    assert rows == [(0, "News", DAY, b"raw11"), (1, "News", DAY, b"raw12"), (2, "News", DAY, b"raw15")]
    assert [a[0] for a in Box.asked] == ["connect", "login", "FETCH"] * 2
    with pytest.raises(mail.FolderNotFoundError, match="News, Energy"):
        mail.imap_source(Box)(options | {"folder": "Nope"}).reader(None).partitions()


def test_a_run_names_missing_folders_and_counts_its_stages(spark, tmp_path, caplog):
    log, counts = runlog.RunLog(spark, str(tmp_path / "runs")), {}
    with pytest.raises(mail.FolderNotFoundError, match="Available folders: News"):
        digest.build(messages(spark, RAW), "Other", DAY, DAY, quiet(), log, require_folder=True)
    assert {r.status for r in log.runs().collect()} == {"failed"}

    def embed(records):
        Box.asked.append("embed")
        return records.select("rec_pos", F.when(F.col("title").isNull(), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))

    Box.asked.clear()
    with caplog.at_level(logging.INFO, logger="weftline"):
        d = digest.build(messages(spark, RAW), "News", DAY, DAY, quiet("borderline"), log, counts=counts, embed=embed)
    # The two untitled items have one vector, so they are one cluster of two; the titled story is alone and isn't kept.
    assert Box.asked == ["embed"] and d["story_count"] == 1 and d["stories"][0]["source_count"] == 2
    assert counts == {"messages": 1, "parsed": 3, "after noise": 3, "clusters": 2, "representatives": 2, "kept": 1, "dropped": 1, "borderline": 2}
    assert "pairs judged: 1, same story: 1, undecided: 0" in caplog.text and "parsed: 3" in caplog.text


def test_logging_goes_to_a_rotating_file(tmp_path):
    path = tmp_path / "run.log"
    logs.configure(str(path), max_bytes=400, backups=1)
    for i in range(20):
        logging.getLogger("weftline.plans.digest").info("stage %d", i)
    logs.configure()
    assert "stage 19" in path.read_text() and (tmp_path / "run.log.1").exists() and not (tmp_path / "run.log.2").exists()


def test_a_cap_on_answers_makes_a_batch_invalid(spark):
    items = decisions.number(spark.createDataFrame([(i,) for i in range(6)], "id long"), ["id"], 3)
    cut = decisions.BatchProvider(lambda rows, cap: [{"is_noise": True}] * (len(rows) if rows[0]["batch_no"] else cap), "is_noise boolean", max_tokens=2)
    assert sorted(r.id for r in decisions.drop_noise(items, cut.decide(items)).collect()) == [0, 1, 2]


def test_body_lines_strip_all_white_space(spark):
    got = spark.createDataFrame([("\t* x\n\xa0\n\t\n - y \n-z\n😀 €",)], "b string").select(digest.body_lines(F.col("b")).alias("l")).first().l
    assert [(r.bullet, r.text) for r in got] == [(True, "x"), (True, "y"), (False, "-z"), (False, " €")]


def test_messages_are_parsed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    parsed = mail.parse_mime(messages(spark, RAW, RAW))
    assert segments.parse(parsed.mapInPandas(count, parsed.schema)).count() == 6 and seen.value == 2


def test_a_cluster_needs_a_shared_folder():
    there = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master, applicationId="x"))
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        runtime.shared_root(there("spark://host:7077"))
    assert runtime.shared_root(there("local[4]")).startswith("file:///")


def test_text_files_appear_whole(spark, tmp_path):
    for i in (9, 10):
        runtime.put_text(spark, f"{tmp_path}/m/{i:03d}.json", f"text {i}")
    assert runtime.last_text(spark, f"{tmp_path}/m") == "text 10"
    tmp = runtime.Scratch(spark)
    df = tmp(spark.range(5), "five")
    assert runtime.rows_of(df) == 5 and runtime.rows_of(spark.range(5)) is None
    tmp.drop()
