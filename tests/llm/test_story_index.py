"""The persisted index: reopened in another session, searched by key ranges, hot nodes in blocks."""

import shutil
from dataclasses import replace
from pathlib import Path

from pyspark.sql import functions as F

from tests.llm.test_llm import stories_table, story
from weftline.llm.story_index import Forest, StoryIndex, repeats

SCHEMA = "id long, batch int, source string, body string"


def pairs(df):
    return {r.id: r.first for r in df.collect()}


def test_an_index_is_taken_up_in_another_session(spark, tmp_path):
    rows, want = stories_table()
    df = spark.createDataFrame(rows, SCHEMA)
    path, got = str(tmp_path / "index"), {}
    _, own = StoryIndex.create(spark, path, df.where("batch = 0").drop("batch"))
    got |= pairs(own)
    for b in (1, 2, 3):
        other = spark.newSession()
        only = other.createDataFrame([r for r in rows if r[1] == b], SCHEMA).drop("batch")
        index = StoryIndex.open(other, path)
        assert index.m.batches == b + 1
        found = index.check(only)
        got |= pairs(found)
        # Nothing but the batch's own rows was tokenised: the files hold each row with words once, under its batch.
        assert {r.id for r in other.read.parquet(f"{path}/stories/batch={b + 1}").collect()} <= {r[0] for r in rows if r[1] == b}
    assert got == want
    # A check that broke off before its manifest was written leaves the index as it was.
    (Path(path) / "manifest" / "000000005.json").unlink()
    assert not any("batch=4" in x for x in [*StoryIndex.open(spark, path).m.stories, *StoryIndex.open(spark, path).m.forest])
    again = StoryIndex.open(spark, path).check(spark.createDataFrame([r for r in rows if r[1] == 3], SCHEMA).drop("batch"))
    assert pairs(again) == {k: v for k, v in want.items() if k in {r[0] for r in rows if r[1] == 3}}


def test_only_key_ranges_of_the_batch_are_read(spark, tmp_path):
    p = replace(Forest(), range_entries=10)
    history = [(i, "n", "\n".join(story(i))) for i in range(80)]
    new = [(500, "m", " ".join(story(7)))]
    schema = "id long, source string, body string"
    path = tmp_path / "index"
    index, own = StoryIndex.create(spark, str(path), spark.createDataFrame(history, schema), p)
    assert index.m.bits == 3 and not own.count()
    rows = spark.read.parquet(str(path / "stories" / "batch=1"))
    assert rows.count() == 80
    # The batch has one key a tree, so it can touch at most one range of each tree; the others are taken away.
    probe, _ = StoryIndex.create(spark, str(tmp_path / "probe"), spark.createDataFrame(new, schema), p)
    forest = spark.read.parquet(str(path / "forest" / "batch=1"))
    keys = {(r.tree, r.key) for r in forest.where("id = 7").collect()}
    touched = {(tree << 3) + ((key & (1 << 64) - 1) >> 61) for tree, key in keys}
    parts = {int(x.name[5:]) for x in (path / "forest" / "batch=1").glob("part=*")}
    assert len(touched) == 12 and len(parts) > 3 * len(touched)
    for x in parts - touched:
        shutil.rmtree(path / "forest" / "batch=1" / f"part={x}")
    assert pairs(StoryIndex.open(spark, str(path)).check(spark.createDataFrame(new, schema))) == {500: 7}


def test_blocks_give_the_same_rows(spark):
    """Many different stories that share a rare pair of names fill one node; blocks of entries and of rows don't change what is found."""
    rows = []
    for b in range(3):
        for i in range(60):
            n = b * 1000 + i
            body = story(n % 1000 if b < 2 or i % 2 else 5000 + i, 5)
            rows.append((n, b, f"n{i % 3}", "\n".join(["Qorvex Talbrin spoke there.", *body, *(story(7000 + n, 1) if b == 2 else [])])))
    df = spark.createDataFrame(rows, "rec_id long, batch_no int, newsletter string, body string")
    whole = {tuple(r) for r in repeats(df, p=replace(Forest(), line_rows=10**9)).collect()}
    small = {tuple(r) for r in repeats(df, p=replace(Forest(), line_rows=10**9, block_rows=3, block_entries=50, range_entries=20, max_runs=2)).collect()}
    assert whole == small and {(i, 1000 + i) for i in range(60)} <= whole and {(i, 2000 + i) for i in range(1, 60, 2)} <= whole and not {b for _, b in whole} & set(range(2000, 2060, 2))


def test_a_repeat_with_more_text_leads_on(spark):
    """x tells h and goes on, y tells only what x added: y follows x to h, in a later batch or the same one."""
    h, more = story(1, 5), story(2, 5)
    for batch in (1, 2):
        rows = [(i, 0, "n", " ".join(story(50 + i))) for i in range(30)] + [(30, 0, "n", " ".join(h)), (40, 1, "m", " ".join(h + more)), (50, batch, "k", " ".join(more))]
        df = spark.createDataFrame(rows, "rec_id long, batch_no int, newsletter string, body string")
        for per_check in (None, 1):
            assert {tuple(r) for r in repeats(df, batches_per_check=per_check).collect()} == {(30, 40), (30, 50)}


def test_defined_results(spark):
    body = " ".join(story(3))
    rows = [(1, None, None, body), (2, 0, None, body), (3, 0, None, None), (4, 0, "n", ""), (5, 1, "n", " … "), (6, 1, "n", body + " " + "x" * 100_000), (7, 1, "n", "short"), (8, 2, "n", "short")]
    df = spark.createDataFrame(rows, "rec_id long, batch_no int, newsletter string, body string").withColumn("id", F.lit(0)).withColumn("first", F.lit("x"))
    assert {tuple(r) for r in repeats(df).collect()} == {(1, 2), (1, 6), (7, 8)}
    assert repeats(df.limit(0)).count() == 0
