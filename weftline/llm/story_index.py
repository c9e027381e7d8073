"""Problem 1: each new batch checked against everything accepted before, with a persisted prefix-tree hash forest.

An index is a folder: ``StoryIndex.create`` makes it from a first batch, ``StoryIndex.open`` takes it up in any later
session, ``check`` takes one new batch. A check reads, tokenises and signs the batch only; of the history it reads word
sets of candidates, line counts and the key ranges that hold a prefix of the batch, never a text. A manifest, written
last, names the files that count, so a check that breaks off leaves the index as it was.

Words: a body is folded, markup and addresses are taken out, and its words become 32-bit hashes. Lines in at least
``line_rows`` rows seen so far carry no story when they stand with two accepted stories, and are left out unless little
else is left; lines of a story that is told again and again stand with one, and stay. Of a newsletter with too few
accepted rows repeated lines are all left out. A word's weight is the square of its inverse document frequency; rare
words are those in few rows. Document frequencies are those of the first batch: counted over the arrivals too, a story
told in a third of all rows would turn its own names into common words, and keys of old and new rows would not agree.

Forest: the features of a story are its pairs of neighbouring rare words. ``trees`` independent permutations each give a
key of three MinHash values (32, 16 and 16 bits), so equal leading bits mean equal leading values and each tree is a
sorted column of keys. Entries are kept as runs, partitioned by range (tree and leading bits of the key) and sorted. A
batch's entries are located by range: only the ranges that hold one of their prefixes are read, each once, against at
most ``block_entries`` entries at a time, and no entry of the history is shuffled while the batch is small enough to be
sent. The prefix is widened from the whole key until the expected recall at the least similarity reaches the target; the
ranges of longer prefixes lie within it, so all of them are searched before the smallest first row is chosen. Candidates
are verified exactly: the weight of the shared words over that of the lighter side.

Hot groups: rows with equal word sets are one entry. In a node of the batch every row is compared with the node's first
row only; what isn't told by it or by an accepted row is compared with all rows of the node, in salted blocks of ``block_rows`` by
``block_rows``. A repeat with other words than its first row is entered only where that row's story has no entry with its
prefix yet, so a story told in a third of all rows takes one entry a node. Runs are merged when they are many.

Defined results: null and empty bodies, and bodies without words, repeat nothing; equal ids are not expected; a row's
first row is the smallest one that it or a row it repeats leads to, earlier batches before its own; batches are taken in
ascending order, null batch numbers first; an empty table gives an empty result. The first batch is checked against itself.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.folding import fold
from weftline.llm.hashing import mix, spans, words
from weftline.runtime import Scratch, bounded_broadcast, drop_path, last_text, materialize, put_text, rows_of, scratch, ship


@dataclass(frozen=True)
class Forest:
    """Production parameters. ``known_share`` keeps the broadcast statistics below words-per-row / share entries."""

    trees: int = 12
    least_jaccard: float = 0.35  # of the feature pairs, for which the recall target holds
    recall: float = 0.99
    similarity: float = 0.74  # weighted containment of two tellings of one story
    rare_share: float = 0.004  # rows with a word, above which it makes no feature
    known_share: float = 0.0001  # rows with a word, below which all words weigh the same
    usual_share: float = 0.05  # rows with a word, above which it is left out of the comparison
    line_rows: int = 8
    least_words: int = 8
    range_entries: int = 4_000_000  # entries of the first batch in one key range
    block_entries: int = 1_000_000  # entries of a batch looked up at a time
    block_rows: int = 64
    sent_lines: int = 200_000  # repeated lines of a batch that are sent to every task; more are joined
    max_runs: int = 6
    waiting_share: float = 0.25  # of the accepted rows, which batches that wait must hold to be checked

    def depth(self) -> int:
        """Prefix length in values: the whole key, widened until the expected recall at the least similarity reaches the target."""
        depth = 3
        while depth > 1 and 1 - (1 - self.least_jaccard**depth) ** self.trees < self.recall:
            depth -= 1
        return depth


_MARKUP = re.compile(r"<[^<>\n]*>?|https?://\S+|\\[a-z]+\{?|\{\{[a-z]+\||&#?\w+;|\{\|[^\n]*")
_SHIFT = {3: 0, 2: 16, 1: 32}
_ROW = np.uint64(0xD6E8FEB86659FD93)
#: Stands for the source itself among its lines.
_SOURCE = np.uint64(0x5851F42D4C957F2D)
_RANGE_BITS = 16


def _plain(body: str) -> str:
    t = fold(body)
    if "<" in t or "://" in t or "\\" in t or "{" in t or "&" in t:
        t = _MARKUP.sub(" ", t)
    return t.lower()


def _lists(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False), np.repeat(np.arange(len(column)), sizes)


def _as_lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """A list column of ``n`` rows from values in row order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.array(values))


def _in_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(values.astype(np.uint64) + row.astype(np.uint64) * _ROW)


def _once(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Indices of the first of equal values in a row."""
    return np.sort(np.unique(_in_row(values, row), return_index=True)[1])


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a, z in spans(pc.utf8_length(whole.column("body")).to_pylist()):
            yield _tokens_of(whole.slice(a, z - a))


def _tokens_of(b: pa.RecordBatch) -> pa.RecordBatch:
    n = b.num_rows
    h, row, first, start = words(data := [_plain(x).encode("utf-8", "surrogatepass") for x in b.column("body").to_pylist()])
    joined = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    line = np.cumsum(joined == 10)[start] if len(start) else start
    new = np.flatnonzero(np.diff(line, prepend=-1)) if len(start) else np.zeros(0, np.int64)
    letters = (first < 48) | (first > 57)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(np.where(letters, mix(h), np.uint64(0)), new) if len(new) else np.zeros(0, np.uint64)
        source = pd.util.hash_array(np.array([x or "" for x in b.column("source").to_pylist()], object)).astype(np.uint64)
        keys = np.where(sums == 0, np.uint64(0), mix(sums + mix(source)[row[new]] if len(new) else sums))
    lengths = np.diff(np.append(new, len(start))).astype(np.int32)
    of = row[new] if len(new) else new
    return pa.RecordBatch.from_arrays([
        b.column("id"), pa.array(mix(source ^ _SOURCE).view(np.int64)), _as_lists((h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), row, n), _as_lists(keys.view(np.int64), of, n), _as_lists(lengths, of, n),
    ], ["id", "src", "words", "lines", "sizes"])


_TOKENS = "id long, src long, words array<int>, lines array<long>, sizes array<int>"


def _sums(values: np.ndarray, told: np.ndarray) -> pa.RecordBatch:
    h, back = np.unique(values, return_inverse=True)
    n = [np.bincount(back, weights=w, minlength=len(h)).astype(np.int64) for w in (None, told)]
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n[0]), pa.array(n[1])], ["h", "n", "told"])


def _count(column: str):
    """(h, n, told): rows with each word, or with each line and of each source, summed within the task; ``told`` counts rows that are ``new``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            v, row = _lists(b.column(column), np.int64)
            told = b.column("new").to_numpy(zero_copy_only=False).astype(np.float64)
            once = _once(v, row)
            once = once[v[once] != 0] if column == "lines" else once
            held.append((v[once], told[row[once]]))
            if column == "lines":
                held.append((b.column("src").to_numpy(), told))
            if sum(len(x) for x, _ in held) > 2_000_000:
                yield _sums(*(np.concatenate(x) for x in zip(*held)))
                held.clear()
        if held:
            yield _sums(*(np.concatenate(x) for x in zip(*held)))

    return run


class Statistics:
    """Document frequencies above ``known_share``: bounded, whatever the number of rows."""

    def __init__(self, rows: int, words_: np.ndarray, counts: np.ndarray, p: Forest) -> None:
        order = np.argsort(words_)
        self.rows, self.words, self.counts, self.p = max(rows, 1), words_[order], counts[order].astype(np.float64), p

    def frequency(self, w: np.ndarray) -> np.ndarray:
        floor = max(1.0, self.rows * self.p.known_share)
        if not len(self.words):
            return np.full(len(w), floor)
        i = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[i] == w, np.maximum(self.counts[i], floor), floor)

    def weight(self, w: np.ndarray) -> np.ndarray:
        return np.log((self.rows + 1) / self.frequency(w)) ** 2


@dataclass
class _Lines:
    """Repeated lines in their two kinds, and sources with enough accepted rows; sorted, and few enough to be sent."""

    sure: np.ndarray
    doubtful: np.ndarray
    known: np.ndarray

    def house(self, line: np.ndarray, source: np.ndarray) -> np.ndarray:
        return np.isin(line, self.sure) | np.isin(line, self.doubtful) & ~np.isin(source, self.known)


def _sign(shared, lines):
    """Word sets and forest keys of every row without the lines that carry no story: those of ``lines``, or of the row's own list ``house``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Statistics = shared.value
        p = s.p
        seeds = np.random.default_rng(7).integers(1, 1 << 62, (p.trees, 3), dtype=np.uint64)
        for b in batches:
            n = b.num_rows
            w, row = _lists(b.column("words"), np.int64)
            line, of = _lists(b.column("lines"), np.int64)
            size, _ = _lists(b.column("sizes"), np.int64)
            if lines is not None:
                house = lines.value.house(line, b.column("src").to_numpy()[of])
            else:
                gone, gone_of = _lists(b.column("house"), np.int64)
                house = np.isin(_in_row(line, of), _in_row(gone, gone_of))
            story = np.repeat(~house, size)
            df = s.frequency(w)
            sets = _once(w, row)
            left = np.bincount(row[sets][story[sets] & (df[sets] <= s.rows * p.usual_share)], minlength=n)
            story |= (left < p.least_words)[row]
            # A word of a house line may come first in the row and again in the story: sets are taken after the lines are out.
            w, row, df = w[story], row[story], df[story]
            sets = _once(w, row)
            sets = sets[df[sets] <= max(s.rows * p.usual_share, 4)]
            order = sets[np.lexsort((w[sets], row[sets]))]
            weight = np.log((s.rows + 1) / df) ** 2
            total = np.bincount(row[order], weights=weight[order], minlength=n)
            rare = np.flatnonzero(df <= max(s.rows * p.rare_share, 4))
            a, ra = w[rare].astype(np.uint64), row[rare]
            with np.errstate(over="ignore"):
                pair = mix(a[:-1] * _ROW + a[1:]) if len(a) > 1 else np.zeros(0, np.uint64)
                same = ra[:-1] == ra[1:] if len(a) > 1 else np.zeros(0, bool)
                feature, fr = pair[same], ra[:-1][same] if len(a) > 1 else ra[:0]
                # Rows without a pair: their words one by one.
                alone = np.setdiff1d(row[order], fr)
                if len(alone):
                    extra = order[np.isin(row[order], alone)]
                    feature, fr = np.concatenate([feature, mix(w[extra].astype(np.uint64))]), np.concatenate([fr, row[extra]])
                    by = np.argsort(fr, kind="stable")
                    feature, fr = feature[by], fr[by]
                starts = np.flatnonzero(np.diff(fr, prepend=-1)) if len(fr) else np.zeros(0, np.int64)
                keys = np.zeros((len(starts), p.trees), np.int64)
                for t in range(p.trees if len(starts) else 0):
                    v = [mix(np.minimum.reduceat(mix(feature ^ seeds[t, k]), starts)) for k in range(3)]
                    keys[:, t] = ((v[0] & np.uint64(0xFFFFFFFF00000000)) | ((v[1] >> np.uint64(48)) << np.uint64(16)) | (v[2] >> np.uint64(48))).view(np.int64)
                digest = np.zeros(n, np.uint64)
                np.add.at(digest, row[order], mix(w[order].astype(np.uint64) ^ _SOURCE))
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array(digest.view(np.int64)), _as_lists(w[order].astype(np.int32), row[order], n), pa.array(total), _as_lists(keys.ravel(), np.repeat(fr[starts], p.trees), n),
            ], ["id", "digest", "words", "total", "keys"])

    return run


_ROWS = "id long, digest long, words array<int>, total double, keys array<long>"


def _alike(shared):
    """Of pairs with both word sets those whose rows tell the same story."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Statistics = shared.value
        for b in batches:
            (x, xr), (y, yr) = (_lists(b.column(c), np.uint32) for c in ("a", "b"))
            both = np.intersect1d(xr.astype(np.uint64) << np.uint64(32) | x, yr.astype(np.uint64) << np.uint64(32) | y, assume_unique=True)
            shared_words = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32).astype(np.int64)
            weight = np.bincount((both >> np.uint64(32)).astype(np.int64), weights=s.weight(shared_words), minlength=b.num_rows)
            least = np.minimum(b.column("at").to_numpy(), b.column("bt").to_numpy())
            keep = pa.array(weight >= s.p.similarity * np.maximum(least, 1e-9))
            yield b.select(["id", "first"]).filter(keep)

    return run


def _node(depth: int) -> Column:
    """One number for a tree's node at a prefix length."""
    return F.shiftleft(F.col("tree").cast("long"), 32) + F.shiftrightunsigned("key", 32) if depth == 1 else F.xxhash64("tree", F.shiftright("key", _SHIFT[depth]))


@dataclass
class _Manifest:
    """What an index consists of: its parameters, counts of the first batch, bits of a key that name its range, and the files of each kind."""

    params: dict
    rows: int = 0
    bits: int = 0
    batches: int = 0
    forest: list[str] = field(default_factory=list)
    stories: list[str] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)


class StoryIndex:
    """The persisted forest: word sets of accepted stories, sorted runs of their keys, and line counts, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, manifest: _Manifest) -> None:
        self.spark, self.path, self.m, self.p = spark, path, manifest, Forest(**manifest.params)
        ship(spark)
        w = spark.read.schema("h long, n long").parquet(f"{path}/words").toPandas() if manifest.batches else pd.DataFrame({"h": [], "n": []})
        self.shared = spark.sparkContext.broadcast(Statistics(manifest.rows, w["h"].to_numpy(np.int64), w["n"].to_numpy(np.int64), self.p))

    @classmethod
    def create(cls, spark: SparkSession, path: str, first: DataFrame, p: Forest | None = None) -> tuple[StoryIndex, DataFrame]:
        """A new index below ``path`` (which must not exist) from the rows (id, source, body) of a first batch, and that batch's own repeats."""
        p = p or Forest()
        ship(spark)
        tmp = Scratch(spark)
        tokens = cls._tokens(first, tmp)
        rows = rows_of(tokens)
        least = max(2, math.ceil(rows * p.known_share))
        counted = tokens.select("words", F.lit(True).alias("new")).mapInArrow(_count("words"), "h long, n long, told long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        counted.write.parquet(f"{path}/words")
        bits = min(_RANGE_BITS, max(0, math.ceil(math.log2(max(1, rows) / p.range_entries))))
        index = cls(spark, path, _Manifest(asdict(p), rows, bits, 1))
        found = index._take(tokens, tmp)
        tmp.drop()
        return index, found

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StoryIndex:
        """The index below ``path`` as its last complete check left it."""
        return cls(spark, path, _Manifest(**json.loads(last_text(spark, f"{path}/manifest"))))

    def check(self, batch: DataFrame) -> DataFrame:
        """(id, first) of the rows of ``batch`` (id, source, body) that repeat an accepted row or each other; the rest is accepted."""
        tmp = Scratch(self.spark)
        found = self._take(self._tokens(batch, tmp), tmp)
        tmp.drop()
        return found

    @staticmethod
    def _tokens(batch: DataFrame, tmp: Scratch) -> DataFrame:
        kept = batch.where(F.col("body").rlike(r"(?U)\w")).select(F.col("id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), F.col("body").cast("string").alias("body"))
        return tmp(kept.mapInArrow(_tokenise, _TOKENS), "story-tokens")

    def _named(self, kind: str) -> str:
        return f"{self.path}/{kind}/batch={self.m.batches}"

    def _runs(self, names: list[str], schema: str) -> DataFrame:
        base = f"{self.path}/{names[0].split('/')[0]}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{self.path}/{n}" for n in names)).drop("batch")

    def _take(self, tokens: DataFrame, tmp: Scratch) -> DataFrame:
        here = tmp(self._counted(tokens.select("src", "lines", F.lit(False).alias("new"))), "story-lines")
        rows = tmp(self._signed(tokens, here, tmp), "story-rows")
        rows = rows.where(F.size("keys") > 0)
        # Equal word sets are one row; the copies follow their first one.
        sets = rows.groupBy("digest", "total").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
        copies = bounded_broadcast(tmp(rows.select("id", "digest", "total").join(sets, ["digest", "total"]).where("id <> first").select("id", "first"), "story-copies"))
        batch = rows.join(copies.select("id"), "id", "left_anti").select("id", "words", "total", "keys")
        place = F.shiftleft(F.col("tree"), self.m.bits) + F.shiftrightunsigned("key", 64 - self.m.bits).cast("int") if self.m.bits else F.col("tree")
        entries = tmp(batch.select("id", F.posexplode("keys").alias("tree", "key")).withColumn("part", place), "story-entries")
        batch = batch.drop("keys")
        shared = self._nodes(entries, tmp)
        near = self._near(entries, tmp)
        stories = batch.select("id", F.lit(None).cast("long").alias("first"), "words", "total")
        if self.m.forest:
            stories = stories.unionByName(self._runs(self.m.stories, "id long, first long, words array<int>, total double"))
        # One comparison for both: the first rows of the stories in a row's nodes, and the first rows of its nodes in the batch.
        roots = near.select("id", F.col("first").alias("other")).unionByName(shared.where("id <> other").select("id", "other"))
        told = tmp(_least(self._verified(roots, batch, stories, tmp)), "story-hits")
        # Variants only where their story's own first row, or an earlier one, isn't told.
        links = [told, *self._variants(near, told, batch, stories, tmp), *self._within(shared, told, batch, tmp)]
        firsts = _roots(links, tmp)
        copied = copies.withColumnRenamed("first", "up").join(bounded_broadcast(firsts).withColumnsRenamed({"id": "up"}), "up", "left").select("id", F.coalesce("first", "up").alias("first"))
        found = materialize(firsts.unionByName(copied), "found", self._named("found"))
        self._accept(tokens, here, batch, entries, firsts, found, near.select("id", "tree", "first"))
        return found

    def _signed(self, tokens: DataFrame, here: DataFrame, tmp: Scratch) -> DataFrame:
        """The batch's rows without the lines that carry no story. ``here``: line counts of the batch."""
        if self.m.lines:
            before = self._runs(self.m.lines, "h long, n long, told long").join(bounded_broadcast(here).select("h"), "h", "left_semi")
            here = here.unionByName(before).groupBy("h").agg(F.sum("n").alias("n"), F.sum("told").alias("told"))
        judged = tmp(here.where(F.col("n") >= self.p.line_rows).select("h", "told"), "story-judged")
        if rows_of(judged) <= self.p.sent_lines:
            x = judged.toPandas()
            h, told = x["h"].to_numpy(np.int64), x["told"].to_numpy(np.int64)
            lines = _Lines(h[told >= 2], h[told < 2], h[told >= self.p.line_rows])
            return tokens.mapInArrow(_sign(self.shared, self.spark.sparkContext.broadcast(lines)), _ROWS)
        each = tokens.select("id", F.explode(F.concat(F.array(F.struct(F.col("src").alias("h"), F.lit(True).alias("own"))), F.transform("lines", lambda x: F.struct(x.alias("h"), F.lit(False).alias("own"))))).alias("x")).select("id", "x.h", "x.own")
        lines = F.collect_set(F.when(~F.col("own"), F.struct("h", (F.col("told") >= 2).alias("sure"))))
        by_row = each.join(judged, "h").groupBy("id").agg(F.max(F.col("own") & (F.col("told") >= self.p.line_rows)).alias("known"), lines.alias("lines"))
        house = by_row.select("id", F.transform(F.filter("lines", lambda x: x["sure"] | ~F.col("known")), lambda x: x["h"]).alias("house")).where(F.size("house") > 0)
        return tokens.join(house, "id", "left").mapInArrow(_sign(self.shared, None), _ROWS)

    @staticmethod
    def _counted(lines: DataFrame) -> DataFrame:
        return lines.mapInArrow(_count("lines"), "h long, n long, told long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("told").alias("told"))

    def _blocks(self, entries: DataFrame) -> Iterator[tuple[list[int], DataFrame]]:
        """Key ranges with the entries that fall into them, at most ``block_entries`` at a time.

        One row a range reaches the driver. A range with more entries is taken in several blocks by a hash of the row.
        """
        sizes = sorted((r["part"], r["count"]) for r in entries.groupBy("part").count().collect())
        taken, held = [], 0
        for part, n in sizes:
            slices = math.ceil(n / self.p.block_entries)
            if slices > 1:
                for i in range(slices):
                    yield [part], entries.where((F.col("part") == part) & (F.pmod(F.xxhash64("id"), F.lit(slices)) == i))
                continue
            if held + n > self.p.block_entries and taken:
                yield taken, entries.where(F.col("part").isin(taken))
                taken, held = [], 0
            taken.append(part)
            held += n
        if taken:
            yield taken, entries if len(taken) == len(sizes) else entries.where(F.col("part").isin(taken))

    def _verified(self, pairs: DataFrame, batch: DataFrame, others: DataFrame, tmp: Scratch) -> DataFrame:
        """(id, other): pairs that tell the same story. Word sets are cut to those of the pairs before they are shuffled."""
        pairs = bounded_broadcast(tmp(pairs.distinct(), "story-pairs"))
        left = batch.join(pairs, "id").select("id", "other", F.col("words").alias("a"), F.col("total").alias("at"))
        right = others.join(pairs.select(F.col("other").alias("id")), "id", "left_semi").select(F.col("id").alias("other"), F.col("words").alias("b"), F.col("total").alias("bt"))
        both = left.join(right, "other").select("id", F.col("other").alias("first"), "a", "at", "b", "bt")
        return both.mapInArrow(_alike(self.shared), "id long, first long").withColumnRenamed("first", "other")

    def _near(self, entries: DataFrame, tmp: Scratch) -> DataFrame:
        """(id, tree, other, first): accepted rows in the nodes of the batch, ``first`` being the row that ``other`` repeats or itself.

        The prefix is widened from the whole key to the length whose expected recall reaches the target. As a longer
        prefix's range lies within the shorter one's, each block of ranges is read once and searched at the last length.
        """
        seen = []
        for parts, block in self._blocks(entries) if self.m.forest else ():
            forest = self._runs(self.m.forest, "tree int, key long, id long, first long, part int").where(F.col("part").isin(parts))
            node = F.broadcast(block.select("id", "tree", _node(self.p.depth()).alias("node")))
            seen.append(tmp(forest.select(F.col("id").alias("other"), F.coalesce("first", "id").alias("first"), _node(self.p.depth()).alias("node")).join(node, "node").select("id", "tree", "other", "first"), "story-near"))
        near = seen[0] if seen else self.spark.createDataFrame([], "id long, tree int, other long, first long")
        for x in seen[1:]:
            near = near.unionByName(x)
        return near

    def _variants(self, near: DataFrame, told: DataFrame, batch: DataFrame, stories: DataFrame, tmp: Scratch) -> list[DataFrame]:
        """(id, first) found through accepted repeats with other words than their first row, of rows that first row or a smaller one doesn't tell."""
        if not self.m.forest:
            return []
        more = near.where("other <> first").select("id", "other", "first").distinct().join(bounded_broadcast(told).withColumnRenamed("first", "have"), "id", "left").where("have IS NULL OR first < have").drop("have")
        more = tmp(more, "story-variants")
        if not rows_of(more):
            return []
        few = [r.other for r in more.select("other").distinct().collect()] if rows_of(more) <= 1000 else None
        if few:
            # Few candidates: their ids prune the files, which are sorted by id.
            stories = stories.where(F.col("id").isin(few))
        return [tmp(self._verified(more.select("id", "other"), batch, stories, tmp).join(more, ["id", "other"]).select("id", "first"), "story-variants")]

    def _nodes(self, entries: DataFrame, tmp: Scratch) -> DataFrame:
        """(id, node, other, n): rows of the batch that share a node, with its first row and size."""
        keyed = entries.select("id", _node(self.p.depth()).alias("node"))
        nodes = tmp(keyed.groupBy("node").agg(F.min("id").alias("other"), F.count("*").alias("n")).where("n > 1"), "story-nodes")
        return tmp(keyed.join(bounded_broadcast(nodes, 500_000), "node"), "story-shared")

    def _within(self, shared: DataFrame, told: DataFrame, batch: DataFrame, tmp: Scratch) -> list[DataFrame]:
        """(id, first): links within the batch of rows that no first row of a node or story tells."""
        open_ = tmp(shared.where("id <> other").join(bounded_broadcast(told).select("id"), "id", "left_anti").select("node", "id", "n"), "story-open")
        if not rows_of(open_):
            return []
        # The rest against all rows of its nodes, in blocks: each meets every salt of the other side once.
        sizes = open_.groupBy("node", "n").agg(F.count("*").alias("m"))
        sizes = sizes.select("node", F.ceil(F.col("m") / self.p.block_rows).cast("int").alias("rows"), F.ceil(F.col("n") / self.p.block_rows).cast("int").alias("cols"))
        salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        x = open_.drop("n").join(sizes, "node").select("node", "id", salt("rows").alias("r"), upto("cols").alias("c"))
        y = shared.where("id <> other").join(sizes, "node").select("node", F.col("id").alias("other"), salt("cols").alias("c"), upto("rows").alias("r"))
        pairs = x.join(y, ["node", "r", "c"]).where("other < id").select("id", "other")
        return [tmp(self._verified(pairs, batch, batch, tmp).select("id", F.col("other").alias("first")), "story-rest")]

    def _accept(self, tokens: DataFrame, here: DataFrame, batch: DataFrame, entries: DataFrame, firsts: DataFrame, found: DataFrame, leads: DataFrame) -> None:
        """Add the batch: word sets, entries as a sorted run, line counts; then the manifest."""
        firsts = bounded_broadcast(firsts)
        rows = batch.join(firsts, "id", "left").select("id", "first", "words", "total")
        rows.sortWithinPartitions("id").write.mode("overwrite").parquet(f"{self.path}/{(stories := self._relative('stories'))}")
        new = entries.join(firsts, "id", "left")
        plain, variants = new.where("first IS NULL"), new.where("first IS NOT NULL")
        variants = variants.join(leads, ["id", "tree", "first"], "left_anti")
        # A variant only where its story, in this batch too, has no entry of that prefix.
        node = _node(self.p.depth())
        variants = variants.withColumn("node", node).groupBy("part", "node", "first").agg(F.min_by(F.struct("tree", "key", "id"), "id").alias("e"))
        held = plain.select(node.alias("node"), F.col("id").alias("first"))
        variants = variants.join(held, ["node", "first"], "left_anti").select("part", "e.tree", "e.key", "e.id", "first")
        run = plain.select("part", "tree", "key", "id", "first").unionByName(variants)
        names = self.m.forest
        if len(names) >= max(2, self.p.max_runs):
            # The first run, the first batch, is never rewritten.
            run = self._runs(names[1:], "tree int, key long, id long, first long, part int").select("part", "tree", "key", "id", "first").unionByName(run)
            names = names[:1]
        forest = self._relative("forest")
        run.repartitionByRange("part", "key").sortWithinPartitions("part", "key").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{forest}")
        # ``told`` counts rows that tell a new story: all but those found.
        again = self._counted(tokens.join(bounded_broadcast(found).select("id"), "id", "left_semi").select("src", "lines", F.lit(False).alias("new"))).select("h", F.col("n").alias("again"))
        counts, line_runs = here.join(again, "h", "left").select("h", "n", (F.col("n") - F.coalesce("again", F.lit(0))).alias("told")), self.m.lines
        if len(line_runs) >= max(2, self.p.max_runs):
            counts = self._runs(line_runs[1:], "h long, n long, told long").unionByName(counts).groupBy("h").agg(F.sum("n").alias("n"), F.sum("told").alias("told"))
            line_runs = line_runs[:1]
        lines = self._relative("lines")
        counts.write.mode("overwrite").parquet(f"{self.path}/{lines}")
        former = set(self.m.forest) | set(self.m.lines)
        self.m.forest, self.m.lines, self.m.stories = [*names, forest], [*line_runs, lines], [*self.m.stories, stories]
        self.m.batches += 1
        put_text(self.spark, f"{self.path}/manifest/{self.m.batches:09d}.json", json.dumps(asdict(self.m)))
        for gone in former - set(self.m.forest) - set(self.m.lines):
            drop_path(self.spark, f"{self.path}/{gone}")

    def _relative(self, kind: str) -> str:
        return self._named(kind)[len(self.path) + 1 :]


def _roots(links: list[DataFrame], tmp: Scratch) -> DataFrame:
    """Every linked row with the first row its links lead to, through other rows of its batch too."""
    both = links[0]
    for x in links[1:]:
        both = both.unionByName(x)
    now = tmp(both.groupBy("id").agg(F.min("first").alias("first")), "story-roots") if len(links) > 1 else links[0]
    while True:
        moving = tmp(now.join(bounded_broadcast(now).select(F.col("id").alias("first"), F.col("first").alias("up")), "first").select("id", "up"), "story-moving")
        if not rows_of(moving):
            return now
        now = tmp(now.join(bounded_broadcast(moving), "id", "left").select("id", F.coalesce("up", "first").alias("first")), "story-roots")


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("id").agg(F.min("other").alias("first"))


def repeats(
    df: DataFrame, key: str = "rec_id", body: str = "body", source: str = "newsletter", batch: str = "batch_no", p: Forest | None = None, batches_per_check: int | None = None, path: str | None = None,
) -> DataFrame:
    """(first_<key>, <key>) of every row that repeats an earlier one, by an index that is created below ``path`` from the first batch and takes the later ones in order.

    The later batches are a backlog here: as each check reads the key ranges it needs once, batches that wait are checked
    together, in order, once they hold ``waiting_share`` of the accepted rows, or ``batches_per_check`` at a time.
    """
    spark = df.sparkSession
    p = p or Forest()
    c = lambda n: F.col(f"`{n}`")
    rows = df.select(c(key).alias("id"), F.coalesce(c(batch).cast("int"), F.lit(-1)).alias("batch"), c(source).alias("source"), c(body).alias("body"))
    sizes = [(r["batch"], r["count"]) for r in rows.groupBy("batch").count().orderBy("batch").collect()]
    out = spark.createDataFrame([], "id long, first long")
    if sizes:
        index, own = StoryIndex.create(spark, path or scratch(spark, "story-index"), rows.where(F.col("batch") == sizes[0][0]), p)
        out, accepted = out.unionByName(own), sizes[0][1]
    waiting: list[int] = []
    held = 0
    for i, (number, n) in enumerate(sizes[1:], 2):
        waiting.append(number)
        held += n
        if i == len(sizes) or (held >= p.waiting_share * accepted if batches_per_check is None else len(waiting) >= batches_per_check):
            out = out.unionByName(index.check(rows.where(F.col("batch").between(waiting[0], number))))
            accepted, waiting, held = accepted + held, [], 0
    return out.select(F.col("first").alias(f"first_{key}"), F.col("id").alias(key))
