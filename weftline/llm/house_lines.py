"""Problem 6: lines that one source prints again and again.

1. Masking: numbers and dates go, names (capitalised words) go; a line has two LSH codes, each of ``_SEEDS`` MinHash
   values: one over the words that are left, one over the five-letter runs of its letters, look-alikes undone and without
   case. The second one depends on the letters alone, so lines with equal letters share it however they are spaced,
   numbered or marked.
2. Clusters: lines of one source with a code in common. A cluster's document frequency counts rows, each once, summed
   in every task before the shuffle, so a line printed in a third of all rows is one number a task.
3. Lines of clusters with a high document frequency are candidates; all others, nearly all lines, are never counted or
   compared. ``exact=True`` (the statement of this project) keeps candidates whose letters are in at least ``min_rows``
   rows; ``exact=False`` removes whole clusters, near-duplicates of house lines with them.

Python reads each body once, as arrays over a whole batch. Defined results: null or empty bodies have no lines; lines
without letters are never found; a null source is a source of its own; rows with one id count once; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.folding import SUSPECT, fold
from weftline.llm.hashing import mix, powers, spans, words
from weftline.runtime import bounded_broadcast, materialize, ship

_SUSPECT = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m.group(1), 16)), SUSPECT))
_SEEDS = np.random.default_rng(13).integers(1, 1 << 63, 3, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RUN = 5


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points are letters, and two random numbers of each."""
    is_letter = np.array([ud.category(chr(o))[0] == "L" for o in range(0x110000)])
    return is_letter, *np.random.default_rng(12).integers(1, 1 << 63, (2, 0x110000), dtype=np.uint64)


def _signature(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One code for the MinHash values of every run of ``values``."""
    code = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for seed in _SEEDS:
            code = mix(code + np.minimum.reduceat((values ^ seed) * _ODD, starts))
    return code


def line_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line: number of letters, two hashes of its letters, LSH code of its letter runs, LSH code of its unmasked words (0 without any)."""
    joined = "\n".join(lines)
    if not joined.isascii():
        odd = np.unique(np.searchsorted(np.cumsum([len(x) + 1 for x in lines]), [m.start() for m in _SUSPECT.finditer(joined)], side="right"))
        if len(odd):
            lines = list(lines)
            for i in odd:
                lines[i] = fold(lines[i])
            joined = "\n".join(lines)
        plain = ud.normalize("NFC", ud.normalize("NFC", joined).casefold())
    else:
        plain = joined.lower()
    n = len(lines)
    is_letter, *random = _letters()
    points = np.frombuffer((plain + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(is_letter[points])
    line = np.cumsum(points == 10, dtype=np.int32)[at]
    count = np.bincount(line, minlength=n)
    starts = np.concatenate([[0], np.cumsum(count)])
    power, inverse = powers(len(at) + 1)
    values, out = [r[points[at]] for r in random], []
    with np.errstate(over="ignore"):
        for v in values:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * power[: len(at)], dtype=np.uint64)])
            out.append(mix((sums[starts[1:]] - sums[starts[:-1]]) * inverse[starts[:-1]]))
        least = out[0].copy()
        if len(at) >= _RUN:
            run = values[0][: len(at) - _RUN + 1].copy()
            for i in range(1, _RUN):
                run *= power[1]
                run += values[0][i : len(run) + i]
            run = mix(run)
            inside = np.flatnonzero(line[: len(run)] == line[_RUN - 1 :])
            if len(inside):
                of = line[inside]
                first = np.flatnonzero(np.diff(of, prepend=-1))
                least[of[first]] = _signature(run[inside], first)
        h, of, first, _ = words([x.encode("utf-8", "surrogatepass") for x in lines])
        kept = np.flatnonzero(((first >= 97) & (first <= 122)) | (first > 127))
        masked = np.zeros(n, np.uint64)
        if len(kept):
            begin = np.flatnonzero(np.diff(of[kept], prepend=-1))
            masked[of[kept][begin]] = _signature(h[kept], begin)
    return count, out[0], out[1], least, masked


_LINES = "_id {}, _src long, no int, a long, b long, run long, word long"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start, end in spans(pc.utf8_length(whole.column("body")).to_pylist()):
            b = whole.slice(start, end - start)
            bodies = [x.split("\n") for x in b.column("body").to_pylist()]
            sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
            count, *hashes = line_hashes([line for body in bodies for line in body])
            row = np.repeat(np.arange(len(bodies)), sizes)
            no = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = np.flatnonzero(count)
            taken = pa.array(row[kept])
            columns = [b.column("_id").take(taken), b.column("_src").take(taken), pa.array(no[kept].astype(np.int32)), *(pa.array(v[kept].view(np.int64)) for v in hashes)]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_src", "no", "a", "b", "run", "word"])


def lines_of(df: DataFrame, key: str, source: str, body: str) -> DataFrame:
    """One row a line with letters: its place, the hashes of its letters and its two LSH codes."""
    c = lambda n: F.col(f"`{n}`")
    src = F.xxhash64(F.coalesce(c(source).cast("string"), F.lit("\0")))
    kept = df.where(c(body).isNotNull()).select(c(key).alias("_id"), src.alias("_src"), c(body).alias("body"))
    return kept.mapInArrow(_hashed, _LINES.format(kept.schema["_id"].dataType.simpleString()))


def hot_clusters(lines: DataFrame, min_rows: int) -> DataFrame:
    """(_src, code): codes of lines in at least ``min_rows`` rows of a source."""
    codes = F.array("run", F.when(F.col("word") != 0, F.col("word")))
    each = lines.select("_src", "_id", F.explode(codes).alias("code")).where("code IS NOT NULL")
    return each.groupBy("_src", "code", "_id").agg(F.lit(1).alias("one")).groupBy("_src", "code").agg(F.count("*").alias("df")).where(F.col("df") >= min_rows).select("_src", "code")


def candidates(lines: DataFrame, hot: DataFrame) -> DataFrame:
    """Lines of hot clusters. ``hot`` is materialized."""
    for name in ("run", "word"):
        lines = lines.join(bounded_broadcast(hot).select("_src", F.col("code").alias(name), F.lit(True).alias(f"hot_{name}")), ["_src", name], "left")
    return lines.where("hot_run OR hot_word").drop("hot_run", "hot_word")


def repeated_lines(df: DataFrame, key: str, source: str, body: str, min_rows: int = 8, exact: bool = True) -> DataFrame:
    """(key, line_no) of the lines to remove."""
    spark = df.sparkSession
    ship(spark)
    lines = materialize(lines_of(df, key, source, body), "lines")
    found = candidates(lines, materialize(hot_clusters(lines, min_rows), "hot-clusters"))
    if exact:
        found = materialize(found, "candidates")
        keys = found.groupBy("_src", "a", "b", "_id").agg(F.lit(1).alias("one")).groupBy("_src", "a", "b").agg(F.count("*").alias("rows")).where(F.col("rows") >= min_rows)
        found = found.join(bounded_broadcast(materialize(keys.select("_src", "a", "b"), "hot-lines")), ["_src", "a", "b"], "left_semi")
    return found.select(F.col("_id").alias(key), F.col("no").alias("line_no")).distinct()


def without_lines(df: DataFrame, key: str, body: str, found: DataFrame) -> DataFrame:
    """``df`` with the found lines taken out of ``body``; a body of nothing else becomes ''."""
    gone = found.groupBy(key).agg(F.collect_set("line_no").alias("_gone"))
    out = df.join(gone, key, "left")
    kept = F.array_join(F.filter(F.split(F.col(f"`{body}`"), "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return out.select(*(F.when(F.col("_gone").isNull(), F.col(f"`{body}`")).otherwise(kept).alias(body) if c == body else F.col(f"`{c}`") for c in df.columns))
