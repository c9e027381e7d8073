"""Problem 8: the ids of every text by a public byte-level BPE tokenizer, reusing what documents share.

1. Content-defined chunks: a rolling hash over the last 16 bytes cuts each text where its low bits are zero, so equal
   passages give equal chunks wherever they stand. Chunks are counted by a 128-bit hash; only hashes are shuffled.
2. Chunks that occur more than once are encoded once, into a table hash -> ids of the chunk's core. The core runs from
   the chunk's first to its last safe cut; a safe cut lies before a space or line feed that follows a printable ASCII
   character, where the tokenizer's own splitting always starts a new piece, so cores agree with the whole text's ids.
3. Each document takes its shared cores from the table; the joins between them (chunk ends up to the next safe cut, and
   all text that isn't shared) are encoded again as runs that start and end at safe cuts. The ids agree exactly with
   those of the whole text.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text;
every row of a repeated text gets the same ids; an empty table gives an empty result; extra columns are ignored.
The tokenizer's file is a parameter and is loaded once per Python worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import Scratch, ship

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WINDOW = 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut_points(data: bytes, bits: int, least: int) -> list[int]:
    """Ends of the content-defined chunks of one UTF-8 text; the last one is its length."""
    n = len(data)
    if n <= max(2 * least, _WINDOW):
        return [n]
    a = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        h = np.zeros(n - _WINDOW + 1, np.uint64)
        for i in range(_WINDOW):
            h = h * _MULTIPLIER + a[i : n - _WINDOW + 1 + i]
    # Only before the first byte of a character.
    at = np.flatnonzero((h >> np.uint64(64 - bits)) == 0) + _WINDOW
    at = at[(at < n) & ((a[np.minimum(at, n - 1)] & 0xC0) != 0x80)]
    out, last = [], 0
    for p in at.tolist():
        if p - last >= least and n - p >= least:
            out.append(p)
            last = p
    return [*out, n]


def core(chunk: bytes) -> tuple[int, int]:
    """First and last safe cut of a chunk, (0, 0) without two of them."""
    a = np.frombuffer(chunk, np.uint8)
    if len(a) < 3:
        return 0, 0
    safe = np.flatnonzero(((a[1:] == 32) | (a[1:] == 10)) & (a[:-1] > 32) & (a[:-1] < 127)) + 1
    return (int(safe[0]), int(safe[-1])) if len(safe) > 1 else (0, 0)


def _digest(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


def _chunked(bits: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes = []
            for text in b["text"]:
                data = text.encode("utf-8", "surrogatepass")
                ends = cut_points(data, bits, least)
                hashes.append([_digest(data[s:e]) for s, e in zip([0, *ends[:-1]], ends)])
            yield pd.DataFrame({"_id": b["_id"], "hashes": hashes})

    return run


def _cores(path: str, bits: int, least: int):
    """(digest, ids of its core) of every chunk of the texts it is given, for the caller to keep those that are shared."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: dict[bytes, bytes] = {}
            for text, shared in zip(b["text"], b["shared"]):
                data, wanted = text.encode("utf-8", "surrogatepass"), set(map(bytes, shared))
                ends = cut_points(data, bits, least)
                for s, e in zip([0, *ends[:-1]], ends):
                    d = _digest(data[s:e])
                    if d in wanted:
                        rows[d] = data[s:e]
            yield pd.DataFrame({"h": list(rows), "chunk": list(rows.values())})

    return run


def _encode_cores(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(path)
        for b in batches:
            ids = []
            for chunk in b["chunk"]:
                p, q = core(chunk)
                ids.append(enc.encode_ordinary(chunk[p:q].decode()) if p < q else [])
            yield pd.DataFrame({"h": b["h"], "ids": ids})

    return run


def encode_with(enc, text: str, known: dict[bytes, list[int]], bits: int, least: int) -> list[int]:
    """Ids of ``text``: cores of known chunks are taken as they are, the runs between them are encoded."""
    if not known:
        return enc.encode_ordinary(text)
    data = text.encode("utf-8", "surrogatepass")
    out, done, start = [], 0, 0
    for end in cut_points(data, bits, least):
        ids = known.get(_digest(data[start:end]))
        if ids:
            p, q = core(data[start:end])
            out += enc.encode_ordinary(data[done : start + p].decode())
            out += ids
            done = start + q
        start = end
    return out + enc.encode_ordinary(data[done:].decode())


def _assemble(path: str, bits: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(path)
        for b in batches:
            ids = []
            for text, known in zip(b["text"], b["known"]):
                table = {bytes(k["h"]): list(k["ids"]) for k in known} if known is not None else {}
                ids.append(encode_with(enc, text, table, bits, least))
            yield pd.DataFrame({"_id": b["_id"], "ids": ids})

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE, chunk_bits: int = 9, least_chunk: int = 128, tmp: Scratch | None = None) -> DataFrame:
    """(key, ids): one row for each row of ``docs``. Chunks have about 2 ** ``chunk_bits`` + ``least_chunk`` bytes. The result reads the tables of ``tmp``, where given."""
    spark = docs.sparkSession
    materialize = tmp or Scratch(spark)
    ship(spark)
    t = F.col(f"`{text}`")
    id_type = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(f"`{key}`").alias("_id"), t.alias("text"))
    full = base.where(F.length("text") > 0)
    hashed = materialize(full.mapInPandas(_chunked(chunk_bits, least_chunk), f"_id {id_type}, hashes array<binary>"), "token-chunks")
    each = hashed.select("_id", F.explode("hashes").alias("h"))
    shared = materialize(each.groupBy("h").count().where("count > 1").select("h"), "token-shared")
    holders = materialize(each.join(shared, "h", "left_semi").groupBy("_id").agg(F.collect_set("h").alias("shared")), "token-holders")
    texts = materialize(full.join(holders, "_id"), "token-texts")
    chunks = texts.mapInPandas(_cores(path, chunk_bits, least_chunk), "h binary, chunk binary").groupBy("h").agg(F.any_value("chunk").alias("chunk"))
    table = materialize(chunks.mapInPandas(_encode_cores(path), "h binary, ids array<int>"), "token-table")
    known = texts.select("_id", F.explode("shared").alias("h")).join(table, "h").groupBy("_id").agg(F.collect_list(F.struct("h", "ids")).alias("known"))
    some = texts.select("_id", "text").join(known, "_id", "left")
    rest = full.join(holders.select("_id"), "_id", "left_anti").withColumn("known", F.lit(None).cast("array<struct<h:binary,ids:array<int>>>"))
    out = rest.unionByName(some).mapInPandas(_assemble(path, chunk_bits, least_chunk), f"_id {id_type}, ids array<int>")
    empty = base.where("text IS NULL OR text = ''").select("_id", F.array().cast("array<int>").alias("ids"))
    return out.unionByName(empty).select(F.col("_id").alias(key), "ids")
