"""Problem 9: texts of varying length placed in containers of fixed capacity, by shortest-pack-first over the length histogram.

1. Lengths come from the tokenizer operator. A text longer than the capacity is divided into full pieces and a rest;
   no other text is divided; empty and null texts take no room and no row.
2. The histogram of piece lengths (at most ``capacity`` counts, whatever the number of documents) goes to the driver.
   Lengths are placed longest first: a length joins packs that still have room for it, the shortest of them first, and
   opens new ones when none has. Packs are kept as patterns with counts, so the work depends on the capacity alone. The
   same is done with the fullest fitting pack first, and the plan with fewer containers is used.
3. Pieces get a rank within their length by a range sort on (capacity, length, id, piece) and per-partition offsets, so
   a length that a third of all documents share is spread over many tasks. Rank intervals belong to patterns, so each
   piece finds its container by a binary search in a table whose size is bounded by the capacities.

Every piece is in exactly one container, no container exceeds its capacity, and the plan is the same for every order of
the input. Ties of equal lengths are placed by id. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import BYTE_BPE, encode
from weftline.runtime import Scratch, materialize, ship


def plan_patterns(histogram: dict[int, int], capacity: int, shortest_first: bool = True) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packing patterns for ``histogram`` (length -> number of pieces)."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # room left -> patterns
    rooms: list[int] = []
    for length in sorted(histogram, reverse=True):
        left, fresh = histogram[length], []
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fresh.append((capacity - length, left, (length,)))
                break
            room = rooms[-1] if shortest_first else rooms[i]
            count, lengths = open_[room].pop()
            if not open_[room]:
                rooms.remove(room)
            used = min(count, left)
            if used < count:
                if not open_[room]:
                    insort(rooms, room)
                open_[room].append((count - used, lengths))
            left -= used
            after = room - length
            if not open_[after]:
                insort(rooms, after)
            open_[after].append((used, (*lengths, length)))
        for room, count, lengths in fresh:
            # Pieces of one length may share a container: fill each new pack with as many as fit.
            each = capacity // lengths[0]
            for size, packs in ((each, count // each), (count % each, 1 if count % each else 0)):
                if size and packs:
                    rest = capacity - size * lengths[0]
                    if not open_[rest]:
                        insort(rooms, rest)
                    open_[rest].append((packs, lengths * size))
    return [x for room in sorted(open_) for x in open_[room]]


def place(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> arrays (first rank, first container, pieces of this length per container, offset of the first) by interval."""
    table, ranks, base = defaultdict(list), defaultdict(int), 0
    for count, lengths in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            per = lengths.count(length)
            table[length].append((ranks[length], base, per, offset))
            ranks[length] += count * per
            offset += per * length
        base += count
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in table.items()}


def _find(plans: dict[int, dict[int, tuple[np.ndarray, ...]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            container, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            spec, size, rank = (b[c].to_numpy() for c in ("spec_id", "n_tokens", "rank"))
            order = np.lexsort((size, spec))
            cuts = np.flatnonzero((np.diff(spec[order]) != 0) | (np.diff(size[order]) != 0)) + 1
            for rows in np.split(order, cuts) if len(b) else []:
                first, base, per, off = plans[int(spec[rows[0]])][int(size[rows[0]])]
                i = np.searchsorted(first, rank[rows], side="right") - 1
                k = rank[rows] - first[i]
                container[rows] = base[i] + k // per[i]
                offset[rows] = off[i] + (k % per[i]) * size[rows]
            yield b.assign(container=container, offset=offset).drop(columns="rank")

    return run


def pack(lengths: DataFrame, specs: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(spec_id, container, offset, key, piece, start, n_tokens): where every piece of every text goes.

    ``start`` is the piece's first token within its text, ``offset`` its place within the container.
    """
    spark = lengths.sparkSession
    ship(spark)
    capacities = {r.spec_id: r.capacity for r in specs.where("capacity > 0").select("spec_id", "capacity").collect()}
    id_type = lengths.schema[key].dataType.simpleString()
    sized = lengths.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{size}`").cast("long").alias("n")).where("n > 0")
    if not capacities:
        return spark.createDataFrame([], f"spec_id int, container bigint, offset bigint, {key} {id_type}, piece int, start bigint, n_tokens int")
    spec = F.explode(F.array(*(F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("c")) for s, c in sorted(capacities.items()))))
    pieces = sized.select("_id", "n", spec.alias("s")).select("_id", "n", "s.*").select("_id", "n", "spec_id", "c", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / F.col("c")).cast("int"))).alias("piece"))
    pieces = pieces.select("spec_id", F.least("c", F.col("n") - F.col("piece") * F.col("c")).cast("int").alias("n_tokens"), "_id", "piece", (F.col("piece") * F.col("c")).alias("start"))
    ordered = ["spec_id", "n_tokens", "_id", "piece"]
    placed = pieces.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()), "pieces")
    part, row = F.shiftrightunsigned("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per length and partition: bounded by capacities and partitions, never by documents.
    counts = placed.select("spec_id", "n_tokens", part, row.alias("row")).groupBy("part", "spec_id", "n_tokens").agg(F.count("*").alias("n"), F.min("row").alias("first")).collect()
    before, shift, histogram = defaultdict(int), [], defaultdict(dict)
    for r in sorted(counts, key=lambda r: (r.part, r.spec_id, r.n_tokens)):
        shift.append((r.part, r.spec_id, r.n_tokens, before[r.spec_id, r.n_tokens] - r.first))
        before[r.spec_id, r.n_tokens] += r.n
    for (s, n), count in before.items():
        histogram[s][n] = count
    plans = {}
    for s, h in histogram.items():
        both = [plan_patterns(h, capacities[s], how) for how in (True, False)]
        plans[s] = place(min(both, key=lambda p: sum(c for c, _ in p)))
    shifts = F.broadcast(spark.createDataFrame(shift, "part bigint, spec_id int, n_tokens int, shift bigint"))
    ranked = placed.withColumn("part", part).join(shifts, ["part", "spec_id", "n_tokens"]).select("spec_id", "n_tokens", "_id", "piece", "start", (row + F.col("shift")).alias("rank"))
    out = ranked.mapInPandas(_find(plans), f"spec_id int, n_tokens int, _id {id_type}, piece int, start bigint, container bigint, offset bigint")
    return out.select("spec_id", "container", "offset", F.col("_id").alias(key), "piece", "start", "n_tokens")


def pack_texts(docs: DataFrame, specs: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """Containers of the texts, each encoded once: lengths are written before they are sorted."""
    tmp = Scratch(docs.sparkSession)
    lengths = materialize(encode(docs, key, text, path, tmp=tmp).select(key, F.size("ids").alias("n_tokens")), "lengths")
    tmp.drop()
    return pack(lengths, specs, key)
