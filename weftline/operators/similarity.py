"""Threshold similarity self-join and greedy communities over vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.numbering import number_rows
from weftline.runtime import materialize, rows_of, ship

#: Cosines this close below a threshold reach it: equal ones, as 11/20 at 0.55, differ by rounding only.
TIE = 1e-12


def cosine_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """(i, j, cos) of all pairs with cosine >= ``threshold``, in both orders and with itself; exact, in double precision.

    A blocked theta join: vectors fall into blocks by hash, each pair of blocks is one group of at most about
    2 * ``block_rows`` vectors, and a group is one matrix product. No pair below the threshold leaves a task. Null vectors
    and vectors without a length have no pairs.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, math.ceil(rows.count() / block_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(F.col("b"), o).alias("x"), F.greatest(F.col("b"), o).alias("y")))
    spread = rows.withColumn("b", block).select("id", "v", "b", F.explode(groups).alias("g")).select("id", "v", "b", "g.x", "g.y")

    def multiply(k: tuple, p: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(p["v"].to_list())
        norm = np.sqrt((m * m).sum(axis=1))
        ok = norm > 0
        m, ids, b = m[ok] / norm[ok, None], p["id"].to_numpy()[ok], p["b"].to_numpy()[ok]
        left, right = (np.flatnonzero(b == k[0]), np.flatnonzero(b == k[1]))
        sims = m[left] @ m[right].T
        a, c = np.nonzero(sims >= threshold)
        out = pd.DataFrame({"i": ids[left[a]], "j": ids[right[c]], "cos": sims[a, c]})
        return out if k[0] == k[1] else pd.concat([out, out.rename(columns={"i": "j", "j": "i"})[["i", "j", "cos"]]])

    return spread.groupBy("x", "y").applyInPandas(multiply, "i long, j long, cos double")


def communities(pairs: DataFrame) -> DataFrame:
    """(id, center, cluster_pos, member_pos) from neighbour pairs that include each vector with itself.

    With a least size of one no community is ever rejected, so a vector belongs to the first community that holds it in
    the order (size descending, centre ascending): an aggregation instead of the sequential walk.
    """
    sizes = pairs.groupBy("i").agg(F.count("*").alias("sz"))
    sized = pairs.join(sizes, "i")
    own = sized.groupBy("j").agg(F.min(F.struct((-F.col("sz")).alias("n"), "i", "cos")).alias("best"))
    rows = own.select(F.col("j").alias("id"), F.col("best.i").alias("center"), F.col("best.cos").alias("cos"), (-F.col("best.n")).alias("sz"))
    return _numbered(rows)


def _numbered(rows: DataFrame) -> DataFrame:
    """(id, center, cluster_pos, member_pos) from (id, center, cos, sz), ``sz`` being the neighbours of the centre."""
    heads = rows.groupBy("center").agg(F.count("*").alias("size"), F.first("sz").alias("sz"))
    ranked = number_rows(heads, [F.desc("size"), F.desc("sz"), F.col("center")], "cluster_pos")
    member = Window.partitionBy("center").orderBy(F.desc("cos"), "id")
    return rows.join(ranked.select("center", "cluster_pos"), "center").select("id", "center", "cluster_pos", (F.row_number().over(member) - 1).alias("member_pos"))


def _unit(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, idx, val): the values other than zero of vectors brought to length one; those without a finite length are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            lens = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(v)), lens)
            norm = np.sqrt(np.bincount(row, flat * flat, len(v)))
            ok = np.isfinite(norm) & (norm > 0)
            keep = ok[row] & (flat != 0)
            at = (np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens))[keep]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(v))[ok])]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((at, pa.int32()), (flat[keep] / norm[row[keep]], pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), *lists], ["id", "idx", "val"])

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(pack, "id long, idx array<int>, val array<double>")


class _Block:
    """Unit vectors of one block as matrices of double and single precision, with their ids and ranks."""

    def __init__(self, t: pa.Table, width: int, order: str) -> None:
        t = t.sort_by(order)
        idx, val = (pa.concat_arrays(t.column(c).chunks) if len(t) else None for c in ("idx", "val"))
        self.key = t.column(order).to_numpy()
        self.ids, self.m = t.column("id").to_numpy(), np.zeros((len(t), width))
        if len(t):
            self.m[np.repeat(np.arange(len(t)), pc.list_value_length(idx).to_numpy()), idx.flatten().to_numpy()] = val.flatten().to_numpy()
        self.single = self.m.astype(np.float32)


def _reaching(x: _Block, rows: np.ndarray, y: _Block, cols: slice, threshold: float) -> np.ndarray:
    """Which cosines reach the threshold: in single precision, and again in double where its rounding could matter."""
    least, slack = threshold - TIE, (x.m.shape[1] + 8) * 2.0**-24
    cos = x.single[rows] @ y.single[cols].T
    over = cos >= np.float32(least + slack)
    near = (cos >= np.float32(least - slack)) ^ over
    r, c = np.nonzero(near)
    if len(r) * 32 > near.size:
        return x.m[rows] @ y.m[cols].T >= least
    for k in range(0, len(r), 4096):
        p, q = r[k : k + 4096], c[k : k + 4096]
        over[p, q] = np.einsum("ij,ij->i", x.m[rows[p]], y.m[cols.start + q]) >= least
    return over


def _degrees(x: _Block, y: _Block, threshold: float, tile: int = 1020) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in ``y`` of each row of ``x``, and the other way round."""
    left, right = np.zeros(len(x.ids), np.int64), np.zeros(len(y.ids), np.int64)
    for i in range(0, len(left), tile):
        rows = np.arange(i, min(i + tile, len(left)))
        for j in range(0, len(right), 2 * tile):
            cols = slice(j, min(j + 2 * tile, len(right)))
            over = _reaching(x, rows, y, cols, threshold)
            left[rows] += np.bitwise_count(np.packbits(over, axis=1)).sum(axis=1, dtype=np.int64)
            for k in range(0, len(rows), 255):  # a byte counts that far
                right[cols] += np.add.reduce(over[k : k + 255].view(np.uint8), axis=0, dtype=np.uint8)
    return left, right


def _first(x: _Block, y: _Block, threshold: float, tile: int = 512) -> np.ndarray:
    """The first row of ``y`` that each row of ``x`` has as a neighbour, -1 without one; a row that has found its own is done."""
    found, live = np.full(len(x.ids), -1, np.int64), np.arange(len(x.ids))
    for j in range(0, len(y.ids), tile):
        cols, rest = slice(j, min(j + tile, len(y.ids))), []
        for i in range(0, len(live), 4 * tile):
            rows = live[i : i + 4 * tile]
            over = _reaching(x, rows, y, cols, threshold)
            at = over.argmax(axis=1)
            hit = over[np.arange(len(rows)), at]
            found[rows[hit]] = j + at[hit]
            rest.append(rows[~hit])
        live = np.concatenate(rest) if rest else live
    return found


def _grid(rows: DataFrame, n: int, block_rows: int, width: int, order: str, each: Callable[[_Block, _Block, bool], pa.Table], schema: str) -> DataFrame:
    """``each`` over every pair of blocks; its last argument says that both are the same block."""
    blocks = max(1, math.ceil(n / block_rows))
    groups = blocks * (blocks + 1) // 2
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(F.col("b"), o).alias("x"), F.greatest(F.col("b"), o).alias("y")))
    spread = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("g", F.explode(pairs)).select(*rows.columns, "b", "g.x", "g.y")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        a, b = (x.as_py() for x in key)
        x = _Block(t.filter(pc.equal(t.column("b"), a)), width, order)
        return each(x, x if a == b else _Block(t.filter(pc.equal(t.column("b"), b)), width, order), a == b)

    # A set number of partitions isn't coalesced: the groups are small, their products are not.
    return spread.repartition(min(groups, 8 * rows.sparkSession.sparkContext.defaultParallelism), "x", "y").groupBy("x", "y").applyInArrow(run, schema)


def vector_communities(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block_values: int = 1 << 22) -> DataFrame:
    """:func:`communities` of all pairs with cosine >= ``threshold``, without a table of the pairs.

    Every pair is compared, twice, as blocked matrix products: first each vector's neighbours are counted, then each
    vector finds the first neighbour in the order of the centres. What leaves a task is one row a vector and block.
    """
    ship(vectors.sparkSession)
    unit = materialize(_unit(vectors, key, vector), "unit-vectors")
    n, width = rows_of(unit), (unit.agg(F.max(F.array_max("idx"))).first()[0] or 0) + 1
    block_rows = max(1, block_values // width)

    def count(x: _Block, y: _Block, same: bool) -> pa.Table:
        left, right = _degrees(x, y, threshold)
        ids, sz = (x.ids, left) if same else (np.concatenate([x.ids, y.ids]), np.concatenate([left, right]))
        return pa.table({"id": ids[sz > 0], "sz": sz[sz > 0]})

    def choose(x: _Block, y: _Block, same: bool) -> pa.Table:
        out = []
        for a, b in ((x, y),) if same else ((x, y), (y, x)):
            at = _first(a, b, threshold)
            ok = np.flatnonzero(at >= 0)
            cos = [np.einsum("ij,ij->i", a.m[p], b.m[at[p]]) for p in np.array_split(ok, len(ok) // 4096 + 1)]
            out.append(pa.table({"id": a.ids[ok], "rank": b.key[at[ok]], "cos": np.concatenate(cos)}))
        return pa.concat_tables(out)

    sizes = _grid(unit, n, block_rows, width, "id", count, "id long, sz long").groupBy("id").agg(F.sum("sz").alias("sz"))
    ranks = materialize(number_rows(sizes, [F.desc("sz"), F.col("id")], "rank"), "ranks")
    chosen = _grid(unit.join(ranks.select("id", "rank"), "id"), n, block_rows, width, "rank", choose, "id long, rank long, cos double")
    best = chosen.groupBy("id").agg(F.min(F.struct("rank", "cos")).alias("best")).select("id", "best.rank", "best.cos")
    rows = best.join(ranks.select("rank", F.col("id").alias("center"), "sz"), "rank").select("id", "center", "cos", "sz")
    return _numbered(materialize(rows, "centres"))


def hashed_embedding(df: DataFrame, text: str = "body", chars: int = 400, size: int = 256, out: str = "embedding") -> DataFrame:
    """Offline stand-in for a sentence model: L2-normalised hashed word counts of the first ``chars`` characters."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    words = RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"\W+").transform(df.withColumn("_t", F.substring(text, 1, chars)))
    counts = Normalizer(inputCol="_c", outputCol="_n").transform(HashingTF(inputCol="_w", outputCol="_c", numFeatures=size).transform(words))
    return counts.withColumn(out, vector_to_array("_n")).drop("_t", "_w", "_c", "_n")
