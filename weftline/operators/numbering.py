"""Global row numbers without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import materialize


def number_rows(df: DataFrame, order: list[str | Column], name: str = "seq") -> DataFrame:
    """``df`` with ``name`` = 0, 1, 2, ... in the given order; ties get any order, so give a key that has none.

    Rows are range-partitioned, sorted and written once; each partition's count gives the offset of the next. Only one row
    a partition is ever ordered in one task.
    """
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = placed.withColumn("_part", F.shiftrightunsigned("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    shift = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(shift), "_part").withColumn(name, F.col("_row") + F.col("_before")).drop("_at", "_part", "_row", "_before")
