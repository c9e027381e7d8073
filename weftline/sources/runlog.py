"""The run log: an append-only table of run states. The current state of a run is its last row."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import schemas


class NotFoundError(LookupError):
    pass


class RunLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _append(self, seq: int, **row) -> None:
        names = [f.split()[0] for f in schemas.RUN.split(", ")]
        values = [tuple(row.get(n) for n in names) + (seq,)]
        self.spark.createDataFrame(values, schemas.RUN + ", seq int").coalesce(1).write.mode("append").parquet(self.path)

    def begin(self, folder: str, start: dt.date, end: dt.date) -> dict:
        row = {"id": str(uuid.uuid4()), "run_at": dt.datetime.now(dt.UTC).replace(tzinfo=None), "folder": folder, "date_start": start, "date_end": end, "story_count": 0, "status": "pending"}
        self._append(0, **row)
        return row

    def complete(self, run: dict, count: int, output: str) -> None:
        self._append(1, **run | {"status": "complete", "story_count": count, "output_json": output})

    def fail(self, run: dict, error: BaseException) -> None:
        self._append(1, **run | {"status": "failed", "error_message": str(error)})

    def runs(self) -> DataFrame:
        return states(self.spark.read.schema(schemas.RUN + ", seq int").parquet(self.path))


def states(log: DataFrame) -> DataFrame:
    """The current state of every run of a log: its last row."""
    return log.groupBy("id").agg(F.max_by(F.struct(*[c for c in log.columns if c not in ("id", "seq")]), "seq").alias("r")).select("id", "r.*")


def latest(runs: DataFrame) -> DataFrame:
    """The last completed run, at most one row."""
    return runs.where("status = 'complete'").orderBy(F.desc("run_at"), F.desc("id")).limit(1)


def output_of(rows: DataFrame) -> str:
    """The digest of a lookup; raises when there is no run or no output."""
    found = rows.select("output_json").take(1)
    if not found or not found[0].output_json:
        raise NotFoundError("no digest found")
    return found[0].output_json


def by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("id") == run_id)


def digest(runs: DataFrame) -> DataFrame:
    """Runs with their output read into a fixed schema."""
    return runs.withColumn("digest", F.from_json("output_json", schemas.DIGEST))
