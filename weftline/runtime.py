"""Session helpers shared by every operator: scratch tables in the cluster's shared folder and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local[") or master == "local"


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``. Where that is unset a local folder serves a local master; a cluster has none that all executors see, so it is an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="weftline-")
    return f"file://{_LOCAL[app]}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/weftline/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage ends there and survives lost executors.

    The write counts its rows, so :func:`rows_of` needs no job of its own.
    """
    spark = df.sparkSession
    mode, path = ("overwrite", path) if path else ("errorifexists", scratch(spark, tag))
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path, counted.get["n"]
    return out


def rows_of(df: DataFrame) -> int | None:
    """Number of rows of a materialized table, None for any other DataFrame."""
    return getattr(df, "_written", (None, None))[1]


class Scratch:
    """Materialized tables of one operator call, deleted together when nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        out = materialize(df, tag)
        self.paths.append(out._written[0])
        return out

    def drop(self) -> None:
        for p in self.paths:
            drop_path(self.spark, p)
        self.paths.clear()


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file under a name that appears only when it is whole."""
    part, fs = _file_system(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(part, _file_system(spark, path)[0])


def last_text(spark: SparkSession, folder: str) -> str:
    """The text of the last whole file of a folder by name."""
    p, fs = _file_system(spark, folder)
    names = sorted(x.getPath().toString() for x in fs.listStatus(p) if not x.getPath().getName().startswith(".") and not x.getPath().getName().endswith(".part"))
    return "\n".join(r.value for r in spark.read.text(names[-1], wholetext=True).collect())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a real cluster once per application, so Python workers can import it."""
    sc = spark.sparkContext
    if _local(spark) or sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="weftline-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only after counting: ``df`` (already materialized, narrow rows) must have at most ``max_rows`` rows; a larger one keeps its shuffle join."""
    rows = rows_of(df)
    if rows is None:
        rows = df.limit(max_rows + 1).count()
    return F.broadcast(df) if rows <= max_rows else df
