"""Incremental runs over a growing folder of messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import segments
from weftline.sources.mail import parse_mime


def watch_stories(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], folder: str = "", **trigger) -> StreamingQuery:
    """Parse each new .eml file of ``path`` once and hand every micro-batch of stories to ``sink``.

    ``msg_pos`` is a hash of the file's path, so it is the same in every attempt of a batch.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.eml").load(path)
    messages = files.select(F.xxhash64("path").alias("msg_pos"), F.lit(folder).alias("folder"), F.to_date("modificationTime").alias("internal_date"), F.col("content").alias("raw"))
    return messages.writeStream.foreachBatch(lambda df, n: sink(segments.parse(parse_mime(df)), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
