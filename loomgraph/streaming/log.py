"""The key-value log as a stream: each micro-batch is reduced to its keys' last writes, which are appended to a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kv import replay
from ..sources.held import ensure_folder


def last_writes(rows: DataFrame) -> DataFrame:
    """The last (value, seq, op) of each key."""
    return rows.groupBy("key").agg(F.max_by(F.struct("value", "seq", "op"), "seq").alias("last")).select("key", "last.value", "last.seq", "last.op")


def follow(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the last writes of each batch to the folder until the stream's present end; a batch that is run again is written over.

    The state is the replay of the folder, whatever the batches were.
    """

    def write(batch: DataFrame, number: int) -> None:
        last_writes(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(spark: SparkSession, path: str, as_log: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, value) after all files at path were followed as a stream; as_log makes them rows (key, value, seq, op)."""
    ensure_folder(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/log-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{name[:-1]}[{name[-1]}]")
    follow(as_log(stream), f"{top}/state", f"{top}/checkpoint").awaitTermination()
    return replay(spark.read.parquet(f"{top}/state").select("key", "value", "seq", "op"))
