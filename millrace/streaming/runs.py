"""Structured Streaming runs: epochs as micro-batches, idempotent by their id; windows, state, restarts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.durable import ensure_checkpoint_dir
from millrace.sources.sinks import write_epoch


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that every executor can reach, below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def read_epoch_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream in which what each append to the folder wrote is an epoch of its own, in the order of the appends, if each wrote one file."""
    return read_files(spark, path, schema, 1)


def run_epochs(stream: DataFrame, out: str, checkpoint: str, body: Callable[[DataFrame, int], DataFrame] | None = None, mode: str = "append") -> list[int]:
    """Works off all there is: each micro-batch is an epoch, ``body`` runs in it once, its rows replace those of an earlier try. The epochs run.

    An error ends the run before the epoch's commit; a run with the same checkpoint goes on with that epoch.
    """
    done: list[int] = []

    def one(df: DataFrame, epoch: int) -> None:
        write_epoch(body(df, epoch) if body else df, out, epoch)
        done.append(epoch)

    query = stream.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return done


def window_counts(stream: DataFrame, ts: str, size: str, keys: list[str], late: str, slide: str | None = None) -> DataFrame:
    """Counts per key and window of event time, tumbling or every ``slide``; rows whose window has ended ``late`` before the latest time of earlier epochs are dropped."""
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return rows.groupBy(F.window("__ts", size, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "n")


def running_counts(stream: DataFrame, key: str, kind: str = "bigint") -> DataFrame:
    """(key, n): the rows of each key so far, kept as state over epochs and restarts."""

    def count(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({key: [keys[0]], "n": [n]})

    return stream.select(key).groupBy(key).applyInPandasWithState(count, f"{key} {kind}, n bigint", "n bigint", "update", GroupStateTimeout.NoTimeout)


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(first)
        self.first, self.last = first, last


def counting_source(name: str, upto: Callable[[], int], per_part: int) -> type[DataSource]:
    """A stream of the ids 1..upto() whose offset is the last id read: a restart goes on after it. Ids are read in the tasks, ``per_part`` in each."""

    class Reader(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"id": 0}

        def latestOffset(self) -> dict:
            return {"id": upto()}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [_Range(i, min(end["id"], i + per_part - 1)) for i in range(start["id"] + 1, end["id"] + 1, per_part)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return ((i,) for i in range(partition.first, partition.last + 1))

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "id bigint"

        def streamReader(self, schema):
            return Reader()

    return Source
