"""Sources: files, pushed rows, several producers as one, incremental and versioned reads, test producers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.operators.topology import fan_in


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, under a declared schema; a row that doesn't fit fails the query."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per line, under a declared schema."""
    return spark.read.json(path, schema=schema)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files of a folder that all executors can read as a local path; a task per file, a batch at a time."""
    import os

    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    path = path.removeprefix("file://")
    files = sorted(f"{path}/{n}" for n in os.listdir(path) if n.endswith(".arrow"))
    if not files:
        raise FileNotFoundError(f"no Arrow files in {path}")
    with pa.memory_map(files[0]) as source:
        schema = from_arrow_schema(pa.ipc.open_file(source).schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for names in batches:
            for name in names.column(0).to_pylist():
                with pa.memory_map(name) as source:
                    reader = pa.ipc.open_file(source)
                    for i in range(reader.num_record_batches):
                        yield reader.get_batch(i)

    names = spark.createDataFrame([(f,) for f in files], "f string").repartition(len(files), "f")
    return names.mapInArrow(run, schema)


def from_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Rows pushed from outside; the channel is complete when the iterable ends."""
    return spark.createDataFrame([*rows], schema)


def many_producers(*frames: DataFrame) -> DataFrame:
    """Several producers as one source."""
    return fan_in(*frames)


def read_after(df: DataFrame, id_column: str, anchor: int, epoch_size: int) -> DataFrame:
    """Rows after an anchor with ``epoch_seq``, cut every ``epoch_size`` rows by id. The filter reaches the scan."""
    from millrace.operators.batching import batch_by_size

    return batch_by_size(df.where(F.col(id_column) > anchor), epoch_size, [id_column]).withColumnRenamed("batch_id", "epoch_seq")


def read_changes(df: DataFrame, version: str, after: int, up_to: int | None, strategy: str = "VersionDiffFallback") -> DataFrame:
    """Rows with a version in (after, up_to], the upper end held to the latest there is; ``strategy`` tells how they were found."""
    rows = df.where(F.col(version) > after)
    if up_to is not None:
        rows = rows.where(F.col(version) <= up_to)
    return rows.withColumn("strategy", F.lit(strategy))


class _Part(InputPartition):
    def __init__(self, index: int):
        super().__init__(index)
        self.index = index


def producer_source(name: str, schema: str, producers: list[Callable[[], Iterable[tuple]]]) -> type[DataSource]:
    """A Python data source with a partition per producer; register it and read it by ``name``."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Part(i) for i in range(len(producers))]

        def read(self, partition):
            yield from producers[partition.index]()

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return Reader()

    return Source


def failing(df: DataFrame, message: str) -> DataFrame:
    """A producer that fails as soon as a row is asked for."""
    return df.withColumn("failed", F.raise_error(F.lit(message)))
