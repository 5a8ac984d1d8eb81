"""Sinks: Parquet, a versioned append log, idempotent epoch writes, per-chunk logs, Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    """Parquet under Spark's commit protocol: all files or none appear."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder, on whatever file system; none if there is no such folder. Any other error is raised."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []


class VersionLog:
    """An append log in a folder: Parquet partitioned by ``commit_version``, so a range of versions prunes the scan. One writer at a time.

    With ``feed`` each append also notes its rows in a change feed, which ``changes`` reads where it covers the
    versions asked for; else they are told from the versions' files.
    """

    VERSION = "commit_version"

    def __init__(self, spark: SparkSession, path: str, feed: bool = False):
        self.spark, self.path, self.feed = spark, path, feed

    def _versions(self, path: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in folder_names(self.spark, path) if n.startswith(f"{self.VERSION}="))

    def read(self) -> DataFrame | None:
        """All rows; None if nothing was ever appended. An unreadable log raises."""
        return self.spark.read.parquet(self.path) if self._versions(self.path) else None

    def latest(self) -> int:
        return max(self._versions(self.path), default=0)

    def append(self, df: DataFrame) -> tuple[int, int]:
        """(version, rows). All rows get the next version; an empty frame commits nothing and leaves the version. The frame is run once."""
        version = self.latest() + 1
        seen = Observation()
        to, folder = f"{self.path}/_next-{version}", f"{self.path}/{self.VERSION}={version}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(to)
        rows = seen.get["n"]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(to).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not rows:
            files.delete(path(to), True)
            return version - 1, 0
        if self.feed:
            # before the version appears: a reader never finds a version whose feed is missing
            change = self.spark.read.parquet(to).withColumn("change_type", F.lit("insert"))
            change.write.mode("overwrite").parquet(f"{self.path}/_change_feed/{self.VERSION}={version}")
        if not files.rename(path(to), path(folder)):
            raise OSError(f"version {version} could not be committed")
        return version, rows

    def changes(self, after: int, up_to: int | None = None) -> DataFrame | None:
        """Rows of the versions in (after, up_to], with ``strategy``: by the change feed if it has every one of them, else by version."""
        from millrace.sources.readers import read_changes

        df = self.read()
        if df is None:
            return None
        wanted = {v for v in self._versions(self.path) if v > after and (up_to is None or v <= up_to)}
        fed = f"{self.path}/_change_feed"
        if wanted and wanted <= {*self._versions(fed)}:
            return read_changes(self.spark.read.parquet(fed).drop("change_type"), self.VERSION, after, up_to, "ChangeDataFeed")
        return read_changes(df, self.VERSION, after, up_to)


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    """Writes an epoch to a folder of its own, replacing what an earlier attempt left there: writing it twice is writing it once."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def for_each_part(df: DataFrame, process: Callable[[Iterator[Row]], None]) -> None:
    """Every row to exactly one of the workers that compete for partitions."""
    df.foreachPartition(process)


def rows_of(df: DataFrame) -> Iterator[Row]:
    """The rows one after another, a partition at a time in the driver's memory."""
    return df.toLocalIterator()


def observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of it, filled by the first action."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(n) for n, c in metrics.items())), seen


def chunk_log(df: DataFrame, chunk: str) -> DataFrame:
    """(chunk, n_rows, schema): what a log of each chunk says."""
    return df.groupBy(F.col(chunk).alias("chunk")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("schema", F.lit(df.schema.simpleString()))


def to_arrow(df: DataFrame):
    """The frame as an Arrow table in the driver; for results known to be small."""
    return df.toArrow()


def write_arrow(df: DataFrame, path: str) -> None:
    """The frame as Arrow IPC files, one per task that has rows, in a folder that all executors can write to as a local path (a shared mount). Nothing passes through the driver.

    A task that runs again replaces its own file.
    """
    import os

    import pyarrow as pa
    from pyspark import TaskContext

    path = path.removeprefix("file://")
    os.makedirs(path, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        rows = 0
        if first is not None:
            part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
            now, done = f"{path}/_part-{part:05d}-{attempt}", f"{path}/part-{part:05d}.arrow"
            with pa.OSFile(now, "wb") as sink, pa.ipc.new_file(sink, first.schema) as writer:
                writer.write_batch(first)
                rows = first.num_rows
                for b in batches:
                    writer.write_batch(b)
                    rows += b.num_rows
            os.replace(now, done)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["n"])

    df.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def event_sink(events: DataFrame, log: VersionLog, snapshots: VersionLog, run: str, event_id: str, kind: str, fold: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Appends events, then a snapshot of each run that a policy point calls for (``events.snapshot_points``), folded from all its events by ``fold``; returns what was written.

    The telemetry of runs that are completed is pruned when the log is read, see ``read_events``; versions stay as they were written.
    """
    from millrace.operators.events import snapshot_points

    version, rows = log.append(events)
    points = snapshot_points(events, event_id, kind).select(run).distinct()
    known = log.read()
    made = 0
    if rows and known is not None:
        _, made = snapshots.append(fold(known.join(points, run, "left_semi").drop(log.VERSION)))
    return {"version": version, "events": rows, "snapshots": made}


def read_events(log: VersionLog, run: str, kind: str, completed: str) -> DataFrame | None:
    """The log's events without the telemetry of completed runs."""
    from millrace.operators.events import prune_telemetry

    rows = log.read()
    return None if rows is None else prune_telemetry(rows.drop(log.VERSION), run, kind, completed)
