"""A store of checkpoints in a shared folder: a document per checkpoint, found by id or as the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.sources.sinks import folder_names


class CheckpointStore:
    """Checkpoints (id, vector, time in microseconds, states by block) as Parquet, one partition per id. Saving an id again replaces it."""

    SCHEMA = "vector map<string,bigint>, at_us bigint, states map<string,string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, checkpoint_id: str, vector: dict[str, int], at_us: int, states: dict[str, str]) -> None:
        if not checkpoint_id or "/" in checkpoint_id:
            raise ValueError("a checkpoint needs an id without slashes")
        self.spark.createDataFrame([(vector, at_us, states)], self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/checkpoint_id={checkpoint_id}")

    def all(self) -> DataFrame:
        """All checkpoints; an empty frame if there are none."""
        kind = f"{self.SCHEMA}, checkpoint_id string"
        there = any(n.startswith("checkpoint_id=") for n in folder_names(self.spark, self.path))
        return self.spark.read.schema(kind).parquet(self.path) if there else self.spark.createDataFrame([], kind)

    def get(self, checkpoint_id: str) -> Row | None:
        return self.all().where(F.col("checkpoint_id") == checkpoint_id).first()

    def latest(self) -> Row | None:
        """The last by time, of equal times the greatest id."""
        return self.all().orderBy(F.desc("at_us"), F.desc("checkpoint_id")).first()

    def ids(self) -> list[str]:
        return [r[0] for r in self.all().select("checkpoint_id").distinct().orderBy("checkpoint_id").collect()]

    def delete(self, checkpoint_id: str) -> bool:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/checkpoint_id={checkpoint_id}")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
