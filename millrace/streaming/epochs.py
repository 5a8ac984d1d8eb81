"""Epoch configuration, hooks around each epoch, progress of a query, and pools that hold back flows."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from millrace.operators.epochs import EpochPolicy, cut_epochs
from millrace.sources.sinks import write_epoch


@dataclass
class EpochHooks:
    """Called with the epoch's number: at its start, after its rows are written, and on an error, which is raised again."""

    on_begin: Callable[[int], None] = lambda epoch: None
    on_commit: Callable[[int], None] = lambda epoch: None
    on_error: Callable[[int, Exception], None] = lambda epoch, error: None


@dataclass
class EpochConfig:
    """Policy, hooks, checkpoint strategy (a test of the epoch's number) and named processors, each a function of the epoch's rows.

    With ``order`` the rows of each micro-batch are cut into epochs by the policy, times by ``ts_us``: processors find the
    cut in ``epoch_seq``, from 1 in each micro-batch. Without it a micro-batch is one epoch.
    """

    policy: EpochPolicy = field(default_factory=EpochPolicy.by_count)
    hooks: EpochHooks = field(default_factory=EpochHooks)
    checkpoint: Callable[[int], bool] | None = None
    processors: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    order: list[str] | None = None
    ts_us: str | None = None

    def add_processor(self, name: str, function: Callable[[DataFrame], DataFrame]) -> EpochConfig:
        if not name.strip():
            raise ValueError("a processor needs a name")
        if name in self.processors:
            raise ValueError(f"processor {name!r} is there already")
        self.processors[name] = function
        return self

    def check(self) -> None:
        if not self.processors:
            raise ValueError("at least one processor is needed")
        if self.order and self.policy.window_us is not None and not self.ts_us:
            raise ValueError("a policy by time needs the column of times")


def run_configured(stream: DataFrame, out: str, checkpoint: str, config: EpochConfig) -> dict[str, list[int]]:
    """Works off all there is; each processor writes each epoch below its own name. The epochs committed and those checkpointed."""
    config.check()
    done: dict[str, list[int]] = {"committed": [], "checkpointed": []}

    def one(df: DataFrame, epoch: int) -> None:
        config.hooks.on_begin(epoch)
        df.persist()
        try:
            rows = cut_epochs(df, config.policy, config.order, config.ts_us) if config.order else df
            for name, f in config.processors.items():
                write_epoch(f(rows), f"{out}/{name}", epoch)
        except Exception as e:
            config.hooks.on_error(epoch, e)
            raise
        finally:
            df.unpersist()
        config.hooks.on_commit(epoch)
        done["committed"].append(epoch)
        if config.checkpoint and config.checkpoint(epoch + 1):
            done["checkpointed"].append(epoch)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done


class Progress(StreamingQueryListener):
    """Rows and rates of every epoch of every query, as lifecycle participants see them."""

    def __init__(self) -> None:
        self.started: list[str] = []
        self.epochs: list[tuple[str, int, int, float]] = []
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:
        self.started.append(str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.epochs.append((str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond or 0.0))

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.id))


@contextmanager
def pool(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs of the block run in a scheduler pool; under the fair scheduler pools share the cluster, which holds back any one flow."""
    sc = spark.sparkContext
    before = sc.getLocalProperty("spark.scheduler.pool")
    sc.setLocalProperty("spark.scheduler.pool", name)
    try:
        yield
    finally:
        sc.setLocalProperty("spark.scheduler.pool", before)


def run_flows(flows: dict[str, Callable[[], object]], most: int, spark: SparkSession) -> tuple[dict[str, object], int]:
    """Runs flows, at most ``most`` at a time, each in a scheduler pool of its own; their results by name, and how many ran at once at most. The first error is raised once those running have ended."""
    if most <= 0:
        raise ValueError("at least one flow must run")
    lock, now, top = threading.Lock(), [0], [0]

    def one(name: str, flow: Callable[[], object]) -> object:
        with lock:
            now[0] += 1
            top[0] = max(top[0], now[0])
        try:
            with pool(spark, name):
                return flow()
        finally:
            with lock:
                now[0] -= 1

    with ThreadPoolExecutor(most) as workers:
        started = {name: workers.submit(one, name, flow) for name, flow in flows.items()}
        return {name: f.result() for name, f in started.items()}, top[0]
