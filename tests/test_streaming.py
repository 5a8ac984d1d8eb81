import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.streaming import runs


def files(spark, path, n):
    for i in range(n):
        spark.range(i * 10, i * 10 + 10).select("id", (F.col("id") % 3).alias("k")).coalesce(1).write.mode("append").parquet(path)


def test_each_file_is_an_epoch_and_a_restart_goes_on(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    files(spark, src, 2)
    schema = "id bigint, k bigint"
    assert runs.run_epochs(runs.read_files(spark, src, schema, 1), out, ck) == [0, 1]
    spark.range(20, 30).select("id", (F.col("id") % 3).alias("k")).coalesce(1).write.mode("append").parquet(src)
    assert runs.run_epochs(runs.read_files(spark, src, schema, 1), out, ck) == [2]
    assert rows(spark.read.parquet(out).select("id")) == sorted(((i,) for i in range(30)), key=repr)


def test_a_failed_epoch_is_run_again_and_counted_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    files(spark, src, 3)
    tried = []

    def body(df, epoch):
        tried.append(epoch)
        if tried.count(1) == 1 and epoch == 1:
            df.write.mode("overwrite").parquet(f"{out}/epoch=1")
            raise RuntimeError("lost")
        return df

    stream = lambda: runs.read_files(spark, src, "id bigint, k bigint", 1)
    with pytest.raises(Exception, match="lost"):
        runs.run_epochs(stream(), out, ck, body)
    runs.run_epochs(stream(), out, ck, body)
    assert tried == [0, 1, 1, 2]
    assert spark.read.parquet(out).count() == 30


def test_state_lives_over_restarts(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    files(spark, src, 1)
    stream = lambda: runs.running_counts(runs.read_files(spark, src, "id bigint, k bigint"), "k")
    runs.run_epochs(stream(), out, ck, mode="update")
    spark.range(10, 20).select("id", (F.col("id") % 3).alias("k")).write.mode("append").parquet(src)
    runs.run_epochs(stream(), out, ck, mode="update")
    assert rows(spark.read.parquet(out).groupBy("k").agg(F.max("n"))) == [(0, 7), (1, 7), (2, 6)]


def test_ids_by_offset(spark, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for there in (7, 25, 25):
        spark.dataSource.register(runs.counting_source("test_ids", lambda there=there: there, 10))
        runs.run_epochs(spark.readStream.format("test_ids").load(), out, ck)
    assert rows(spark.read.parquet(out).select("id")) == sorted(((i,) for i in range(1, 26)), key=repr)


def test_hooks_errors_and_progress(spark, tmp_path):
    from millrace.streaming.epochs import EpochConfig, Progress, pool, run_configured

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    files(spark, src, 2)
    with pytest.raises(ValueError):
        EpochConfig().check()
    log = []
    config = EpochConfig(checkpoint=lambda n: n % 2 == 0)
    config.hooks.on_begin = lambda e: log.append(("begin", e))
    config.hooks.on_commit = lambda e: log.append(("commit", e))
    config.hooks.on_error = lambda e, x: log.append(("error", e))
    config.add_processor("all", lambda df: df)
    for bad in ("", "all"):
        with pytest.raises(ValueError):
            config.add_processor(bad, lambda df: df)
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        with pool(spark, "slow"):
            done = run_configured(runs.read_files(spark, src, "id bigint, k bigint", 1), out, ck, config)
    finally:
        spark.streams.removeListener(progress)
    assert done == {"committed": [0, 1], "checkpointed": [1]}
    assert log == [("begin", 0), ("commit", 0), ("begin", 1), ("commit", 1)]
    failing = EpochConfig()
    failing.hooks.on_error = lambda e, x: log.append(("error", e))
    failing.add_processor("bad", lambda df: df.select(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        run_configured(runs.read_files(spark, src, "id bigint, k bigint", 1), out, str(tmp_path / "ck2"), failing)
    assert log[-1] == ("error", 0)


def test_policy_cuts_a_micro_batch(spark, tmp_path):
    from millrace.operators.epochs import EpochPolicy
    from millrace.streaming.epochs import EpochConfig, run_configured

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    files(spark, src, 2)
    config = EpochConfig(policy=EpochPolicy.by_count(4), order=["id"])
    config.add_processor("sizes", lambda df: df.groupBy("epoch_seq").agg(F.count(F.lit(1)).alias("n")))
    run_configured(runs.read_files(spark, src, "id bigint, k bigint", 1), out, ck, config)
    assert rows(spark.read.parquet(f"{out}/sizes").select("epoch", "epoch_seq", "n")) == [(e, s, n) for e in (0, 1) for s, n in ((1, 4), (2, 4), (3, 2))]
    bad = EpochConfig(policy=EpochPolicy.by_time(5), order=["id"])
    bad.add_processor("x", lambda df: df)
    with pytest.raises(ValueError):
        bad.check()


def test_late_rows_are_dropped_by_window(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for hours in ([0, 1, 30], [31], [32], [0, 27, 33]):  # the last file's first row is late
        spark.createDataFrame([(h,) for h in hours], "h int").selectExpr("timestamp_ntz '2025-01-01 00:30:00' + make_interval(0, 0, 0, 0, h) as ts", "'k' as k").coalesce(1).write.mode("append").parquet(src)
    stream = runs.window_counts(runs.read_epoch_files(spark, src, "ts timestamp_ntz, k string"), "ts", "2 hours", ["k"], "6 hours", "1 hour")
    done = runs.run_epochs(stream, out, ck, mode="update")
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz '2025-01-01 00:00:00', window_start)").alias("hour")
    got = dict(rows(spark.read.parquet(out).groupBy(hour).agg(F.max_by("n", "epoch"))))
    assert len(done) >= 4
    # the row at 0:30 of the last file, 31 hours behind, counts nowhere; that at 27:30 does, six hours being allowed
    assert got == {-1: 1, 0: 2, 1: 1, 26: 1, 27: 1, 29: 1, 30: 2, 31: 2, 32: 2, 33: 1}
