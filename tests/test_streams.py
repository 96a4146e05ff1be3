"""Streams that are stopped, fail and go on."""
import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.operators.runs import GuardError
from tessella.streaming import log, searches


def files(spark, path, n=6, rows=40):
    for i in range(n):
        spark.range(i * rows, (i + 1) * rows).selectExpr("id event_id", "concat('t', id % 3) event_type", "cast(id as double) value").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return n * rows


def test_append_survives_failures(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    total = files(spark, source)
    # The third file's batch breaks off in its last row, after rows of it have been written by the task.
    broken = log.watch(spark, source).withColumn("value", F.when(F.col("event_id") == 119, F.raise_error(F.lit("torn"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="torn"):
        log.append(broken, out, mark, {"n": 1}).awaitTermination()
    assert log.read_log(spark, out, "event_id long").count() == 80
    with pytest.raises(GuardError, match="n"):
        log.append(log.watch(spark, source), out, mark, {"n": 2})
    q = log.append(log.watch(spark, source), out, mark, {"n": 1})
    while q.isActive and not q.recentProgress:
        time.sleep(0.05)
    q.stop()  # somewhere between two batches or inside one
    log.append(log.watch(spark, source), out, mark, {"n": 1}).awaitTermination()
    log.append(log.watch(spark, source), out, mark, {"n": 1}).awaitTermination()
    got = [r.event_id for r in log.read_log(spark, out, "event_id long").collect()]
    assert sorted(got) == list(range(total))


def test_running_totals_go_on(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    files(spark, source, 2)
    log.running_solved(log.watch(spark, source), out, mark, 50).awaitTermination()
    assert sum(r.n for r in log.latest(spark, out).collect()) == 80
    spark.createDataFrame([(999, "t1", 1000.0)], "event_id long, event_type string, value double").write.mode("append").parquet(source)
    log.running_solved(log.watch(spark, source), out, mark, 50).awaitTermination()
    assert {r.arm: (r.n, r.solved) for r in log.latest(spark, out).collect()} == {"t0": (27, 10), "t1": (28, 11), "t2": (26, 10)}


def test_repair_in_a_stream(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    schema = "id long, n long"
    batches = [['{"id": 1, "n": 5}', '{"id": 1, "n": 3}', '{"id": 2, "n'], ['{"id": 1, "n": 1}', '{"id": 2, "n": 7}', '{"n": 4}', '{"id": 3}', "[1]", ""], ['{"id": 3, "n": 9}', '{"id": 4, "n": 0}']]

    def add(b):
        spark.createDataFrame([(x,) for x in batches[b]], "line string").coalesce(1).write.mode("append").parquet(source)

    def run(config=None):
        log.collect(log.watch(spark, source), out, mark, schema, "id", config or {"samples": 64}).awaitTermination()

    add(0)
    run()
    add(1)
    run()
    with pytest.raises(GuardError, match="samples"):
        run({"samples": 32})
    # A batch that has written its rows but isn't committed is done again: its commit is taken away.
    for f in (tmp_path / "c/commits").iterdir():
        if f.name.strip(".").split(".")[0] == "1":
            f.unlink()
    run()
    add(2)
    run()
    assert sorted((r.id, r.n) for r in spark.read.parquet(f"{out}/good").collect()) == [(1, 3), (2, 7), (3, None), (4, 0)]
    assert sorted(r.line for r in spark.read.parquet(f"{out}/dead").collect()) == ["", "[1]", '{"id": 2, "n', '{"n": 4}']


def test_searches_end_by_the_clock(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    t0 = datetime(2024, 1, 1)
    for k, v in searches.STORE.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")

    def step(rows):
        spark.createDataFrame([(i, s, t0 + timedelta(seconds=t)) for i, s, t in rows], "item long, state long, at timestamp").coalesce(1).write.mode("append").parquet(source)
        rows = searches.visits(log.watch(spark, source), 10)
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        rows.writeStream.foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).outputMode("append").start().awaitTermination()
        got = spark.read.parquet(out)
        return sorted(((r.item, r.state or 0, r.what, (r.at - t0).total_seconds(), r.n_seen) for r in got.collect()), key=repr)

    try:
        first = step([(1, 0, 0), (1, 5, 1), (1, 5, 2), (1, 0, 3), (2, 7, 4), (None, 1, 4), (1, 5, 1)])
        want = [(1, 0, "new", 0.0, 1), (1, 5, "new", 1.0, 2), (2, 7, "new", 4.0, 1)]
        assert first == sorted(want, key=repr)
        # Only a later row moves the clock: item 1 ends at 10, item 2 not before 14.
        want += [(3, 1, "new", 12.0, 1), (1, 0, "timeout", 10.0, 2)]
        assert step([(3, 1, 12)]) == sorted(want, key=repr)
        want += [(1, 6, "late", 12.5, 2), (2, 8, "new", 13.0, 2)]
        got = step([(1, 6, 12.5), (2, 8, 13), (2, 7, 13)])
        assert [x for x in got if x[2] != "timeout"] == sorted([x for x in want if x[2] != "timeout"], key=repr)
    finally:
        for k in (*searches.STORE, "spark.sql.streaming.noDataMicroBatches.enabled"):
            spark.conf.unset(k)


def test_config_is_plain_json(spark, tmp_path):
    log.guard_config(spark, str(tmp_path / "c"), {"a": [1, None], "b": "x"})
    log.guard_config(spark, str(tmp_path / "c"), {"b": "x", "a": [1, None]})
    assert json.loads((tmp_path / "c/stream-config.json").read_text()) == {"a": [1, None], "b": "x"}
