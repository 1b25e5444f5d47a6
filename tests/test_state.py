"""Streams with state of their own, and late rows settled in batch."""

from datetime import datetime, timedelta

import pytest

from annalist.streaming import streams

DAY = datetime(2024, 1, 1)


@pytest.fixture
def batches(spark, tmp_path):
    """Three batches, the last with a row five days late, whose key came later in time."""
    at = lambda d: DAY + timedelta(days=d)
    rows = [
        [(1, "a", at(0)), (2, "b", at(0.5)), (3, "a", at(0.2))],
        [(4, "c", at(6)), (5, "a", at(6.1)), (6, None, at(6.2))],
        [(7, "c", at(1)), (8, "d", at(7)), (9, "b", at(30))],
        [(10, "a", at(31)), (11, "e", at(31.5))],
    ]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, "id long, who string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return str(tmp_path / "in"), [x for r in rows for x in r], tmp_path


def stream(spark, path):
    one = spark.readStream.schema("id long, who string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return one.parquet(path)


def test_newcomers(spark, batches):
    path, rows, tmp = batches
    old = spark.conf.get(streams.STATE_STORE[0])
    spark.conf.set(*streams.STATE_STORE)
    try:
        df = streams.newcomers(stream(spark, path), "who", "ts", "2 days", keep_days=10)
        q = df.writeStream.format("memory").queryName("newcomers").outputMode("append").option("checkpointLocation", str(tmp / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {r.id for r in spark.table("newcomers").collect()}
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set(streams.STATE_STORE[0], old)
    # 7 is late and dropped; b and a come again after more than ten days and are new once more.
    assert got == {1, 2, 4, 6, 8, 9, 10, 11}
    assert 0 < kept[-1] < 7 * 4  # what timers freed is gone


def test_late_rows(spark, batches):
    path, rows, tmp = batches
    folder = str(tmp / "out")
    streams.split_late(stream(spark, path), "ts", 2 * 86400, folder, str(tmp / "ck")).awaitTermination()
    late = spark.read.parquet(f"{folder}/late")
    assert [(r.id, r.missed) for r in late.collect()] == [(7, DAY + timedelta(days=4.2))]
    on_time = spark.read.parquet(f"{folder}/rows").drop("batch")
    seen = streams.first_seen(on_time, "who", "ts")
    whole = streams.first_seen(spark.createDataFrame(rows, "id long, who string, ts timestamp"), "who", "ts")
    pick = lambda df: sorted(((r.who or "", r.id) for r in df.collect()))
    assert pick(seen) != pick(whole)
    assert pick(streams.settle_late(spark, folder, "who", "ts", seen)) == pick(whole)
    # Run again over the same input: nothing is doubled.
    streams.split_late(stream(spark, path), "ts", 2 * 86400, folder, str(tmp / "ck")).awaitTermination()
    assert spark.read.parquet(f"{folder}/rows").count() == len(rows) - 1
