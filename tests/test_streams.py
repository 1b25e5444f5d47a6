"""Streams give what the same operators give over the table; sources with drifting shapes."""

import os

import pytest
from pyspark.sql import functions as F

from annalist.operators import curation as C
from annalist.sources import tables
from annalist.streaming import streams as X

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("plays") / "in")
    spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(d)
    return d


def run(stream, mode, name, tmp_path):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    return sorted(map(tuple, stream.sparkSession.table(name).collect()))


def test_counts_and_sessions(spark, folder, tmp_path):
    table = spark.read.parquet(folder)
    plays = X.stream_plays(spark, folder, table.schema, files=10)
    for k, f in enumerate((lambda df: X.rolling_counts(df, ["event_type"], "ts", "1 day"), lambda df: X.sessions(df, "user_id", "ts"))):
        assert run(f(plays), "complete", f"s{k}", tmp_path / str(k)) == sorted(map(tuple, f(table).collect()))


def test_land_dedupe_quarantine(spark, folder, tmp_path):
    table = spark.read.parquet(folder)
    plays = X.stream_plays(spark, folder, table.schema, files=1)
    for _ in range(2):  # a second call finds nothing new
        X.land(plays, str(tmp_path / "raw"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "raw")).count() == table.count()
    twice = table.unionByName(table)
    assert X.dedupe(twice, ["event_id"], "ts", "1 day").count() == table.select("event_id").distinct().count()
    good, bad = X.quarantine(table, {"odd": F.col("event_id") % 2 == 1})
    assert good.count() + bad.count() == table.count() and {r.reason for r in bad.select("reason").collect()} <= {"odd"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Release ID,artist , Titel\n1, A ,x\n", encoding="utf-8")
    df = tables.read_aliased_csv(spark, str(tmp_path / "a.csv"), {"release_id": [], "artist": [], "title": ["Titel"], "year": ["Released"]}, ["title"])
    assert [tuple(r) for r in df.collect()] == [("1", "A", "x", None)]
    with pytest.raises(ValueError):
        tables.read_aliased_csv(spark, str(tmp_path / "a.csv"), {"label": []}, ["label"])
    pages = ['{"recenttracks":{"track":[{"artist":{"#text":" A "},"name":"x","date":{"uts":"60"}},{"artist":{"#text":"B"},"name":"now"}]}}', '{"recenttracks":{"track":{"artist":{"#text":"C"},"album":{"#text":""},"name":"y","date":{"uts":"120"}}}}', "not json"]
    got = tables.parse_plays(spark.createDataFrame([(p,) for p in pages], "json string"))
    assert sorted((r.artist, r.album, r.title, r.played_at.timestamp()) for r in got.collect()) == [("A", None, "x", 60.0), ("C", None, "y", 120.0)]
    schema = spark.createDataFrame([], "k long, x string").schema
    assert tables.conform(spark.createDataFrame([(1, 2)], "k int, z int"), schema, spark).collect() == [(1, None)] and tables.conform(None, schema, spark).count() == 0
    assert [tuple(r) for r in tables.publish({"a": df, "b": df}, {"a": ["title", "nothing"]}, str(tmp_path / "out")).collect()] == [("a", 1)]


def test_merge_chains_and_gate(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 201)] + [(300, 301), (301, 300), (302, 300)], "a long, b long")
    got = {r.a: r.b for r in C.follow(links, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[300] is got[301] is got[302] is None
    before, after = (spark.createDataFrame(x, "check string, n long") for x in ([("a", 1), ("b", 2)], [("a", 1), ("b", 3), ("c", 1)]))
    assert sorted(map(tuple, C.worsened(before, after).collect())) == [("b", 2, 3), ("c", 0, 1)]


def test_first_seen_and_summary(spark, folder, tmp_path):
    table = spark.read.parquet(folder)
    plays = X.stream_plays(spark, folder, table.schema, files=1)
    want = {r.user_id: r.ts for r in table.where("user_id is not null").groupBy("user_id").agg(F.min("ts").alias("ts")).collect()}
    got: dict = {}
    for user, ts in run(X.first_seen(plays.where("user_id is not null").select("user_id", "ts"), "user_id", "ts"), "update", "first", tmp_path):
        got[user] = min(ts, got.get(user, ts))
    assert got == want
    tied = spark.createDataFrame([(1, "2024-01-01", 9), (1, "2024-01-01", 3), (1, "2024-01-02", 1)], "k long, t string, x long")
    assert [tuple(r) for r in X.first_seen(tied, "k", "t").collect()] == [(1, "2024-01-01", 3)]


def test_dedupe_stream(spark, folder, tmp_path):
    """Repeated rows of a stream come once, as in a table."""
    table = spark.read.parquet(folder)
    plays = X.stream_plays(spark, folder, table.schema, files=1)
    twice = plays.union(plays)
    got = run(X.dedupe(twice, ["event_id"], "ts", "60 days").select("event_id"), "append", "twice", tmp_path)
    assert sorted(r[0] for r in got) == sorted(r.event_id for r in X.dedupe(table.union(table), ["event_id"], "ts", "1 day").select("event_id").collect())
    assert X.run_summary(table, 7, "user_id").collect()[0][:2] == (7, table.count())


def test_nested_sources(spark):
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "json string")
    record = '{"id":5,"date_added":"2020-01-02","rating":0,"basic_information":{"title":"t","year":0,"artists":[{"name":"A"},{"name":" "},{"name":"B"}],"labels":[{"name":"L","catno":"c1"}],"formats":[{"name":"Vinyl","descriptions":["LP","RE"]},{"name":"CD"}]},"fields":[{"name":"Notes","value":"n"},{"name":"Media Condition","value":"VG"}]}'
    (r,) = tables.parse_collection(df(record, "nothing", None)).collect()
    assert tuple(r) == (5, "2020-01-02", None, "t", None, "A, B", "L", "c1", "Vinyl, LP, RE, CD", "VG", None, "n")
    event = '{"id":"e","eventDate":"03-02-2021","artist":{"name":"A"},"venue":{"name":"V","city":{"name":"C"}},"sets":{"set":[{"song":[{"name":"x"},{"name":" "},{"name":"y","cover":{"name":"Z"}}]},{"encore":1,"song":[{"name":"w"}]}]}}'
    got = tables.parse_event_lines(df(event, '{"id":"f"}', "nothing")).collect()
    assert [(str(r.date), r.place, r.set, r.position, r.title, r.cover_of) for r in got] == [("2021-02-03", "V", None, 1, "x", None), ("2021-02-03", "V", None, 2, "y", "Z"), ("2021-02-03", "V", "Encore", 3, "w", None)]
    assert [r.v for r in tables.explode_json(df("[1,2]", "x", None), "json", "int", "v").collect()] == [1, 2]
