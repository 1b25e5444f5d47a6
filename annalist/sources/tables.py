"""Reading sources whose shape drifts, and publishing tables."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_aliased_csv(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]], required: Sequence[str]) -> DataFrame:
    """A CSV whose headers differ in case, blanks or name: columns as in aliases, null where the file has none."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    plain = lambda s: re.sub(r"[\s_﻿]+", "", s).lower()
    have = {plain(c): c for c in raw.columns}
    found = {name: next((have[plain(a)] for a in (name, *others) if plain(a) in have), None) for name, others in aliases.items()}
    if missing := [c for c in required if not found.get(c)]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return raw.select(*[(F.trim(F.col(f"`{c}`")) if c else F.lit(None).cast("string")).alias(name) for name, c in found.items()])


def conform(df: DataFrame | None, schema: StructType, spark: SparkSession) -> DataFrame:
    """The schema's columns: null where df lacks one, no rows where there is no df."""
    if df is None:
        return spark.createDataFrame([], schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def parse_plays(raw: DataFrame, col: str = "json") -> DataFrame:
    """Plays from a page of a listening log: (artist, album, title, played_at), whether the page holds a list or a single play; those without a time are left out."""
    kind = "struct<artist:struct<`#text`:string>,album:struct<`#text`:string>,name:string,date:struct<uts:string>>"
    many, one = (F.from_json(col, f"recenttracks struct<track:{k}>")["recenttracks"]["track"] for k in (f"array<{kind}>", kind))
    is_list = F.get_json_object(col, "$.recenttracks.track").startswith("[")
    p = raw.select(F.explode(F.when(is_list, many).otherwise(F.array(one))).alias("p"))
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return p.select(text("p.artist.`#text`").alias("artist"), text("p.album.`#text`").alias("album"), text("p.name").alias("title"), F.timestamp_seconds(F.expr("try_cast(p.date.uts AS long)")).alias("played_at")).where("played_at is not null")


def publish(tables: Mapping[str, DataFrame], allow: Mapping[str, Sequence[str]], folder: str) -> DataFrame:
    """Write the allowed tables with their allowed columns to a new folder; (table, n) of what was written, once all is there."""
    out = None
    for name, columns in allow.items():
        if name in tables:
            df = tables[name]
            df.select(*[c for c in columns if c in df.columns]).write.mode("errorifexists").parquet(f"{folder}/{name}")
            n = df.sparkSession.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
            out = n if out is None else out.unionByName(n)
    return out


MANIFEST = "version long, table string, rows long, bytes long, schema string"


def publish_version(tables: Mapping[str, DataFrame], allow: Mapping[str, Sequence[str]], folder: str) -> DataFrame:
    """Publish the allowed tables with their allowed columns as the next version in a folder; the version's rows of MANIFEST.

    Every table goes to a folder of the version's own; its rows are counted while they are written. The manifest comes
    last, as one file that appears at once, and published() takes what it says: a write that fails leaves the version
    before it in force, and its own half-written tables unread. An allowed table that is not there is left out.
    """
    spark = next(iter(tables.values())).sparkSession
    version = max([v for v in _versions(spark, folder)] or [0]) + 1
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    rows = []
    for name, columns in allow.items():
        if name in tables:
            df, to, seen = tables[name], f"{folder}/versions/{version}/{name}", Observation()
            df = df.select(*[c for c in columns if c in df.columns])
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(to)
            path = hadoop.Path(to)
            size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
            rows.append((version, name, seen.get["rows"], size, df.schema.json()))
    out = spark.createDataFrame(rows, MANIFEST)  # a row for each table
    out.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return out


def _versions(spark: SparkSession, folder: str) -> list[int]:
    try:
        return [r["version"] for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("version").distinct().collect()]
    except AnalysisException:  # nothing is published yet
        return []


def published(spark: SparkSession, folder: str, version: int | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The manifest of a version, the newest if none is named, and its tables. ValueError if there is no such version."""
    there = _versions(spark, folder)
    version = version or max(there, default=0)
    if version not in there:
        raise ValueError(f"no version {version or ''} in {folder}")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").where(F.col("version") == version)
    tables = {r["table"]: spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(f"{folder}/versions/{version}/{r['table']}") for r in manifest.collect()}  # a row for each table
    return manifest, tables


def parse_collection(raw: DataFrame, col: str = "json") -> DataFrame:
    """Owned items of a nested collection record as the flat rows that the CSV gives: credits and labels joined, fields told apart by name. Records that are no JSON give nothing."""
    named = "array<struct<name:string>>"
    schema = f"struct<id:long,date_added:string,rating:int,basic_information:struct<title:string,year:int,artists:{named},labels:array<struct<name:string,catno:string>>,formats:array<struct<name:string,descriptions:array<string>>>>,fields:array<struct<name:string,value:string>>>"
    r = raw.select(F.from_json(col, schema).alias("r")).where("r.id is not null")
    joined = lambda c: F.array_join(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), ", ")
    field = lambda name: F.get(F.transform(F.filter("r.fields", lambda x: F.lower(x["name"]) == name), lambda x: x["value"]), F.lit(0))
    b = "r.basic_information"
    return r.select(F.col("r.id").alias("release_id"), F.col("r.date_added").alias("date_added"), F.nullif("r.rating", F.lit(0)).alias("rating"), F.col(f"{b}.title").alias("title"), F.nullif(f"{b}.year", F.lit(0)).alias("year"), joined(F.col(f"{b}.artists.name")).alias("artist"), joined(F.col(f"{b}.labels.name")).alias("label"), joined(F.col(f"{b}.labels.catno")).alias("catalog"), joined(F.flatten(F.transform(f"{b}.formats", lambda f: F.concat(F.array(f["name"]), F.coalesce(f["descriptions"], F.array().cast("array<string>")))))).alias("format"), field("media condition").alias("media"), field("sleeve condition").alias("sleeve"), field("notes").alias("notes"))


def parse_event_lines(raw: DataFrame, col: str = "json") -> DataFrame:
    """(event, date, actor, place, city, set, position, title, cover_of): the titles of every event, numbered over its sets; lines without a title have no number and are left out. A set without a name is "Encore" if it is one."""
    song = "struct<name:string,cover:struct<name:string>>"
    schema = f"id string,eventDate string,artist struct<name:string>,venue struct<name:string,city:struct<name:string>>,sets struct<`set`:array<struct<name:string,encore:int,song:array<{song}>>>>"
    e = raw.select(F.from_json(col, schema).alias("e")).where("e.id is not null")
    sets = F.transform("e.sets.set", lambda s: F.transform(F.filter(s["song"], lambda x: F.trim(x["name"]) != ""), lambda x: F.struct(F.coalesce(F.nullif(F.trim(s["name"]), F.lit("")), F.when(s["encore"].isNotNull(), "Encore")).alias("set"), F.trim(x["name"]).alias("title"), x["cover"]["name"].alias("cover_of"))))
    head = [F.col("e.id").alias("event"), F.to_date("e.eventDate", "dd-MM-yyyy").alias("date"), F.col("e.artist.name").alias("actor"), F.col("e.venue.name").alias("place"), F.col("e.venue.city.name").alias("city")]
    lines = e.select(*head, F.posexplode(F.flatten(F.filter(sets, lambda s: s.isNotNull()))).alias("position", "line"))
    return lines.select("event", "date", "actor", "place", "city", "line.set", (F.col("position") + 1).alias("position"), "line.title", "line.cover_of")


def explode_json(df: DataFrame, col: str, element: str, name: str) -> DataFrame:
    """A row for each element of a JSON array in a text column, in place of that column; text that is no such array gives no rows."""
    return df.withColumn(name, F.explode(F.from_json(col, f"array<{element}>"))).drop(col).where(F.col(name).isNotNull())


def cache_lookup(df: DataFrame, cache: DataFrame, key: str, now: str, days: int, none_days: int) -> DataFrame:
    """Add payload and state: found, none (looked up, nothing there) or missing. What was fetched more than `days` ago counts as missing, empty answers after `none_days`. cache (key, payload, fetched_at); of several entries the latest counts, of those of one time the one with the largest payload, an empty one last."""
    age = F.lit(none_days) if days == none_days else F.when(F.col("payload").isNull(), none_days).otherwise(days)
    alive = cache.groupBy(key).agg(F.max_by(F.struct("payload", "fetched_at"), F.when(F.col("fetched_at").isNotNull(), F.struct("fetched_at", "payload"))).alias("c_")).select(key, "c_.payload", "c_.fetched_at")
    alive = alive.where(F.datediff(F.lit(now).cast("date"), "fetched_at") <= age).select(key, "payload", F.lit(True).alias("in_"))
    met = df.join(alive, key, "left")
    return met.select(*df.columns, "payload", F.when(F.col("in_").isNull(), "missing").when(F.col("payload").isNull(), "none").otherwise("found").alias("state"))
