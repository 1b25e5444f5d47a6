"""Operators that hold for streams and for tables alike: give them the frame of readStream or of read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import MapType, StructType


def stream_plays(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """New files of a folder as a stream, so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def land(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is there to a folder of raw rows, then stop; the next call goes on from there."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe(df: DataFrame, key: Sequence[str], ts: str, delay: str) -> DataFrame:
    """One row per key; in a stream, keys are remembered as long as the delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*key]) if df.isStreaming else df.dropDuplicates([*key])


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with the first rule they break as reason."""
    marked = df.withColumn("reason", F.coalesce(*[F.when(bad, name) for name, bad in rules.items()]))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def _late(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def rolling_counts(df: DataFrame, keys: Sequence[str], ts: str, width: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """(keys, start, n) in windows of a width, tumbling or at every slide."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _late(df, ts, delay).groupBy(*keys, w).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("start"), "n")


def sessions(df: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """(key, first, until, n): rows of a key with less than a gap between them; until is a gap after the last."""
    s = F.session_window(ts, gap)
    return _late(df, ts, delay).groupBy(key, s).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("until"), "n")


def first_seen(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The first row of each key by time, of one time the smallest by its other columns. A stream remembers every key and is to be written in update mode: a key comes again if an earlier row of it arrives late."""
    rest = [c for c in df.columns if c not in (key, ts)]
    order = F.struct(ts, *[c for c in rest if not isinstance(df.schema[c].dataType, MapType)])
    first = F.min_by(F.struct(ts, *rest), order).alias("r_")
    return df.groupBy(key).agg(first).select(*[key if c == key else F.col(f"r_.{c}").alias(c) for c in df.columns])


#: Value states with timers need this store; set it in the session before such a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Newcomers(StatefulProcessor):
    """Remembers of each key when it was last met; a timer forgets it once that is `keep` milliseconds back."""

    def __init__(self, ts: str, keep: int):
        self.ts, self.keep = ts, keep

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "ts long")

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        when = rows[self.ts].astype("datetime64[us]").astype("int64")
        known = self.last.get()[0] if self.last.exists() else None
        # The timer may be due and not yet have run, so the time itself says whether the key is new.
        before = when.cummax().shift(1)
        if known is not None:
            before = before.fillna(known).clip(lower=known)
        yield rows[(before.isna() | (when - before > self.keep * 1000)).to_numpy()]
        newest = max(int(when.max()), known or 0)
        if newest != known:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(newest // 1000 + self.keep)
            self.last.update((newest,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def newcomers(stream: DataFrame, key: str, ts: str, delay: str, keep_days: float) -> DataFrame:
    """In a stream, the rows whose key has not been met for `keep_days` before them, as soon as their batch is read.

    A key's state is one number and a timer, which frees it; so the state holds the keys of the last `keep_days` only.
    Rows older than the watermark don't come here: split_late() hands them to a folder of their own. Null keys are a key.
    """
    df = stream.withWatermark(ts, delay)
    return df.groupBy(key).transformWithStateInPandas(_Newcomers(ts, int(keep_days * 86_400_000)), outputStructType=stream.schema, outputMode="Append", timeMode="EventTime")


def split_late(stream: DataFrame, ts: str, delay_seconds: int, folder: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there, batch by batch, into folder/rows and, if older by more than the delay than the newest row of earlier batches, into folder/late, with the watermark it missed; then stop.

    folder/marks holds each batch's newest time. All three are written under the batch's number, so a batch that is run
    again after a failure leaves what it would have left at first. Rows without a time are not late.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = spark.read.schema("batch long, newest timestamp").option("ignoreMissingFiles", True)
        done = [spark.createDataFrame([], "batch long, newest timestamp")] + ([marks.parquet(f"{folder}/marks")] if number else [])
        newest = done[-1].where(F.col("batch") < number).agg(F.max("newest").alias("m")).first()["m"]
        mark = F.lit(newest) - F.make_dt_interval(secs=F.lit(delay_seconds)) if newest else F.lit(None).cast("timestamp")
        late = F.coalesce(F.col(ts).cast("timestamp") < mark, F.lit(False))
        batch.where(~late).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        batch.where(late).withColumn("missed", mark).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        batch.agg(F.lit(number).cast("long").alias("batch"), F.max(F.col(ts).cast("timestamp")).alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/of={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settle_late(spark: SparkSession, folder: str, key: str, ts: str, seen: DataFrame) -> DataFrame:
    """First rows (as first_seen()) once the late rows of split_late() are settled: keys that have a late row are worked out anew from all their rows, the others stay as they are."""
    schema = seen.schema
    late = spark.read.schema(schema).parquet(f"{folder}/late").select(*seen.columns)
    keys = late.select(F.col(key).alias("k_")).distinct()
    of = lambda df, how: df.join(keys, F.col(key).eqNullSafe(F.col("k_")), how).select(*seen.columns)
    again = of(spark.read.schema(schema).parquet(f"{folder}/rows"), "left_semi").unionByName(late)
    return of(seen, "left_anti").unionByName(first_seen(again, key, ts).select(*seen.columns))


def run_summary(batch: DataFrame, batch_id: int, key: str) -> DataFrame:
    """(batch, n, keys, nameless): one row on a micro-batch; call it from foreachBatch and append the row."""
    return batch.agg(F.lit(batch_id).alias("batch"), F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("keys"), F.count_if(F.col(key).isNull()).alias("nameless"))
