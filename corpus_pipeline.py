"""A training corpus in five stages. Each stage takes what its predecessor kept, whole, and keeps its columns, whatever they are."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import decontaminate, exact, jaccard, packing, quality
from annalist.llm.common import shared_dir, stored
from annalist.llm.registry import table, vocabulary


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key for each row in a column of a new name. Ids may be null or repeated; a row's place in its file is neither, and stays the same when a lost task is run again."""
    name = "row"
    while name in docs.columns:
        name += "_"
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name)
    try:
        return docs.select("*", place), name
    except AnalysisException:  # not read from files
        return stored(docs).select("*", place), name


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of docs whose key isn't in gone (row), without the key."""
    return docs.join(gone.select(F.col("row").alias(key)), key, "left_anti").drop(key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null, empty and blank texts: rejected. Null or repeated ids: each row by its own text. An empty table: no rows."""
    docs, key = keyed(docs)
    return without(docs, key, quality.score(docs, id_col=key).where("not keep").select(F.col("doc_id").alias("row")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null being empty, the row with the largest doc_id stays; of several of that id, or of rows without one, one row. An empty table: no rows."""
    docs, key = keyed(docs)
    return without(docs, key, exact.dedup(docs, row_col=key).where("not kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity, the row with the smallest doc_id stays; of several of that id, or of rows without one, one row. Texts without words are in no group and stay. An empty table: no rows."""
    docs, key = keyed(docs)
    linked = jaccard.link(docs, id_col=key).select(F.col("doc_id").alias("row"), F.col("component_id").alias("c"))
    groups = stored(linked.join(docs.select(F.col(key).alias("row"), "doc_id"), "row"))
    first = groups.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return without(docs, key, groups.join(first, "c").where("row <> first.row"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Null texts and ids: no passage, and judged by row. An empty table, of documents or of the benchmark: nothing goes."""
    docs, key = keyed(docs)
    return without(docs, key, decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias("row")).distinct())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, dealt out to sequences. Null or empty texts: their end mark alone. Null or repeated ids: packed each. An empty table: no rows."""
    return packing.digests(packing.pack(docs, vocabulary()))


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: The classifier and the tokenizer are not SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
    return docs
