"""The corpus pipeline: what a training corpus goes through, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import decontaminate, mixing, near_dedup, quality, sharding
from cliploom.llm.store import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_QUALITY = 0.7
NO_ID = 1 << 62  #: keys of rows without an id start here


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labelled rows' sample, does not reject.

    A null text is judged as an empty one, by the intercept alone.  Rows of equal texts stay or go together.  Without
    labels, where nothing can be learned, nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.fit(docs, labels, "quality")
    if not weights.any():
        return docs.select(*COLUMNS)
    return quality.score(docs, weights, into="quality_score").filter(F.col("quality_score") >= LEAST_QUALITY).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of smallest id; rows that repeat it, id and text, count once.

    Rows without an id go by a hash of their text, after all ids under 2^62.  Of rows with neither id nor text all stay.
    An id's rows with different texts are one document, and stay or go together.  A null text is like no other.
    """
    numbered = docs.filter("doc_id is not null").select(*COLUMNS, F.col("doc_id").cast("long").alias("key"))
    hashed = F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)
    others = docs.filter("doc_id is null and text is not null").select(*COLUMNS).dropDuplicates(["text"]).withColumn("key", hashed)
    keyed = numbered.unionByName(others)
    first = near_dedup.near_duplicates(keyed, "key").filter("is_representative").select("key").distinct()
    kept = keyed.join(first, "key", "left_semi").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id is null and text is null").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts are clean; rows that repeat get one answer; an empty benchmark leaves all rows.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark).filter("not contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times.

    Rows of a null source are a source of their own.  A null or empty text has no words, so it costs nothing, and is taken
    by its hash like any other of its source; a source without any words is taken 0 times.
    """
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars")).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row; nulls, repeated rows and few rows as in ``shard_interleaved``."""
    return sharding.shard_interleaved(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores and sketched signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
