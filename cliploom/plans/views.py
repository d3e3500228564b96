"""Tables of business data seen as episodes of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    return df.withColumn("frame_idx", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    df = _numbered(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value"), ["user_id"], "ts", "event_id")
    key = (F.col("frame_idx") == 0) | (F.col("event_type") == "error")
    return df.select(F.col("user_id").alias("video_id"), "frame_idx", pts.alias("pts"), key.alias("is_keyframe"), "value")


def event_cams(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _numbered(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value"), ["user_id", "event_type"], "ts", "event_id")
    return df.select(F.col("user_id").alias("episode"), F.col("event_type").alias("camera"), "frame_idx", "value")


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice"]
    df = _numbered(table(spark, sf_dir, "orders").select(*cols), ["o_custkey"], "o_orderdate", "o_orderkey")
    key = (F.col("frame_idx") == 0) | (F.col("o_orderpriority") == "1-URGENT")
    return df.select(F.col("o_custkey").alias("video_id"), "frame_idx", key.alias("is_keyframe"), F.col("o_orderstatus").alias("camera"), F.col("o_totalprice").alias("value"))


def line_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    df = _numbered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", *order), ["l_orderkey"], *order)
    return df.select(F.col("l_orderkey").alias("video_id"), "frame_idx", F.col("l_quantity").alias("value"))


def turn_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations")
    return df.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("frame_idx"), F.col("role").alias("camera"), F.length("text").cast("double").alias("value"))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".mp4")))
    return df.select("source", F.col("lang").alias("camera"), path.alias("path"), F.col("n_chars").alias("size"))


def lengths(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("num_frames"))
