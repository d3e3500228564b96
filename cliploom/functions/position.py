"""Global positions without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CUTS = 255  #: values that cut an order which isn't one of hashes


SMALL = 100_000  #: rows that may be broadcast


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has up to ``rows`` rows, else as it is: Spark then shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _placed(df: DataFrame, bucket: Column, order: tuple[str, ...], into: str) -> DataFrame:
    """Rows are numbered inside a bucket; running sums of the bucket counts, which are broadcast, add the rest."""
    bucketed = df.withColumn("_bucket", bucket.cast("int"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return bucketed.join(F.broadcast(offsets), "_bucket").withColumn(into, (F.col("_before") + place).cast("long")).drop("_bucket", "_before")


def with_position(df: DataFrame, key: str, *ties: str, into: str = "position") -> DataFrame:
    """``df`` with its place, from 0, in the order of the hexadecimal hash ``key`` and then ``ties``.

    The first 16 bits of the hash cut the order into buckets: 65,536 offsets at most.
    """
    return _placed(df, F.conv(F.substring(key, 1, 4), 16, 10), (key, *ties), into)


def with_ordered_position(df: DataFrame, first: str, *ties: str, into: str = "position") -> DataFrame:
    """``df`` with its place, from 0, in the order of ``first``, null first, and then ``ties``.

    Some values of ``first``, those of smallest hash, cut the order into ``MAX_CUTS + 1`` buckets of
    about as many values each, however alike the values look.  Rows of one value share a bucket.
    """
    values = df.select(F.col(first).alias("v")).filter("v is not null").distinct()
    cuts = sorted(r["v"] for r in values.orderBy(F.md5(F.col("v").cast("string"))).limit(MAX_CUTS).collect())
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(first))) if cuts else F.lit(0)
    return _placed(df, bucket, (first, *ties), into)
