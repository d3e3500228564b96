"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded hash and ranked within their source; the fractional rank
``(rank - 0.5) / rows of the source`` spreads every source evenly over [0, 1).  Sorting by it and
cutting into equal runs gives shards whose counts differ by one at most and whose mixture is the
corpus's.

No window spans a whole source or the whole table.  Rows are dealt over tasks by ranges of the whole
sort key, sources, ids and, last, a number of the row included, so that neither a source that holds a
third of all rows, nor many sources of one rank, nor rows that repeat an id meet in one task.  Places
within a task are added to the running sum of the tasks' row counts (one small row for each task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

HASH_BITS = 60
MAX_PARTS = 65_536  #: bounds the table of row counts, whatever the input


def seeded_hash(seed: int, column: Column) -> Column:
    """60 bits of an MD5, the same in any SQL engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def ranged(df: DataFrame, keys: list[str], rows: int, rows_per_part: int, name: str) -> DataFrame:
    """``df`` written in the order of ``keys``, with part (ranges of the order, ascending) and place (from 0, within a part)."""
    parts = max(1, min(MAX_PARTS, -(-rows // rows_per_part)))
    sorted_rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()  # the task's number, above 33 bits of the row's
    placed = sorted_rows.withColumn("place", number).withColumn("part", F.shiftright("place", 33).cast("int"))
    return written(placed.withColumn("place", F.col("place").bitwiseAND(F.lit((1 << 33) - 1))), name)


def running(sums: DataFrame, *columns: str) -> DataFrame:
    """(part, before_* and all_* of each column): sums of the parts before, and of all; MAX_PARTS rows at most."""
    before, everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    return sums.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in columns], *[F.sum(c).over(everything).alias(f"all_{c}") for c in columns])


def shard_interleaved(
    docs: DataFrame,
    n_shards: int = 40,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    rows_per_part: int = 50_000,
) -> DataFrame:
    """One row per input row: id, source, size, text_crc32, shard, slot.

    * size is the UTF-8 length of the text plus 16; a null text counts as empty.
    * A null source is a source of its own.  A null id is hashed as the word ``null``.
    * Repeated rows take places of their own; which of two identical rows gets which is immaterial.
      Rows of equal hash go by id, then size, then checksum.
    * Fewer rows than shards leave shards without rows; an empty table gives an empty result.
    * Other columns, whatever their names, are not read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.col(source_col), F.lit("")).alias("src"),
            F.col(source_col).isNull().alias("no_src"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            seeded_hash(seed, F.col(id_col)).alias("h"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "shard-rows",
    )
    total = rows.count()
    by_source = ranged(rows, ["no_src", "src", "h", "id", "size", "crc", "number"], total, rows_per_part, "shard-sources")
    of_source = Window.partitionBy("src", "no_src")
    counts = by_source.groupBy("src", "no_src", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    counts = counts.select(
        "src", "no_src", "part", "first",
        F.coalesce(F.sum("n").over(of_source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(of_source).alias("n_source"),
    )
    rank = F.col("before") + F.col("place") - F.col("first") + 1
    ranked = (
        by_source.join(counts, ["src", "no_src", "part"])
        .withColumn("rank", rank)
        .withColumn("f", (F.col("rank") - F.lit(0.5)) / F.col("n_source"))
        .select("id", "src", "no_src", "size", "crc", "rank", "f")
    )
    placed = ranged(ranked, ["f", "no_src", "src", "rank"], total, rows_per_part, "shard-ranked")
    offsets = running(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "n")
    shard = F.expr(f"(at * {n_shards}L) div {max(total, 1)}L")
    start = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return (
        placed.join(F.broadcast(offsets), "part")
        .withColumn("at", F.col("before_n") + F.col("place"))
        .withColumn("shard", shard)
        .select(
            F.col("id").alias(id_col),
            F.when(~F.col("no_src"), F.col("src")).alias(source_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("at") - start).cast("long").alias("slot"),
        )
    )
