"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Tokens are summed by source and hash bucket.  Running sums over the buckets find, for each source,
the bucket in which its budget ends; only rows of that bucket are summed again by the next bits of
the hash, and so on down to the whole hash.  The result is one threshold per source, and the mix
is a filter: nothing sorts the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sharding import ranged, running, seeded_hash
from .store import written

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = (12, 16, 16, 16)  #: bits of the hash that each level of the histogram reads; together 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, sources_per_part: int = 50_000) -> DataFrame:
    """``sizes`` (src, no_src, source_size) with the words that each source is to give.

    Sources in order of code points, null last, weigh ``weights`` in turn and share the total by
    weight.  A source stops at ``most`` times its size; the excess goes to the others by weight
    until none is above.  That end point is a water level: sources with the lowest limit per
    weight are the ones that stop, so running sums in that order find it.  Where sources are many,
    as hosts are, ranges of them are summed first, and no task sees them all.
    """
    sizes = written(sizes, "mix-sizes")
    n = sizes.count()
    named = ranged(sizes, ["no_src", "src"], n, sources_per_part, "mix-names")
    offsets = running(named.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "n")
    k = F.col("before_n") + F.col("place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (k % len(weights) + 1).cast("int"))
    weighed = (
        named.join(F.broadcast(offsets), "part")
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .select("src", "no_src", "source_size", "weight", "cap", "ratio")
    )
    limited = ranged(weighed, ["ratio", "no_src", "src"], n, sources_per_part, "mix-limits")
    sums = limited.groupBy("part").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.sum("source_size").alias("size"))
    earlier = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    caps_before, weights_before = (F.col(f"before_{c}") + F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("cap", "weight"))
    here = (F.col("all_size") - caps_before).cast("double") / (F.col("all_weight") - weights_before)
    levels = limited.join(F.broadcast(running(sums, "cap", "weight", "size")), "part").select("part", "place", "ratio", here.alias("level"))
    first = levels.filter(F.col("ratio") >= F.col("level")).agg(F.min(F.struct("part", "place", "level")).alias("x")).first()["x"]
    level = F.lit(first["level"] if first else None).cast("double")
    target = F.when(F.col("ratio") < level, F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return limited.select("src", "no_src", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(src, no_src, source_size, target, repeats, below): rows of hash less than ``below`` are taken once more than ``repeats``."""
    repeats = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(3))).otherwise(0).cast("long")
    state = (
        goals.withColumn("repeats", repeats)
        .withColumn("left", F.col("target") - F.col("repeats") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("open", F.col("left") > 0)
    )
    state = written(state, "mix-state")
    shift, key = sum(LEVELS), ["src", "no_src", "prefix"]
    for bits in LEVELS:
        seen, shift = shift, shift - bits
        part = rows.withColumn("bucket", F.shiftright("h", shift))
        budgets = state.filter("open").select(*key, "left")
        if seen == sum(LEVELS):  # summed before they meet the budgets, so that a large source isn't shuffled
            all_sums = part.groupBy("src", "no_src", F.lit(0).cast("long").alias("prefix"), "bucket").agg(F.sum("size").alias("s"))
            sums = all_sums.join(budgets, key)
        else:  # only rows in the bucket at which the budget of their source ends
            sums = part.withColumn("prefix", F.shiftright("h", seen)).join(budgets, key).groupBy(*key, "left", "bucket").agg(F.sum("size").alias("s"))
        upto = F.sum("s").over(Window.partitionBy(*key, "left").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        ends = (
            sums.withColumn("upto", upto)
            .filter(F.col("upto") > F.col("left"))
            .groupBy("src", "no_src")
            .agg(F.min(F.struct("bucket", "s", "upto")).alias("end"))
        )
        state = (
            state.join(ends, ["src", "no_src"], "left")
            .withColumn("found", F.col("end").isNotNull())
            .withColumn("left", F.when(F.col("found"), F.col("left") - (F.col("end.upto") - F.col("end.s"))).otherwise(F.col("left")))
            .withColumn("prefix", F.when(F.col("found"), F.col("end.bucket")).otherwise(F.shiftleft("prefix", bits)))
            .withColumn("last", F.col("end.s"))
            .withColumn("open", F.col("open") & F.col("found"))
            .drop("end", "found")
        )
        state = written(state, "mix-state")
        if shift:
            state = state.drop("last")
    # The rows of one whole hash go in if that ends nearer to the budget.
    closer = F.col("open") & (F.col("last") - F.col("left") < F.col("left"))
    return state.withColumn("below", F.col("prefix") + F.when(closer, 1).otherwise(0)).select("src", "no_src", "source_size", "target", "repeats", "below")


def mix(
    docs: DataFrame,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (1, 2, 3),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken = copies * size, and the columns ``keep``.

    * size counts runs of characters other than ASCII white space; a null or empty text has none.
    * A null source is a source of its own and comes last.
    * Whole texts are taken, from 0 to 3 times.  Rows with one id share their hash, so they are
      taken alike; the words taken of a source differ from its target by half the words of one id
      at most.
    * The same input and seed give the same result, in whatever order rows come.
    * An empty table gives an empty result.  Other columns are not read.
    * Columns of ``keep`` come from the input as it lies, in a second reading, and are never
      shuffled; one named like another column of the result is an error.
    """
    own = (id_col, source_col, "size", "source_size", "target", "copies", "taken")
    if len({*own, *keep}) < len(own) + len(keep):
        raise ValueError("keep names a column twice, or one of the result's own")
    read = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        F.col(source_col).isNull().alias("no_src"),
        word_count(F.col(text_col)).alias("size"),
        seeded_hash(seed, F.col(id_col)).alias("h"),
        *([F.struct(*keep).alias("kept")] if keep else []),
    )
    rows = written(read.drop("kept"), "mix-rows")
    sizes = rows.groupBy("src", "no_src").agg(F.sum("size").alias("source_size"))
    limits = thresholds(rows, targets(sizes, weights))
    copies = F.col("repeats") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return (read if keep else rows).join(limits, ["src", "no_src"]).select(
        F.col("id").alias(id_col),
        F.when(~F.col("no_src"), F.col("src")).alias(source_col),
        "size",
        "source_size",
        "target",
        copies.cast("int").alias("copies"),
        (copies * F.col("size")).alias("taken"),
        *[F.col("kept")[c].alias(c) for c in keep],
    )
