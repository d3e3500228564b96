"""Samplers: which frames of each video a clip has.

Each takes ``videos`` (video_id, num_frames) and gives (video_id, pos, frame_idx).  Random choices
are orders by a seeded hash, so any engine and any partitioning gives the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import draw, seeded


def uniform_indices(n: int, total: Column) -> Column:
    """n indices from first to last; halves round to even, and short videos give all they have."""
    if n < 1:
        raise ValueError("num_frames must be at least 1")
    every = F.sequence(F.lit(0).cast("long"), total - 1)
    spread = F.array(F.lit(0).cast("long")) if n == 1 else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * ((total - 1) / F.lit(n - 1))).cast("long"))
    return F.when(total <= n, every).otherwise(spread)


def uniform(videos: DataFrame, n: int) -> DataFrame:
    return videos.filter("num_frames > 0").select("video_id", F.posexplode(uniform_indices(n, F.col("num_frames"))).alias("pos", "frame_idx"))


def dense(videos: DataFrame, stride: int = 1) -> DataFrame:
    if stride < 1:
        raise ValueError("stride must be at least 1")
    return videos.filter("num_frames > 0").select("video_id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("num_frames") - 1, F.lit(stride).cast("long"))).alias("pos", "frame_idx"))


def random_window(videos: DataFrame, n: int, seconds: float, fps: float, seed: int = 0) -> DataFrame:
    """n distinct frames, sorted, of a window that starts anywhere."""
    if n < 1:
        raise ValueError("num_frames must be at least 1")
    width = F.least(F.lit(int(seconds * fps)).cast("long"), F.col("num_frames"))
    starts = videos.withColumn("w", width).filter("w > 0").withColumn("start", draw(seeded(seed, F.col("video_id")), F.greatest(F.lit(0).cast("long"), F.col("num_frames") - F.col("w")) + 1))
    each = starts.select("video_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("w") - 1)).alias("frame_idx"))
    order = Window.partitionBy("video_id").orderBy(seeded(seed, F.col("video_id"), F.col("frame_idx")), "frame_idx")
    chosen = each.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n)
    return chosen.select("video_id", (F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")) - 1).alias("pos"), "frame_idx")


def episodes(videos: DataFrame, boundaries: list[int]) -> DataFrame:
    """(video_id, ep_idx, start, end): each runs to the next start, the last to the end of the video."""
    if not boundaries:
        raise ValueError("no episode boundaries")
    starts = videos.select("video_id", "num_frames", F.explode(F.array(*[F.lit(b).cast("long") for b in sorted(set(boundaries))])).alias("start")).filter("start < num_frames")
    w = Window.partitionBy("video_id").orderBy("start")
    end = F.coalesce(F.lead("start").over(w), F.col("num_frames"))
    return starts.select("video_id", (F.row_number().over(w) - 1).alias("ep_idx"), "start", end.alias("end"))


def episode(videos: DataFrame, boundaries: list[int], n: int = 16, seed: int = 0) -> DataFrame:
    """One episode of each video, drawn by seed, sampled uniformly."""
    eps = episodes(videos, boundaries)
    count = F.count(F.lit(1)).over(Window.partitionBy("video_id"))
    chosen = eps.withColumn("pick", draw(seeded(seed, F.col("video_id")), count)).filter("ep_idx = pick")
    inside = chosen.select("video_id", "start", F.posexplode(uniform_indices(n, F.col("end") - F.col("start"))).alias("pos", "offset"))
    return inside.select("video_id", "pos", (F.col("start") + F.col("offset")).alias("frame_idx"))


def custom(videos: DataFrame, indices: Callable[[Column], Column]) -> DataFrame:
    """A sampler of the caller's: a column of indices from the column of lengths."""
    return videos.select("video_id", F.posexplode(indices(F.col("num_frames"))).alias("pos", "frame_idx"))


def benchmark_starts(videos: DataFrame, trials: int, length: int, mode: str = "sequential", seed: int = 0) -> DataFrame:
    """Start of the clip of each trial; sequential starts wrap around."""
    if mode not in ("sequential", "random"):
        raise ValueError("mode is sequential or random")
    each = videos.filter(F.col("num_frames") >= length).select("video_id", (F.col("num_frames") - length).alias("last"), F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    start = F.col("trial").cast("long") * length % (F.col("last") + 1) if mode == "sequential" else draw(seeded(seed, F.col("video_id"), F.col("trial")), F.col("last") + 1)
    return each.select("video_id", "trial", start.alias("start"))
