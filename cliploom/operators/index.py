"""Frame index: display order, keyframes and decode cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def build(packets: DataFrame) -> DataFrame:
    """(video_id, frame_idx, pts, is_keyframe, keyframe_pts) from packets in any order; pts is distinct in a video.

    Frames before the first keyframe take the first pts.
    """
    by_pts = Window.partitionBy("video_id").orderBy("pts")
    so_far = by_pts.rowsBetween(Window.unboundedPreceding, 0)
    last_key = F.last(F.when(F.col("is_keyframe"), F.col("pts")), ignorenulls=True).over(so_far)
    return packets.select(
        "video_id",
        (F.row_number().over(by_pts).cast("long") - 1).alias("frame_idx"),
        "pts",
        "is_keyframe",
        F.coalesce(last_key, F.first("pts").over(so_far)).alias("keyframe_pts"),
    )


def frames_to_decode(index: DataFrame) -> DataFrame:
    """Frames from the keyframe at or before each frame, both included; all before it where there is none."""
    w = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    key = F.last(F.when(F.col("is_keyframe"), F.col("frame_idx")), ignorenulls=True).over(w)
    return index.select("video_id", "frame_idx", (F.col("frame_idx") - F.coalesce(key, F.lit(0)) + 1).alias("to_decode"))


def gop_stats(index: DataFrame) -> DataFrame:
    n, k = F.count(F.lit(1)), F.count_if("is_keyframe")
    return index.groupBy("video_id").agg(n.alias("num_frames"), k.alias("num_keyframes"), F.when(k > 0, n / k).otherwise(0.0).alias("avg_gop_size"))


def missing(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files (cache_key, ...) for which no index is kept; a changed size or time changes the key."""
    return files.join(cached.select("cache_key").distinct(), "cache_key", "left_anti")
