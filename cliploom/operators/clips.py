"""Clip plans, shards and the joins around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.position import small, with_position
from ..functions.scalar import seek, seeded, shard_file


def plan(videos: DataFrame, length: int, stride: int | None = None, most: int | None = None, seed: int = 42) -> DataFrame:
    """(video_id, frame_start, frame_end) of all whole clips; ``most`` a video, drawn by seed."""
    stride = stride or length
    if length < 1 or stride < 1:
        raise ValueError("length and stride must be at least 1")
    long_enough = videos.filter(F.col("num_frames") >= length)  # sequence() runs downwards otherwise
    starts = long_enough.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_frames") - length, F.lit(stride).cast("long"))).alias("frame_start"))
    if most is not None:
        order = Window.partitionBy("video_id").orderBy(seeded(seed, F.col("video_id"), F.col("frame_start")), "frame_start")
        starts = starts.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")
    return starts.select("video_id", "frame_start", (F.col("frame_start") + length).alias("frame_end"))


def plan_cameras(videos: DataFrame, length: int, stride: int | None = None) -> DataFrame:
    """Clips of every camera from videos (episode, camera, num_frames): an episode is as long as its shortest camera."""
    shortest = videos.groupBy("episode").agg(F.min("num_frames").alias("num_frames")).withColumnRenamed("episode", "video_id")
    return plan(shortest, length, stride).withColumnRenamed("video_id", "episode").join(videos.select("episode", "camera"), "episode")


def shuffle(clips: DataFrame, seed: int = 42, episode: str = "video_id") -> DataFrame:
    """Clips with their position in a seeded order.  The key leaves the camera out, so cameras stay in step."""
    keyed = clips.withColumn("key", seeded(seed, F.col(episode), F.col("frame_start")))
    return with_position(keyed, "key", episode, "frame_start")


def shards(shuffled: DataFrame, per_shard: int) -> DataFrame:
    place = F.col("position")
    return shuffled.withColumn("shard_id", F.floor(place / per_shard).cast("long")).withColumn("clip_index", place % per_shard)


def frames_of(clips: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of each clip: the plan, expanded to frame numbers, meets the frames in an equi-join."""
    each = clips.withColumn("frame_idx", F.explode(F.sequence("frame_start", F.col("frame_end") - 1)))
    return each.join(frames, ["video_id", "frame_idx"])


def dataset(frames: DataFrame, sampled: DataFrame, transform: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One clip a video: the frames that a sampler gave (video_id, pos, frame_idx), with functions of columns applied."""
    clips = sampled.join(frames, ["video_id", "frame_idx"])
    return clips.withColumns({name: f(F.col(name)) for name, f in (transform or {}).items()})


def by_shard(clips: DataFrame) -> DataFrame:
    """(shard_id, clips): what each shard holds, in its order; a shard's clips are bounded by the plan."""
    each = F.struct("clip_index", "video_id", "frame_start")
    return clips.groupBy("shard_id").agg(F.sort_array(F.collect_list(each)).alias("clips"))


def labels_of(clips: DataFrame, labels: DataFrame, width: int = 64) -> DataFrame:
    """Labels (video_id, at, ...) that lie in each clip.

    Both meet in stretches of ``width`` frames, of which a clip has a few: work follows the labels of a clip, not those of its video.
    """
    inside = (F.col("at") >= F.col("frame_start")) & (F.col("at") < F.col("frame_end"))
    stretch = lambda c: F.floor(c / width).cast("long")
    some = clips.filter("frame_end > frame_start")
    each = some.withColumn("_stretch", F.explode(F.sequence(stretch(F.col("frame_start")), stretch(F.col("frame_end") - 1))))
    return each.join(labels.withColumn("_stretch", stretch(F.col("at"))), ["video_id", "_stretch"]).filter(inside).drop("_stretch")


def sync(frames: DataFrame, times: DataFrame, fps: float) -> DataFrame:
    """The frame of each camera (episode, camera, frame_idx) at each time of a small table."""
    n = frames.groupBy("episode", "camera").agg(F.count(F.lit(1)).alias("num_frames"))
    wanted = n.crossJoin(small(times.select("ts"))).select("episode", "camera", "ts", seek(F.col("ts"), F.lit(fps), F.col("num_frames")).alias("frame_idx"))
    return frames.join(wanted, ["episode", "camera", "frame_idx"])


def lockstep(clips: DataFrame) -> DataFrame:
    """(shard_id, clip_index, cameras, in_step): whether all cameras have the same clip there."""
    g = clips.groupBy("shard_id", "clip_index")
    return g.agg(F.count(F.lit(1)).alias("cameras"), (F.countDistinct("episode", "frame_start") == 1).alias("in_step"))


def shard_stats(clips: DataFrame, length: int, frame_bytes: int = 1) -> DataFrame:
    n = F.count(F.lit(1))
    g = clips.groupBy("shard_id").agg(n.alias("num_clips"), (n * length).alias("num_frames"), (n * length * frame_bytes).alias("size_bytes"))
    return g.withColumn("file", shard_file(F.col("shard_id")))


def totals(shard_rows: DataFrame) -> DataFrame:
    """Counts of a pack: clips of the first camera only, everything else of all cameras.  Shards are summed by camera first."""
    g = shard_rows.groupBy("camera").agg(F.count(F.lit(1)).alias("n"), F.sum("num_clips").alias("clips"), F.sum("num_frames").alias("frames"), F.sum("size_bytes").alias("bytes"))
    return g.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_shards"),
        F.coalesce(F.min_by("clips", "camera"), F.max("clips")).alias("total_clips"),  # without a named camera there is one group
        F.sum("frames").alias("total_frames"),
        F.sum("bytes").alias("total_size_bytes"),
    )


def verify(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(file, status): ok, missing or wrong_count, from the manifest's shards and what the files hold: clips and frames."""
    counts = ("num_clips", "num_frames")
    have = found.select("file", *[F.col(c).alias(f"have_{c}") for c in counts])
    joined = expected.select("file", *counts).join(have, "file", "left")
    wrong = (F.col("have_num_clips") != F.col("num_clips")) | (F.col("have_num_frames") != F.col("num_frames"))
    return joined.select("file", F.when(F.col("have_num_clips").isNull(), "missing").when(wrong, "wrong_count").otherwise("ok").alias("status"))


def per_episode(clips: DataFrame) -> DataFrame:
    n = clips.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("episodes"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def epoch_order(shard_ids: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Shards with their position in the epoch: seed + epoch seeds the order, so every worker agrees."""
    keyed = shard_ids.withColumn("key", seeded(seed + epoch, F.col("shard_id")))
    return with_position(keyed, "key", "shard_id").drop("key")


def of_worker(ordered: DataFrame, worker: int, workers: int) -> DataFrame:
    return ordered.filter(F.col("position") % workers == worker)


def stream_clips(videos: DataFrame, length: int, workers: int = 1) -> DataFrame:
    """(video_id, worker, clip, frame_start): clips that follow one another from each worker's first frame; tails are dropped.

    Workers have N // workers frames each, the last one the rest.
    """
    each = videos.select("video_id", "num_frames", F.floor(F.col("num_frames") / workers).alias("share"), F.explode(F.sequence(F.lit(0), F.lit(workers - 1))).alias("worker"))
    begin = F.col("worker") * F.col("share")
    stop = F.when(F.col("worker") == workers - 1, F.col("num_frames")).otherwise(begin + F.col("share"))
    whole = each.withColumn("begin", begin).withColumn("clips", F.floor((stop - begin) / length)).filter("clips > 0")
    listed = whole.select("video_id", "worker", "begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("clips") - 1)).alias("clip"))
    return listed.select("video_id", "worker", "clip", (F.col("begin") + F.col("clip") * length).alias("frame_start"))


def collate(clips: DataFrame, batch_size: int) -> DataFrame:
    """(batch_id, slot, length, clip, mask): clips (pos, values) padded to the longest of their batch."""
    from ..functions.scalar import pad, padding_mask

    batched = clips.withColumn("batch_id", F.floor(F.col("pos") / batch_size).cast("long")).withColumn("slot", F.col("pos") % batch_size)
    longest = F.max(F.size("values")).over(Window.partitionBy("batch_id"))
    sized = batched.withColumn("length", longest).withColumn("own", F.size("values"))
    return sized.select("batch_id", "slot", "length", pad(F.col("values"), F.col("length"), F.lit(0.0)).alias("clip"), padding_mask(F.col("own"), F.col("length")).alias("mask"))


def source_hash(files: DataFrame) -> DataFrame:
    """One fingerprint of all files (source, camera, path, size) of each source, by camera, then path."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("camera", "path", "size"))), lambda f: F.concat(f["path"], F.lit(":"), f["size"].cast("string"))), "")
    return files.groupBy("source").agg(F.substring(F.sha2(listed, 256), 1, 16).alias("source_hash"))


def latencies(trials: DataFrame, length: int) -> DataFrame:
    """p50, p95 and p99 by linear interpolation, and frames a second."""
    p = [F.percentile("latency", q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]
    total = F.sum("latency")
    return trials.groupBy("group_id").agg(*p, F.when(total > 0, F.count(F.lit(1)) * length / total).otherwise(0.0).alias("throughput"))
