"""Scalar expressions as columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: int, *parts: Column) -> Column:
    """The MD5 of a seed and some values: a reproducible random order that any SQL engine gives alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def draw(key: Column, n: Column) -> Column:
    """A number from 0 to n - 1, from an MD5."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n


def pts_of_frame(frame: Column, fps: Column, tb_num: int, tb_den: int) -> Column:
    return F.floor(frame * F.lit(tb_den) / (F.lit(tb_num) * fps)).cast("long")


def duration(num_frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, num_frames / fps).otherwise(0.0)


def frame_count(num_frames: Column, duration_sec: Column, fps: Column) -> Column:
    """The count as stored, or from the duration where none is stored."""
    return F.when(num_frames == 0, (duration_sec * fps).cast("long")).otherwise(num_frames)


def seek(ts: Column, fps: Column, num_frames: Column) -> Column:
    """Truncated, not nearest, and clamped to the video."""
    return F.greatest(F.lit(0), F.least((ts * fps).cast("long"), num_frames - 1))


def fourcc(code: Column) -> Column:
    return F.concat(*[F.chr(F.shiftright(code, 8 * k).bitwiseAND(F.lit(255))) for k in range(4)])


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def resolution(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, "x")
    return parts[0].cast("int"), parts[1].cast("int")


def names(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda name: F.trim(name))


def shard_file(shard: Column, camera: Column | None = None) -> Column:
    """shard_0000.mp4, or shard_0000_camera.mp4 where there is a camera."""
    name = F.format_string("shard_%04d", shard)
    return F.concat(F.concat_ws("_", name, camera) if camera is not None else name, F.lit(".mp4"))


def hash16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_key(path: Column, size: Column, mtime_ns: Column) -> Column:
    return hash16(F.concat_ws("|", path, size.cast("string"), mtime_ns.cast("string")))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def megabytes(size: Column) -> Column:
    return size / F.lit(1024.0 * 1024.0)


def summary(clips: Column, frames: Column, shards: Column, size: Column) -> Column:
    return F.format_string("%d clips, %d frames, %d shards, %.1f MB", clips, frames, shards, megabytes(size))


def codec_settings(codec: Column, crf: Column) -> Column:
    """Pixel format, quality option and group of pictures of each codec; every frame is a keyframe."""
    return F.struct(
        F.when(codec == "mjpeg", "yuvj420p").otherwise("yuv420p").alias("pix_fmt"),
        F.when(codec == "h264", "crf").when(codec == "mjpeg", "q:v").alias("option"),
        F.when(codec == "h264", crf).when(codec == "mjpeg", clamp(crf, 2, 31)).alias("quality"),
        F.when(codec == "h264", "fast").alias("preset"),
        F.when(codec == "h264", 1).alias("gop"),
        F.when(codec == "h264", 0).alias("b_frames"),
    )


def pad(values: Column, length: Column, filler: Column) -> Column:
    return F.slice(F.concat(values, F.array_repeat(filler, length.cast("int"))), F.lit(1), length.cast("int"))


def padding_mask(own: Column, length: Column) -> Column:
    """True for as many places as the clip has."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: i < own)


def chw_to_hwc(flat: Column, c: int, h: int, w: int) -> Column:
    """Index arithmetic on a flattened (channel, row, column) array."""
    return F.transform(F.sequence(F.lit(0), F.lit(c * h * w - 1)), lambda i: F.get(flat, (i % c) * (h * w) + F.floor(i / c).cast("int")))


def swap_channels(flat: Column, c: int = 3) -> Column:
    """BGR to RGB of a flattened (row, column, channel) array."""
    return F.transform(flat, lambda _, i: F.get(flat, i - (i % c) + (c - 1 - i % c)))


def resize_area(flat: Column, h: int, w: int, factor: int) -> Column:
    """Block means of a flattened one-channel image; whole factors only."""
    if h % factor or w % factor:
        raise ValueError("height and width must be multiples of the factor")
    oh, ow = h // factor, w // factor
    sums = [
        [F.get(flat, F.lit((y * factor + dy) * w + x * factor + dx)).cast("double") for dy in range(factor) for dx in range(factor)]
        for y in range(oh)
        for x in range(ow)
    ]
    return F.array(*[sum(cells[1:], cells[0]) / F.lit(float(factor * factor)) for cells in sums])
