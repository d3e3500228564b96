"""Videos as Spark data sources: ``video_meta`` (one row a file) and ``video`` (one row a frame).

Metadata and pixels are two sources because a Python source isn't told which columns are wanted.
``video`` takes ``[start, stop)`` by options, and equality and range predicates on frame_idx by
pushdown; only frames in range are decoded.  A file that can't be opened gives a row with an error
in ``video_meta`` and is skipped in ``video`` unless ``strict`` is set.

Spark 4.1 keeps one set of pushed predicates for each DataFrame that was loaded from a Python source.
A query that filters the same frames in two ways must load them twice, or both get the same rows.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..functions.position import small
from ..functions.scalar import hash16, stem
from .decoders import check_name, opened

META = "path string, fps double, num_frames int, duration_sec double, width int, height int, codec string, size_bytes bigint, mtime_ns bigint, error string"
FRAMES = "path string, frame_idx int, height int, width int, channels int, data binary"


MAX_PARTITIONS = 10_000


@dataclass
class Files(InputPartition):
    paths: list[str]


def stored_name(path: str) -> str:
    """The file below a sink's folder that holds the frames of ``path``: paths that differ in their folder alone have files of their own."""
    return f"{os.path.splitext(os.path.basename(path))[0]}-{hashlib.sha256(path.encode()).hexdigest()[:16]}.npy"


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.backend, self.device = check_name(options.get("backend", "auto")), options.get("device", "cpu")
        self.strict = options.get("strict", "false").lower() == "true"
        self.first, self.stop = int(options.get("start", 0)), int(options["stop"]) if "stop" in options else None

    def partitions(self) -> list[Files]:
        """The file, or the files of the folder whose names match ``pattern``: a partition each, unless they are very many."""
        path = re.sub("^file:/*", "/", self.path)
        if os.path.isdir(path):
            with os.scandir(path) as found:
                paths = sorted(f.path for f in found if f.is_file() and fnmatch.fnmatchcase(f.name, self.pattern))
        else:
            paths = [path]
        n = max(1, min(MAX_PARTITIONS, len(paths)))
        return [Files(paths[k::n]) for k in range(n)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self.rows(path)


class MetaReader(_Reader):
    def rows(self, path: str) -> Iterator[tuple]:
        stat, error = None, None
        try:
            stat = os.stat(path)
            with opened(path, self.backend, self.device) as d:
                yield path, float(d.fps), d.num_frames, d.num_frames / d.fps if d.fps > 0 else 0.0, d.width, d.height, d.codec, stat.st_size, stat.st_mtime_ns, None
                return
        except Exception as e:  # planning goes on without the file
            error = f"{type(e).__name__}: {e}"
        yield path, None, None, None, None, None, None, stat and stat.st_size, stat and stat.st_mtime_ns, error


class FrameReader(_Reader):
    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) != ("frame_idx",) or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    stop = f.value + (not isinstance(f, LessThan))
                    self.stop = stop if self.stop is None else min(self.stop, stop)
            else:
                yield f

    def rows(self, path: str) -> Iterator[tuple]:
        try:
            d = opened(path, self.backend, self.device)
        except Exception:
            if self.strict:
                raise
            return
        with d:
            stop = d.num_frames if self.stop is None else min(self.stop, d.num_frames)
            for i, frame in enumerate(d.read_clip(self.first, stop) if self.first < stop else (), self.first):
                yield path, i, frame.shape[0], frame.shape[1], frame.shape[2], frame.tobytes()


@dataclass
class Done(WriterCommitMessage):
    names: list[str]


class FrameWriter(DataSourceWriter):
    """Rows (path, frame_idx, height, width, channels, data) to one .npy file a path, below the folder given.

    Rows of a path must lie in one partition, in order (``write_videos`` sees to it).  Files are written
    aside, frame by frame, and take their places, over older ones too, when all tasks have ended well.
    """

    def __init__(self, folder: str) -> None:
        self.folder, self.aside = folder, os.path.join(folder, f"_temporary-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Done:
        own = os.path.join(self.aside, uuid.uuid4().hex)  # of this attempt
        os.makedirs(own)
        names, raw, shape, n = [], None, None, 0

        def close() -> None:
            if raw is not None:
                raw.close()
                with open(raw.name, "rb") as pixels, open(os.path.join(own, names[-1]), "wb") as out:
                    np.lib.format.write_array_header_1_0(out, {"descr": "|u1", "fortran_order": False, "shape": (n, *shape)})
                    shutil.copyfileobj(pixels, out, 1 << 20)
                os.remove(raw.name)

        path = None
        for row in iterator:
            if raw is None or row["path"] != path:
                close()
                path, shape, n = row["path"], (row["height"], row["width"], row["channels"]), 0
                names.append(stored_name(path))
                raw = open(os.path.join(own, names[-1] + ".raw"), "wb")  # noqa: SIM115
            data = bytes(row["data"])
            if (row["height"], row["width"], row["channels"]) != shape or len(data) != shape[0] * shape[1] * shape[2]:
                raise ValueError(f"frame {row['frame_idx']} of {path} isn't of the shape {shape}")
            raw.write(data)
            n += 1
        close()
        return Done([os.path.join(os.path.basename(own), name) for name in names])

    def commit(self, messages: list) -> None:
        for name in (x for m in messages if m for x in m.names):
            os.replace(os.path.join(self.aside, name), os.path.join(self.folder, os.path.basename(name)))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class VideoMetaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "video_meta"

    def schema(self) -> str:
        return META

    def reader(self, schema) -> MetaReader:
        return MetaReader(self.options)


class VideoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "video"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VideoMetaSource)
    spark.dataSource.register(VideoSource)


def write_videos(frames: DataFrame, folder: str) -> None:
    register(frames.sparkSession)
    frames.repartition("path").sortWithinPartitions("path", "frame_idx").write.format("video").mode("append").option("path", folder).save()


def listing(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """(path, size, mtime) of a folder's files, in order; their content isn't read.  An empty folder is an error."""
    out = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("size"), "modificationTime")
    if out.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return out.orderBy("path")


def camera_listing(spark: SparkSession, folder: str, cameras: list[str], pattern: str = "*.mp4") -> DataFrame:
    """(camera, episode_ord, path, size): a subfolder for each camera, episodes matched by their order."""
    from functools import reduce

    from pyspark.sql import Window

    each = [listing(spark, f"{folder.rstrip('/')}/{c}", pattern).withColumn("camera", F.lit(c)) for c in cameras]
    order = F.row_number().over(Window.partitionBy("camera").orderBy("path")) - 1
    return reduce(DataFrame.unionByName, each).select("camera", order.alias("episode_ord"), "path", "size")


def _local(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def files_hash(spark: SparkSession, folder: str, cameras: list[str] | None = None, pattern: str = "*.mp4") -> str:
    """16 hexadecimal digits of the files' cameras, paths and sizes, in order: whether a pack's source has changed.

    A file's line is hashed before the lines meet, so a row that holds them is as long as 32 bytes a file.
    """
    files = camera_listing(spark, folder, cameras, pattern) if cameras else listing(spark, folder, pattern).withColumn("camera", F.lit(None).cast("string"))
    lines = files.select("camera", "path", F.unhex(F.md5(F.concat_ws(":", "camera", _local(F.col("path")), "size"))).alias("line"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("camera", "path", "line"))), lambda x: F.hex(x["line"]))
    return lines.agg(hash16(F.array_join(ordered, "")).alias("h")).first()["h"]


def episode_frames(
    spark: SparkSession, folder: str, cameras: list[str] | None = None, backend: str = "auto", pattern: str = "*.mp4", strict: bool = False, device: str = "cpu"
) -> DataFrame:
    """(episode, camera, frame_idx, height, width, channels, data) of a folder's videos, or of a subfolder for each camera.

    An episode is named after its file; with cameras, after that of the first camera, matched by order.
    """
    from functools import reduce

    register(spark)
    folder = folder.rstrip("/")

    def read(path: str) -> DataFrame:
        return spark.read.format("video").options(path=path, pattern=pattern, backend=backend, strict=str(strict), device=device).load()

    columns = ("episode", "camera", F.col("frame_idx").cast("long").alias("frame_idx"), "height", "width", "channels", "data")
    if not cameras:
        if listing(spark, folder, pattern).isEmpty():
            raise FileNotFoundError(f"no {pattern} in {folder}")
        return read(folder).withColumns({"episode": stem(F.col("path")), "camera": F.lit(None).cast("string")}).select(*columns)
    files = camera_listing(spark, folder, cameras, pattern)
    names = files.filter(F.col("camera") == cameras[0]).select("episode_ord", stem(F.col("path")).alias("episode"))
    files = small(files.join(names, "episode_ord").select("episode", "camera", _local(F.col("path")).alias("path")))
    frames = reduce(DataFrame.unionByName, [read(f"{folder}/{c}").withColumn("camera", F.lit(c)) for c in cameras])
    return frames.join(files, ["camera", "path"]).select(*columns)


def as_array(frames: DataFrame, output: str = "numpy"):
    """Frames of one clip, in order, as an array (frames, height, width, channels); ``output`` torch gives a tensor.

    It is for a clip that was chosen: its pixels come to the caller.
    """
    if output not in ("numpy", "torch"):
        raise ValueError("output is numpy or torch")
    rows = frames.orderBy("frame_idx").select("height", "width", "channels", "data").collect()
    if not rows:
        raise IndexError("no frames")
    out = np.stack([np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["height"], r["width"], r["channels"]) for r in rows])
    if output == "numpy":
        return out
    import torch

    return torch.from_numpy(out)
