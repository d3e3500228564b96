"""Contracts of operators, against plain Python."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cliploom.functions import scalar as S
from cliploom.operators import clips as C
from cliploom.operators import index as I
from cliploom.operators import sampling as P
from cliploom.operators import select as L


@pytest.fixture(scope="module")
def videos(spark):
    return spark.createDataFrame([("a", 60), ("b", 7), ("c", 0), ("d", 150)], "video_id string, num_frames long")


@pytest.fixture(scope="module")
def frames(spark, videos):
    each = videos.filter("num_frames > 0").select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_frames") - 1)).alias("frame_idx"))
    return each.cache()


def of(df, video="a", column="frame_idx", order="frame_idx"):
    return [r[column] for r in df.filter(F.col("video_id") == video).orderBy(order).collect()]


def test_uniform_rounds_half_to_even(spark):
    grid = [(n, total) for n in range(1, 9) for total in range(1, 40)]
    for n in range(1, 9):
        rows = spark.createDataFrame([(str(t), t) for _, t in grid if _ == n], "video_id string, num_frames long")
        got = {}
        for r in P.uniform(rows, n).collect():
            got.setdefault(int(r["video_id"]), []).append(r["frame_idx"])
        for t, found in got.items():
            want = list(range(t)) if t <= n else [0] if n == 1 else [int(round(i * (t - 1) / (n - 1))) for i in range(n)]
            assert sorted(found) == want
    assert of(P.uniform(spark.createDataFrame([("a", 6)], "video_id string, num_frames long"), 3)) == [0, 2, 5]


@pytest.mark.parametrize("call", [lambda v: P.uniform(v, 0), lambda v: P.dense(v, 0), lambda v: P.episode(v, []), lambda v: P.random_window(v, 0, 1, 30)])
def test_bad_parameters(videos, call):
    with pytest.raises(ValueError):
        call(videos)


def test_dense_and_random_and_episode(videos):
    assert of(P.dense(videos, 25)) == [0, 25, 50]
    got = of(P.random_window(videos, 4, 0.5, 30.0, seed=5))
    assert len(set(got)) == 4 and got == sorted(got) and got[-1] - got[0] < 15
    assert got == of(P.random_window(videos, 4, 0.5, 30.0, seed=5))
    starts = set()
    for seed in range(12):
        eps = of(P.episode(videos, [0, 50, 100], 8, seed), "d")
        assert [x - eps[0] for x in eps] == [0, 7, 14, 21, 28, 35, 42, 49]
        starts.add(eps[0])
    assert starts <= {0, 50, 100} and len(starts) > 1
    assert of(P.custom(videos.filter("num_frames > 0"), lambda n: F.array(n - 1))) == [59]


@pytest.mark.parametrize("part", [(3, 9, None), (-5, None, None), (None, None, 7), (50, 99, 2), (-99, 4, None), (9, 3, None)])
def test_slices_as_python(frames, part):
    assert of(L.frame_slice(frames, *part)) == list(range(60))[slice(*part)]


def test_positions(frames):
    assert of(L.frame_at(frames, -1)) == [59]
    assert of(L.frame_fancy(frames, [5, 2, 5]), order="pos") == [5, 2, 5]
    assert of(L.clip_range(frames, 3, 5)) == [3, 4]
    for bad in (lambda: L.frame_at(frames, 9999, strict=True), lambda: L.clip_range(frames, 50, 70, strict=True), lambda: L.frame_slice(frames, 5, 5, strict=True)):
        with pytest.raises(PySparkException):
            bad().collect()
    for call, error in ((lambda: L.frame_at(frames, "1"), TypeError), (lambda: L.frame_slice(frames, 0, 5, -1), IndexError), (lambda: L.frame_fancy(frames, []), ValueError), (lambda: L.frame_fancy(frames, [-1]), IndexError), (lambda: L.clip_range(frames, 5, 5), IndexError)):
        with pytest.raises(error):
            call()


def test_point_lookup_reaches_the_scan(spark, frames, tmp_path):
    frames.write.parquet(str(tmp_path / "f"))
    plan = L.frame_at(spark.read.parquet(str(tmp_path / "f")), 5)._jdf.queryExecution().toString()
    assert "EqualTo(frame_idx,5)" in plan and "Exchange" not in plan


def test_slices_and_lists_reach_the_scan(spark, frames, tmp_path):
    frames.write.parquet(str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    for df in (L.frame_slice(stored, 3, 9, 2), L.frame_slice(stored, 5), L.frame_fancy(stored, [5, 2, 5])):
        plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "PushedFilters: [" in plan and "frame_idx" in plan.split("PushedFilters")[1] and "Exchange" not in plan and "Join" not in plan


def test_labels_of_clips(spark):
    clips = spark.createDataFrame([("a", s, s + n) for s in (0, 5, 60, 63, 64, 190) for n in (1, 7, 64, 150)] + [("a", 9, 9), ("b", 0, 50)], "video_id string, frame_start long, frame_end long")
    labels = spark.createDataFrame([("a", k, f"l{k}") for k in range(0, 400, 3)] + [("b", 49, "x"), ("b", 50, "y")], "video_id string, at long, name string")
    want = clips.crossJoin(labels.withColumnRenamed("video_id", "v")).filter("v = video_id and at >= frame_start and at < frame_end").drop("v")
    key = ["video_id", "frame_start", "frame_end", "at", "name"]
    assert sorted(map(tuple, C.labels_of(clips, labels).select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_seek_truncates_and_clamps(spark):
    df = spark.createDataFrame([(0.5,), (-1.0,), (99.0,), (0.0999,)], "ts double").select(S.seek(F.col("ts"), F.lit(30.0), F.lit(60)).alias("i"))
    assert [r["i"] for r in df.collect()] == [15, 0, 59, 2]


def test_index_with_frames_before_the_first_keyframe(spark):
    rows = [("v", 40, False), ("v", 10, False), ("v", 20, False), ("v", 30, True)]
    index = I.build(spark.createDataFrame(rows, "video_id string, pts long, is_keyframe boolean")).orderBy("pts")
    assert [r["keyframe_pts"] for r in index.collect()] == [10, 10, 30, 30]
    assert [r["to_decode"] for r in I.frames_to_decode(index).orderBy("frame_idx").collect()] == [1, 2, 1, 2]


def test_plans(spark, videos):
    three = spark.createDataFrame([(e, 60) for e in "xyz"], "video_id string, num_frames long")
    assert C.plan(three, 8).count() == 21 and C.plan(three, 8, 4).count() == 42 and C.plan(three, 8, None, 2).count() == 6
    assert of(C.plan(videos, 8), "b", "frame_start", "frame_start") == []
    sizes = C.shards(C.shuffle(C.plan(three, 8)), 5).groupBy("shard_id").count().orderBy("shard_id")
    assert [r["count"] for r in sizes.collect()] == [5, 5, 5, 5, 1]
    order = lambda seed: [tuple(r) for r in C.shuffle(C.plan(three, 8), seed).orderBy("position").select("video_id", "frame_start").collect()]
    assert order(42) == order(42) != order(99) and sorted(order(42)) == sorted(order(99))


@pytest.mark.parametrize(("workers", "clips"), [(1, 3), (2, 2), (4, 0)])
def test_stream_clips_depend_on_workers(spark, workers, clips):
    assert C.stream_clips(spark.createDataFrame([("a", 60)], "video_id string, num_frames long"), 16, workers).count() == clips


def test_epochs_and_workers(spark):
    ids = spark.range(40).select(F.col("id").alias("shard_id"))
    orders = [[r["shard_id"] for r in C.epoch_order(ids, 42, e).orderBy("position").collect()] for e in (0, 1)]
    assert orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1]) == list(range(40))
    parts = [[r["shard_id"] for r in C.of_worker(C.epoch_order(ids, 42, 0), w, 3).collect()] for w in range(3)]
    assert sorted(sum(parts, [])) == list(range(40))


def test_collate_pads_and_masks(spark):
    clips = spark.createDataFrame([(0, [1.0] * 5), (1, [2.0] * 10)], "pos long, values array<double>")
    a, b = C.collate(clips, 2).orderBy("slot").collect()
    assert len(a["clip"]) == len(b["clip"]) == 10 and a["clip"][5:] == [0.0] * 5
    assert a["mask"] == [i < 5 for i in range(10)] and all(b["mask"])


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(S.fourcc(F.lit(int.from_bytes(b"avc1", "little")).cast("long"))) == "avc1"
    assert value(S.stem(F.lit("/a/b.c/ep.000.mp4"))) == "ep.000"
    assert value(S.shard_file(F.lit(7), F.lit("left"))) == "shard_0007_left.mp4"
    assert value(S.codec_settings(F.lit("mjpeg"), F.lit(1)))["quality"] == 2
    assert value(S.names(F.lit("a, b ,c"))) == ["a", "b", "c"]
    x = [random.random() for _ in range(24)]
    flat = F.array(*[F.lit(v) for v in x])
    assert value(S.chw_to_hwc(flat, 3, 2, 4)) == [x[c * 8 + p] for p in range(8) for c in range(3)]
    assert value(S.swap_channels(flat)) == [x[3 * p + 2 - c] for p in range(8) for c in range(3)]
