"""Packing, reading back, sources, sinks, streaming and the command line."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom import benchmark, cli
from cliploom.functions.pixels import area_resize, bgr_to_rgb
from cliploom.functions.position import with_ordered_position
from cliploom.plans import pack as P
from cliploom.sources import decoders, index_file, mp4, video
from cliploom.streaming import ingest


def solid(i: int) -> bytes:
    frame = np.zeros((2, 2, 3), np.uint8)
    frame[:, :, i % 3] = 200
    return frame.tobytes()


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(f"episode_{e}", c, i, bytes([e, i]) + solid(i)) for e in range(3) for c in ("left", "right") for i in range(60)]
    return spark.createDataFrame(rows, ingest.FRAMES)


@pytest.fixture(scope="module")
def packed(frames, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("packed"))
    result = P.pack_shards(frames, P.PackConfig(out, clip_length=8, clips_per_shard=5, metadata={"by": "test"}))
    assert (result.num_shards, result.total_clips, result.total_frames) == (10, 21, 336) and "21 clips" in result.summary()
    return out


def test_read_back(spark, packed):
    left, right = (P.Shards(spark, packed, c) for c in ("left", "right"))
    assert len(left) == 21
    for k in (0, 11, 20):
        row = left.metadata(k).first()
        data = [bytes(r["data"]) for r in left.clip(k).collect()]
        assert [d[1] for d in data] == list(range(row["frame_start"], row["frame_end"]))
        assert [bytes(r["data"]) for r in right.clip(k).collect()] == data  # cameras in step
    with pytest.raises(IndexError):
        left.clip(21)
    with pytest.raises(ValueError, match="left"):
        P.Shards(spark, packed, "top")


def test_epochs(spark, packed):
    s = P.Shards(spark, packed, "left")
    read = lambda e, w=0, n=1: [tuple(bytes(x)[:2] for x in r["clip"]) for r in s.epoch(e, worker=w, workers=n).orderBy("position", "clip_index").collect()]
    assert read(0) != read(1) and sorted(read(0)) == sorted(read(1)) and len(read(0)) == 21
    assert sorted(read(0, 0, 2) + read(0, 1, 2)) == sorted(read(0))
    assert s.epoch(transform=lambda c: F.size(c)).first()["clip"] == 8


def test_manifest_verify_info_cli(spark, packed, tmp_path, capsys):
    m = P.load_manifest(spark, packed)
    assert m["version"] == 2 and m["pack_config"]["clip_length"] == 8 and m["user_metadata"] == {"by": "test"} and m["pack_config"]["crf"] == 18
    assert {r["status"] for r in P.verify(spark, packed).collect()} == {"ok"}
    assert P.info(spark, packed)["episodes"] == 3
    assert cli.main(["verify", packed]) == 0 and cli.main(["info", packed]) == 0
    import shutil

    broken = tmp_path / "broken"
    shutil.copytree(packed, broken)
    shutil.rmtree(broken / "pack=0" / "frames" / "shard_id=2")
    assert cli.main(["verify", str(broken)]) == 1 and "missing" in capsys.readouterr().out
    with pytest.raises(FileNotFoundError):
        P.load_manifest(spark, str(tmp_path / "none"))
    (tmp_path / "old" / "pack=0" / "manifest").mkdir(parents=True)
    (tmp_path / "old" / "pack=0" / "manifest" / "x.json").write_text('{"version": 1}')
    (tmp_path / "old" / "pack=0" / "manifest" / "_SUCCESS").touch()
    with pytest.raises(ValueError):
        P.load_manifest(spark, str(tmp_path / "old"))


def test_verify_counts_frames(spark, packed, tmp_path):
    import shutil

    broken = tmp_path / "broken"
    shutil.copytree(packed, broken)
    one = broken / "pack=0" / "frames" / "shard_id=1"
    few = spark.read.parquet(str(one)).filter("shard_frame_idx % 8 = 0")  # a frame of every clip
    few.write.parquet(str(tmp_path / "few"))
    shutil.rmtree(one)
    shutil.copytree(tmp_path / "few", one)
    bad = [(r["file"], r["status"]) for r in P.verify(spark, str(broken)).collect() if r["status"] != "ok"]
    assert sorted(bad) == [("shard_0001_left.mp4", "wrong_count"), ("shard_0001_right.mp4", "wrong_count")]


def test_a_pack_that_breaks_off_is_not_seen(spark, frames, tmp_path, monkeypatch):
    out, small = str(tmp_path / "out"), frames.filter("episode = 'episode_0'")
    P.pack_shards(small, P.PackConfig(out, clip_length=8, seed=1))
    before = P.load_manifest(spark, out)
    monkeypatch.setattr(P, "_manifest", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        P.pack_shards(frames, P.PackConfig(out, clip_length=8, seed=2))
    assert P.load_manifest(spark, out) == before and len(P.Shards(spark, out, "left")) == 7
    monkeypatch.undo()
    for seed in (3, 4):
        P.pack_shards(frames, P.PackConfig(out, clip_length=8, seed=seed))
    assert P.load_manifest(spark, out)["pack_config"]["seed"] == 4 and len(P.Shards(spark, out, "left")) == 21
    assert P.complete_packs(spark, out) == [2, 3]  # the newest and the one before it


@pytest.fixture(scope="module")
def shared_folders(frames, tmp_path_factory):
    """A pack of 21 shards a camera, of which 6 share a folder, and the same with a folder for each."""
    many, few = (str(tmp_path_factory.mktemp(n)) for n in ("many", "few"))
    P.pack_shards(frames, P.PackConfig(many, clip_length=8, clips_per_shard=1))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(P, "MAX_FOLDERS", 4, raising=False)
        P.pack_shards(frames, P.PackConfig(few, clip_length=8, clips_per_shard=1, num_workers=2))
    return many, few


def test_many_shards_share_folders(spark, shared_folders, tmp_path):
    import shutil
    from pathlib import Path

    many, few = shared_folders
    count = lambda folder: len(list((Path(folder) / "pack=0" / "frames").glob("*=*")))
    assert count(many) == 21 and count(few) == 4
    read = lambda folder, camera, **k: sorted((r["position"], r["clip_index"], *map(bytes, r["clip"])) for r in P.Shards(spark, folder, camera).epoch(3, **k).collect())
    for camera in ("left", "right"):
        assert len(read(few, camera)) == 21 and read(few, camera) == read(many, camera)
        for w in range(5):
            assert read(few, camera, worker=w, workers=5) == read(many, camera, worker=w, workers=5)
    assert P.load_manifest(spark, few)["stats"] == P.load_manifest(spark, many)["stats"]
    assert [r["status"] for r in P.verify(spark, few).collect()] == ["ok"] * 42
    broken = tmp_path / "broken"
    shutil.copytree(few, broken)
    shutil.rmtree(broken / "pack=0" / "frames" / "first_shard=6")
    missing = {r["file"] for r in P.verify(spark, str(broken)).collect() if r["status"] == "missing"}
    assert missing == {f"shard_{k:04d}_{c}.mp4" for k in range(6, 12) for c in ("left", "right")}


def test_a_clip_reads_one_of_the_shared_folders(spark, shared_folders, tmp_path):
    import shutil
    from pathlib import Path

    many, few = shared_folders
    of = lambda folder, k: [(r["shard_id"], r["clip_index"], r["shard_frame_idx"], bytes(r["data"])) for r in P.Shards(spark, folder, "right").clip(k).collect()]
    for k in (0, 5, 6, 20):
        assert len(of(few, k)) == 8 and of(few, k) == of(many, k)
    torn = tmp_path / "torn"
    shutil.copytree(few, torn)
    s = P.Shards(spark, str(torn), "right")
    assert sorted(s.clip(7).columns) == sorted(P.Shards(spark, many, "right").clip(7).columns)
    for f in (torn / "pack=0" / "frames").glob("first_shard=*/*.parquet"):  # a scan that opens another folder fails
        if f.parent.name != "first_shard=6":
            f.write_bytes(b"no Parquet")
    assert [r["shard_frame_idx"] for r in s.clip(7).collect()] == list(range(8))


def test_config():
    with pytest.raises(ValueError):
        P.PackConfig("x", codec="vp9")
    with pytest.raises(ValueError):
        P.PackConfig("x", clip_stride=-1)


def test_one_camera_without_a_name_and_no_shuffle(spark, frames, tmp_path):
    one = frames.filter("camera = 'left'").withColumn("camera", F.lit(None).cast("string"))
    assert P.pack_shards(one, P.PackConfig(str(tmp_path), clip_length=8, clips_per_shard=5, shuffle=False)).total_clips == 21
    s = P.Shards(spark, str(tmp_path))
    first = [bytes(r["data"])[:2] for r in s.clip(0).collect()]
    assert first == [bytes([0, i]) for i in range(8)]


def test_incremental(spark, frames, tmp_path):
    source, config = str(tmp_path / "in"), P.PackConfig(str(tmp_path / "out"), clip_length=8, clips_per_shard=5)
    for k in range(2):
        frames.filter(f"episode = 'episode_{k}'").write.mode("append").parquet(source)
        ingest.pack_arrivals(spark, source, config, str(tmp_path / "check"))
    ingest.pack_arrivals(spark, source, config, str(tmp_path / "check"))  # nothing new
    clips = ingest.merged(spark, config.output_dir)
    assert {(r["version"], r["episode"]) for r in clips.select("version", "episode").distinct().collect()} == {(0, "episode_0"), (1, "episode_1")}


def test_video_source_and_sink(spark, tmp_path):
    data = np.stack([np.frombuffer(solid(i), np.uint8).reshape(2, 2, 3) for i in range(20)])
    np.save(tmp_path / "a.npy", data)
    (tmp_path / "bad.npy").write_bytes(b"no")
    video.register(spark)
    (tmp_path / "a,b.txt").write_bytes(b"not a video")
    meta = {r["path"][-5:]: r for r in spark.read.format("video_meta").option("pattern", "*.npy").load(str(tmp_path)).collect()}
    assert len(meta) == 2
    assert meta["a.npy"]["num_frames"] == 20 and meta["a.npy"]["error"] is None and meta["d.npy"]["error"]
    got = spark.read.format("video").option("pattern", "*.npy").load(str(tmp_path)).filter("frame_idx >= 4 and frame_idx < 7").orderBy("frame_idx").collect()
    assert [bytes(r["data"]) for r in got] == [solid(4), solid(5), solid(6)]
    video.write_videos(spark.read.format("video").load(f"{tmp_path}/a.npy"), str(tmp_path / "out"))
    at = tmp_path / "out" / video.stored_name(f"{tmp_path}/a.npy")
    assert (np.load(at) == data).all() and [f.name for f in (tmp_path / "out").iterdir()] == [at.name]
    # Paths of one name in two folders are two files; a job that fails leaves what was there.
    one = spark.read.format("video").load(f"{tmp_path}/a.npy")
    loaded = lambda n, path: spark.read.format("video").load(f"{tmp_path}/a.npy").filter(f"frame_idx < {n}").withColumn("path", F.lit(path))
    two = loaded(2, "/x/a.npy").unionByName(loaded(3, "/y/a.npy"))
    video.write_videos(two, str(tmp_path / "out"))
    assert [len(np.load(tmp_path / "out" / video.stored_name(p))) for p in ("/x/a.npy", "/y/a.npy")] == [2, 3]
    with pytest.raises(Exception, match="shape"):
        video.write_videos(one.withColumn("height", F.when(F.col("frame_idx") == 19, 3).otherwise(F.col("height"))).unionByName(two), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 3 and (np.load(at) == data).all()
    assert video.as_array(one.filter("frame_idx in (3, 1)")).tolist() == data[[1, 3]].tolist()
    with pytest.raises(ValueError):
        decoders.opened("x", "nope")
    with pytest.raises(decoders.DecoderNotAvailable):
        decoders.opened("x.mp4", "auto")
    with decoders.opened(str(tmp_path / "a.npy")) as d:
        assert d.seek(99) == 19
        for bad in (lambda: d.read_frame(20), lambda: list(d.read_clip(5, 5)), lambda: list(d.read_clip(15, 25))):
            with pytest.raises(IndexError):
                bad()


def test_listing(spark, tmp_path):
    for cam in ("l", "r"):
        (tmp_path / cam).mkdir()
        for e in (1, 0):
            (tmp_path / cam / f"e{e}.mp4").write_bytes(b"x" * (e + 1))
    rows = video.camera_listing(spark, str(tmp_path), ["l", "r"]).orderBy("camera", "episode_ord").collect()
    assert [(r["camera"], r["episode_ord"], r["size"]) for r in rows] == [("l", 0, 1), ("l", 1, 2), ("r", 0, 1), ("r", 1, 2)]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        video.listing(spark, str(tmp_path / "none"))


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_mp4_index():
    full = b"\0\0\0\0"
    table = lambda *v: struct.pack(f">{len(v)}I", *v)
    entry = box(b"avc1", b"\0" * 24 + struct.pack(">HH", 320, 240) + b"\0" * 50)
    stbl = box(b"stsd", full + table(1) + entry) + box(b"stts", full + table(2, 3, 512, 1, 1024)) + box(b"ctts", full + table(2, 1, 512, 3, 0))
    stbl += box(b"stss", full + table(2, 1, 3)) + box(b"stsz", full + table(0, 4, 9, 8, 7, 6))
    mdia = box(b"mdhd", full + table(0, 0, 15360, 2560) + b"\0" * 4) + box(b"hdlr", full + table(0) + b"vide" + b"\0" * 13) + box(b"minf", box(b"stbl", stbl))
    track = mp4.parse(box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", mdia))) + box(b"mdat", b"x"))
    assert (track.codec, track.width, track.height, track.num_frames) == ("avc1", 320, 240, 4)
    assert track.pts.tolist() == [512, 512, 1024, 1536] and track.is_keyframe.tolist() == [True, False, True, False] and track.sizes.tolist() == [9, 8, 7, 6]
    assert track.duration_sec == pytest.approx(1 / 6) and track.fps == pytest.approx(24)
    with pytest.raises(ValueError):
        mp4.parse(box(b"ftyp", b"isom"))


def test_index_file():
    arrays = np.array([0, 5, 9]), np.array([True, False, True]), np.array([0, 0, 9])
    data = index_file.dumps(*arrays)
    assert len(data) == 5 + 3 * 17 and all((a == b).all() for a, b in zip(index_file.loads(data), arrays, strict=True))
    assert index_file.loads(b"\x02" + data[1:]) is None and index_file.loads(data[:-1]) is None and index_file.loads(b"") is None


def test_pixels(spark):
    frame = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    df = spark.createDataFrame([(frame.tobytes(), 4, 4, 3), (None, 4, 4, 3)], "data binary, h int, w int, c int")
    args = [F.col(c) for c in ("data", "h", "w", "c")]
    row = df.select(bgr_to_rgb(*args).alias("x"), area_resize(2, 2)(*args).alias("y")).collect()
    assert bytes(row[0]["x"]) == frame[:, :, ::-1].tobytes() and row[1]["x"] is None
    want = np.rint(frame.reshape(2, 2, 2, 2, 3).mean((1, 3))).astype(np.uint8)
    assert bytes(row[0]["y"]) == want.tobytes()


def test_benchmark(spark, tmp_path):
    r = benchmark.run_benchmark(spark, lambda k: spark.range(10).count(), benchmark.BenchmarkConfig("range", 3))
    assert r.p50 <= r.p95 <= r.p99 and r.throughput > 0
    assert benchmark.BenchmarkResult.from_json(r.to_json()) == benchmark.BenchmarkResult.from_json(json.loads(r.to_json()))
    (tmp_path / "r.json").write_text(r.to_json())
    assert benchmark.load(spark, str(tmp_path / "r.json")).first()["name"] == "range"
    benchmark.report([r], str(tmp_path / "r.html"))
    assert "range" in (tmp_path / "r.html").read_text()


def test_videos_to_shards(spark, tmp_path):
    for c in ("left", "right"):
        (tmp_path / "in" / c).mkdir(parents=True)
        for e in range(2):
            np.save(tmp_path / "in" / c / f"episode_{e}.npy", np.full((20, 4, 6, 3), 10 * e, np.uint8))
    out = str(tmp_path / "out")
    assert cli.main(["pack", str(tmp_path / "in"), out, "--videos", "*.npy", "--cameras", "left,right", "--clip-length", "8", "--resolution", "3x2"]) == 0
    m = P.load_manifest(spark, out)
    assert m["stats"]["total_clips"] == 4 and m["stats"]["total_frames"] == 64 and len(m["pack_config"]["source_hash"]) == 16 and m["pack_config"]["resolution"] == [3, 2]
    rows = P.Shards(spark, out, "right").clip(0).collect()
    assert len(rows) == 8 and {(r["height"], r["width"], len(r["data"])) for r in rows} == {(2, 3, 18)}
    one = str(tmp_path / "one")
    assert cli.main(["pack", str(tmp_path / "in" / "left"), one, "--videos", "*.npy", "--clip-length", "8"]) == 0
    assert len(P.Shards(spark, one)) == 4
    plain = spark.createDataFrame([("a", None, 0, b"")], ingest.FRAMES)
    with pytest.raises(ValueError, match="height"):
        P.pack_shards(plain, P.PackConfig(out, resolution=(3, 2)))


def test_fingerprint(frames):
    h = P.fingerprint(frames)
    again = frames.withColumn("data", F.when((F.col("episode") == "episode_1") & (F.col("frame_idx") == 3), F.lit(b"recorded anew")).otherwise(F.col("data")))
    assert h != P.fingerprint(again)
    assert h == P.fingerprint(frames.orderBy(F.desc("frame_idx")).repartition(5)) and h != P.fingerprint(frames.filter("not (episode = 'episode_1' and frame_idx = 3)"))


def test_ordered_position(spark):
    rows = [(f"episode_{k:04d}" if k else None, s) for k in range(600) for s in (0, 8)]
    df = with_ordered_position(spark.createDataFrame(rows, "episode string, start long").repartition(7), "episode", "start")
    assert [tuple(r) for r in df.orderBy("position").select("episode", "start", "position").collect()] == [(*r, k) for k, r in enumerate(rows)]
    assert with_ordered_position(df.drop("position").limit(0), "episode", "start").count() == 0


def test_decode_benchmark(tmp_path, capsys):
    video, results = str(tmp_path / "v.npy"), tmp_path / "results"
    np.save(video, np.zeros((40, 4, 4, 3), np.uint8))
    for mode in benchmark.SEEK_MODES:
        assert cli.main(["bench", video, "--num-trials", "6", "--seek-mode", mode, "--output", str(results / f"{mode}.json")]) == 0
    r = benchmark.BenchmarkResult.from_json((results / "random.json").read_text())
    assert r.num_trials == 6 and r.clip_length == 16 and r.throughput > 0 and r.p50 <= r.p99 and r.seek_mode == "random"
    assert cli.main(["report", str(results), str(tmp_path / "r.html")]) == 0 and (tmp_path / "r.html").exists()
    assert cli.main(["report", str(tmp_path / "none"), str(tmp_path / "r.html")]) == 1
    assert [x.name for x in benchmark.run_all(video, str(tmp_path / "all"), ("npy", "decord"), num_trials=2)] == ["npy"]
    with pytest.raises(ValueError):
        benchmark.DecodeConfig(video, seek_mode="backwards")


def test_files_hash(spark, tmp_path):
    for c in ("l", "r"):
        (tmp_path / c).mkdir()
        (tmp_path / c / "e,0.npy").write_bytes(b"1")
    of = lambda cameras=("l", "r"): video.files_hash(spark, str(tmp_path), list(cameras), "*.npy")
    first = of()
    assert first == of(("r", "l")) and len({first, of("l"), video.files_hash(spark, str(tmp_path / "l"), None, "*.npy")}) == 3
    (tmp_path / "r" / "e,0.npy").write_bytes(b"22")
    assert of() != first


class FakeTensor:
    def __init__(self, x):
        self.x = x

    def permute(self, *axes):
        return FakeTensor(self.x.transpose(axes))

    def cpu(self):
        return self

    def numpy(self):
        return self.x


@pytest.fixture
def libraries(monkeypatch):
    """Stand-ins with the interfaces of the four decoder libraries, for a video of 12 frames."""
    import sys
    from fractions import Fraction
    from types import ModuleType, SimpleNamespace

    data, told = np.random.default_rng(0).integers(0, 256, (12, 4, 6, 3), np.uint8), []

    class Capture:
        def __init__(self, path):
            self.at = 0

        def get(self, key):
            return {0: 25.0, 1: 12.0, 2: 6.0, 3: 4.0, 4: float(int.from_bytes(b"avc1", "little"))}[key]

        def set(self, key, value):
            self.at = int(value)

        def read(self):
            return True, data[self.at][:, :, ::-1]

        def release(self):
            told.append("released")

    class Decord:
        def __init__(self, path, ctx):
            told.append(ctx)

        def __len__(self):
            return 12

        def get_avg_fps(self):
            return 25.0

        def __getitem__(self, i):
            return SimpleNamespace(shape=data[i].shape, asnumpy=lambda: data[i])

    class Codec:
        def __init__(self, path, device):
            told.append(device)
            self.metadata = SimpleNamespace(num_frames=12, average_fps=25.0, width=6, height=4, codec="avc1")

        def __getitem__(self, i):
            return FakeTensor(data[i].transpose(2, 0, 1))

    class Box:
        base = Fraction(1, 12800)

        def __init__(self):
            self.stream = SimpleNamespace(average_rate=Fraction(25), frames=0, duration=12 * 512, time_base=self.base, width=6, height=4, codec_context=SimpleNamespace(name="avc1"))
            self.streams, self.at = SimpleNamespace(video=[self.stream]), 0

        def seek(self, pts, stream):
            self.at = pts // 512 // 5 * 5  # a keyframe at or before it

        def decode(self, stream):
            for i in range(self.at, 12):
                yield SimpleNamespace(pts=i * 512, to_ndarray=lambda format, i=i: data[i])

        def close(self):
            told.append("closed")

    made = {
        "cv2": {"VideoCapture": Capture} | {f"CAP_PROP_{k}": i for i, k in enumerate(("FPS", "FRAME_COUNT", "FRAME_WIDTH", "FRAME_HEIGHT", "FOURCC", "POS_FRAMES"))},
        "decord": {"VideoReader": Decord, "cpu": lambda k: ("cpu", k), "gpu": lambda k: ("gpu", k)},
        "torchcodec": {}, "torchcodec.decoders": {"VideoDecoder": Codec},
        "av": {"open": lambda path: Box()},
    }
    for name, content in made.items():
        module = ModuleType(name)
        module.__dict__.update(content)
        monkeypatch.setitem(sys.modules, name, module)
    return data, told


@pytest.mark.parametrize("name", decoders.AUTO)
def test_adapters_keep_the_contract(libraries, name):
    data, told = libraries
    with decoders.opened("x.mp4", name, "cuda:1") as d:
        assert (d.num_frames, d.width, d.height, float(d.fps)) == (12, 6, 4, 25.0) and d.codec == ("unknown" if name == "decord" else "avc1")
        for i in (0, 7, 11, 3):
            assert (d.read_frame(i) == data[i]).all()
        assert (np.stack(list(d.read_clip(2, 9))) == data[2:9]).all() and d.seek(0.3) == 7 and d.seek(9) == 11 and d.seek(-1) == 0
        for bad in (lambda: d.read_frame(12), lambda: d.read_frame(-1), lambda: list(d.read_clip(3, 3)), lambda: list(d.read_clip(5, 13))):
            with pytest.raises(IndexError):
                bad()
    assert told == {"opencv": ["released"], "decord": [("gpu", 1)], "torchcodec": ["cuda:1"], "pyav": ["closed"]}[name]


def test_auto_takes_the_first_that_is_installed(libraries, monkeypatch):
    import sys

    assert isinstance(decoders.opened("x.mp4"), decoders.TorchCodec)
    for missing, then in (("torchcodec.decoders", decoders.Decord), ("decord", decoders.PyAv), ("av", decoders.OpenCv)):
        monkeypatch.setitem(sys.modules, missing, None)
        assert isinstance(decoders.opened("x.mp4"), then)


def test_a_decoder_of_ones_own(monkeypatch):
    class Grey(decoders.Npy):
        def open(self, path):
            self.data = np.full((3, 2, 2, 3), 7, np.uint8)
            self.num_frames, self.height, self.width = 3, 2, 2

    monkeypatch.setattr(decoders, "DECODERS", dict(decoders.DECODERS))
    decoders.register("grey", Grey)
    assert decoders.check_name("grey") == "grey" and (decoders.opened("any", "grey").read_frame(2) == 7).all()


def test_command_line_with_named_folders(tmp_path):
    (tmp_path / "in").mkdir()
    np.save(tmp_path / "in" / "e.npy", np.zeros((20, 2, 2, 3), np.uint8))
    assert cli.main(["pack", "--episodes", str(tmp_path / "in"), "--videos", "*.npy", "--output", str(tmp_path / "out"), "--clips-per-episode", "1"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["pack", "--episodes", str(tmp_path / "in")])
