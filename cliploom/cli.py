"""Command line: pack, verify and info of packed folders; timing of decoders."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import benchmark as B
from .plans import pack as P
from .session import session
from .sources.video import episode_frames, files_hash


def _bench(given: dict) -> int:
    output = given.pop("output")
    if given["backend"] == "all":
        del given["backend"]
        return int(not B.run_all(given.pop("video_path"), output or "benchmarks", **given))
    text = B.run_decode(B.DecodeConfig(**given)).to_json()
    print(text)
    if output:
        Path(output).parent.mkdir(parents=True, exist_ok=True)
        Path(output).write_text(text)
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cliploom")
    commands = parser.add_subparsers(dest="command", required=True)
    pack = commands.add_parser("pack", help="pack frames (Parquet: episode, camera, frame_idx, data)")
    pack.add_argument("frames", nargs="?", help="a Parquet folder, or with --videos a folder of videos (of a subfolder for each camera)")
    pack.add_argument("output_dir", nargs="?")
    pack.add_argument("--videos", metavar="PATTERN", help="for instance *.mp4")
    pack.add_argument("--episodes", metavar="FOLDER", help="the same as the first argument with --videos *.mp4")
    pack.add_argument("--output", metavar="FOLDER", help="the same as the second argument")
    pack.add_argument("--backend", default="auto")
    pack.add_argument("--crf", type=int, default=18)
    pack.add_argument("--num-workers", type=int)
    pack.add_argument("--clip-length", type=int, default=16)
    pack.add_argument("--clip-stride", type=int)
    pack.add_argument("--clips-per-shard", type=int, default=1000)
    pack.add_argument("--clips-per-episode", type=int)
    pack.add_argument("--codec", choices=P.CODECS, default="h264")
    pack.add_argument("--seed", type=int, default=42)
    pack.add_argument("--cameras", type=lambda s: tuple(c.strip() for c in s.split(",")))
    pack.add_argument("--resolution", type=lambda s: tuple(map(int, s.split("x"))))
    for name in ("verify", "info"):
        commands.add_parser(name).add_argument("folder")
    bench = commands.add_parser("bench", help="time clips of a video, by one decoder or by all")
    bench.add_argument("video_path")
    bench.add_argument("--backend", default="auto", help="a decoder, auto, or all")
    bench.add_argument("--num-trials", type=int, default=100)
    bench.add_argument("--clip-length", type=int, default=16)
    bench.add_argument("--seek-mode", choices=B.SEEK_MODES, default="sequential")
    bench.add_argument("--output", help="a JSON file; with all, a folder")
    page = commands.add_parser("report", help="a page of the results (*.json) in a folder")
    page.add_argument("folder")
    page.add_argument("output")
    given = vars(parser.parse_args(args))
    command = given.pop("command")
    if command == "bench":
        return _bench(given)
    if command == "report":
        found = [B.BenchmarkResult.from_json(f.read_text()) for f in sorted(Path(given["folder"]).glob("*.json"))]
        if found:
            B.report(found, given["output"])
        else:
            print(f"no results in {given['folder']}")
        return int(not found)
    spark = session()
    if command == "pack":
        source, pattern, episodes, output = (given.pop(k) for k in ("frames", "videos", "episodes", "output"))
        if episodes:
            source, pattern = episodes, pattern or "*.mp4"
        given["output_dir"] = output or given["output_dir"]
        if not source or not given["output_dir"]:
            parser.error("pack needs episodes and an output folder")
        if pattern is None:
            frames = spark.read.parquet(source)
        else:
            frames = episode_frames(spark, source, given["cameras"], given["backend"], pattern)
            given["source_hash"] = files_hash(spark, source, given["cameras"], pattern)
        print(P.pack_shards(frames, P.PackConfig(**given)).summary())
        return 0
    if command == "info":
        print(json.dumps(P.info(spark, given["folder"]), indent=2))
        return 0
    bad = P.verify(spark, given["folder"]).filter("status <> 'ok'")
    n = bad.count()
    for row in bad.limit(100).collect():
        print(f"{row['file']}: {row['status']}")
    print("ok" if not n else f"{n} shards are not as the manifest says")
    return int(n > 0)


if __name__ == "__main__":
    sys.exit(main())
