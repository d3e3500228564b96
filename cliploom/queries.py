"""The catalogue of queries over the tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .functions.position import with_ordered_position
from .operators import clips as C
from .operators import index as I
from .operators import sampling as P
from .operators import select as L
from .plans import pack as K
from .plans import views as V
from .shared import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LENGTH, STRIDE, PER_SHARD, SEED, FPS = 16, 8, 10, 42, 30.0

EF = """ef AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, epoch_us(ts) AS pts, event_type, value FROM events),
f AS (SELECT video_id, frame_idx, pts, frame_idx = 0 OR event_type = 'error' AS is_keyframe, value FROM ef),
v AS (SELECT video_id, count(*) AS n FROM f GROUP BY video_id)"""
OF = """f AS (SELECT o_custkey AS video_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame_idx FROM orders),
v AS (SELECT video_id, count(*) AS n FROM f GROUP BY video_id)"""
CF = """c AS (SELECT user_id AS episode, event_type AS camera, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS frame_idx, value FROM events)"""
PLAN = f"""p AS (SELECT video_id, unnest(range(0, n - {LENGTH} + 1, {STRIDE})) AS frame_start FROM v WHERE n >= {LENGTH})"""
SHUF = f"""s AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || video_id || ':' || frame_start), video_id, frame_start) - 1 AS position FROM p),
h AS (SELECT *, position // {PER_SHARD} AS shard_id, position % {PER_SHARD} AS clip_index FROM s)"""


def query(sql: str = "") -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def draw_sql(text: str, n: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT % ({n})"


def event_videos(spark: SparkSession, d: str) -> DataFrame:
    return V.lengths(V.event_frames(spark, d))


def event_clips(spark: SparkSession, d: str) -> DataFrame:
    return C.shards(C.shuffle(C.plan(event_videos(spark, d), LENGTH, STRIDE), SEED), PER_SHARD)


def times(spark: SparkSession) -> DataFrame:
    return spark.range(6).select((F.col("id") * 0.55 - 0.2).alias("ts"))


TIMES = "t AS (SELECT i * 0.55::DOUBLE - 0.2::DOUBLE AS ts FROM range(6) r(i))"


def long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


@query(f"WITH {EF} SELECT video_id, n AS num_frames, 30.0::DOUBLE AS fps, n / 30.0::DOUBLE AS duration_sec, (SELECT count(*) FROM f k WHERE k.video_id = v.video_id AND is_keyframe) AS num_keyframes FROM v")
def video_metadata(spark, d):
    g = I.gop_stats(V.event_frames(spark, d))
    return g.select("video_id", "num_frames", F.lit(FPS).alias("fps"), S.duration(F.col("num_frames"), F.lit(FPS)).alias("duration_sec"), "num_keyframes")


@query(f"WITH {EF} SELECT video_id, frame_idx, pts, is_keyframe, coalesce(last_value(CASE WHEN is_keyframe THEN pts END IGNORE NULLS) OVER w, first_value(pts) OVER w) AS keyframe_pts FROM f WINDOW w AS (PARTITION BY video_id ORDER BY pts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def frame_index(spark, d):
    return I.build(V.event_frames(spark, d))


@query(f"WITH {EF} SELECT video_id, count(*) AS num_frames, count(*) FILTER (WHERE is_keyframe) AS num_keyframes, count(*) / (count(*) FILTER (WHERE is_keyframe))::DOUBLE AS avg_gop_size FROM f GROUP BY video_id")
def gop_stats(spark, d):
    return I.gop_stats(V.event_frames(spark, d))


@query(f"WITH {EF} SELECT video_id, frame_idx, frame_idx - coalesce(max(CASE WHEN is_keyframe THEN frame_idx END) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) + 1 AS to_decode FROM f")
def frames_to_decode(spark, d):
    return I.frames_to_decode(V.event_frames(spark, d))


@query(f"WITH {EF} SELECT video_id, frame_idx, pts, value FROM f WHERE frame_idx = 7")
def frame_at(spark, d):
    return L.frame_at(V.event_frames(spark, d), 7).select("video_id", "frame_idx", "pts", "value")


@query(f"WITH {EF} SELECT f.video_id, frame_idx, pts, value FROM f JOIN v USING (video_id) WHERE frame_idx = n - 3")
def frame_at_negative(spark, d):
    return L.frame_at(V.event_frames(spark, d), -3, strict=True).select("video_id", "frame_idx", "pts", "value")


@query(f"WITH {EF} SELECT video_id, frame_idx, value FROM f WHERE frame_idx >= 10 AND frame_idx < 20")
def frame_slice(spark, d):
    return L.frame_slice(V.event_frames(spark, d), 10, 20).select("video_id", "frame_idx", "value")


@query(f"WITH {EF} SELECT f.video_id, frame_idx, value FROM f JOIN v USING (video_id) WHERE frame_idx >= greatest(n - 40, 0) AND frame_idx < n AND (frame_idx - greatest(n - 40, 0)) % 3 = 0")
def frame_slice_step(spark, d):
    return L.frame_slice(V.event_frames(spark, d), -40, None, 3).select("video_id", "frame_idx", "value")


@query(f"WITH {EF} SELECT video_id, pos, frame_idx, value FROM f JOIN (SELECT unnest([5, 2, 2, 40]) AS frame_idx, unnest([0, 1, 2, 3]) AS pos) i USING (frame_idx)")
def frame_fancy(spark, d):
    return L.frame_fancy(V.event_frames(spark, d), [5, 2, 2, 40]).select("video_id", "pos", "frame_idx", "value")


@query(f"WITH {EF} SELECT video_id, frame_idx, value FROM f WHERE frame_idx >= 4 AND frame_idx < 12")
def clip_range(spark, d):
    return L.clip_range(V.event_frames(spark, d), 4, 12, strict=True).select("video_id", "frame_idx", "value")


SEEK = "greatest(0, least(trunc(ts * 30.0)::BIGINT, n - 1))"


@query(f"WITH {EF}, {TIMES} SELECT f.video_id, round(ts, 6) AS ts, frame_idx, value FROM f JOIN v USING (video_id), t WHERE frame_idx = {SEEK}")
def seek_timestamps(spark, d):
    return L.at_times(V.event_frames(spark, d), times(spark), FPS).select("video_id", F.round("ts", 6).alias("ts"), "frame_idx", "value")


def uniform_sql(n: int, total: str, offset: str = "0") -> str:
    return f"unnest(CASE WHEN {total} <= {n} THEN list_transform(range(0, {total}), lambda i: {offset} + i) ELSE list_transform(range({n}), lambda i: {offset} + round_even(i * (({total} - 1) / {n - 1}::DOUBLE), 0)::BIGINT) END) AS frame_idx"


@query(f"WITH {EF} SELECT video_id, {uniform_sql(8, 'n')} FROM v")
def sample_uniform(spark, d):
    return P.uniform(event_videos(spark, d), 8).select("video_id", "frame_idx")


@query(f"WITH {EF} SELECT video_id, frame_idx FROM f WHERE frame_idx % 5 = 0")
def sample_dense(spark, d):
    return P.dense(event_videos(spark, d), 5).select("video_id", "frame_idx")


@query(f"WITH {EF}, w AS (SELECT video_id, n, least(15, n) AS w, {draw_sql("'7:' || video_id", 'greatest(0, n - least(15, n)) + 1')} AS a FROM v) SELECT video_id, frame_idx FROM (SELECT f.video_id, frame_idx, row_number() OVER (PARTITION BY f.video_id ORDER BY md5('7:' || f.video_id || ':' || frame_idx), frame_idx) AS k FROM f JOIN w USING (video_id) WHERE frame_idx >= a AND frame_idx < a + w) WHERE k <= 4")
def sample_random_window(spark, d):
    return P.random_window(event_videos(spark, d), 4, 0.5, FPS, 7).select("video_id", "frame_idx")


@query(f"WITH {EF}, b AS (SELECT video_id, n, unnest([0, 20, 45]) AS a FROM v), e AS (SELECT *, row_number() OVER w - 1 AS ep, lead(a, 1, n) OVER w AS z, count(*) OVER (PARTITION BY video_id) AS m FROM b WHERE a < n WINDOW w AS (PARTITION BY video_id ORDER BY a)) SELECT video_id, {uniform_sql(8, '(z - a)', 'a')} FROM e WHERE ep = {draw_sql("'3:' || video_id", 'm')}")
def sample_episode(spark, d):
    return P.episode(event_videos(spark, d), [0, 20, 45], 8, 3).select("video_id", "frame_idx")


@query(f"WITH {EF} SELECT video_id, unnest(range(0, n - 15, 16)) AS frame_start, frame_start + 16 AS frame_end FROM v WHERE n >= 16")
def clip_plan(spark, d):
    return C.plan(event_videos(spark, d), LENGTH)


@query(f"WITH {OF} SELECT video_id, unnest(range(0, n - 3, 2)) AS frame_start, frame_start + 4 AS frame_end FROM v WHERE n >= 4")
def clip_plan_overlap(spark, d):
    return C.plan(V.lengths(V.order_frames(spark, d)), 4, 2)


@query(f"WITH {EF}, {PLAN} SELECT video_id, frame_start, frame_start + {LENGTH} AS frame_end FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY md5('{SEED}:' || video_id || ':' || frame_start), frame_start) AS k FROM p) WHERE k <= 2")
def clip_plan_capped(spark, d):
    return C.plan(event_videos(spark, d), LENGTH, STRIDE, 2, SEED)


@query(f"WITH {EF}, {PLAN}, {SHUF} SELECT video_id, frame_start, position FROM s")
def clip_shuffle(spark, d):
    return event_clips(spark, d).select("video_id", "frame_start", "position")


@query(f"WITH {EF}, {PLAN}, {SHUF} SELECT video_id, frame_start, shard_id, clip_index, printf('shard_%04d.mp4', shard_id) AS file FROM h")
def shard_assign(spark, d):
    return event_clips(spark, d).select("video_id", "frame_start", "shard_id", "clip_index", S.shard_file(F.col("shard_id")).alias("file"))


STATS = f"g AS (SELECT shard_id, count(*) AS num_clips, count(*) * {LENGTH} AS num_frames, count(*) * {LENGTH} * 8 AS size_bytes, printf('shard_%04d.mp4', shard_id) AS file FROM h GROUP BY shard_id)"


@query(f"WITH {EF}, {PLAN}, {SHUF}, {STATS} SELECT shard_id, num_clips, num_frames, size_bytes, file FROM g")
def shard_stats(spark, d):
    return C.shard_stats(event_clips(spark, d), LENGTH, 8)


@query(f"WITH {EF}, {PLAN}, {SHUF}, {STATS} SELECT 2 * count(*) AS num_shards, sum(num_clips)::BIGINT AS total_clips, (2 * sum(num_frames))::BIGINT AS total_frames, (2 * sum(size_bytes))::BIGINT AS total_size_bytes FROM g")
def pack_totals(spark, d):
    both = C.shard_stats(event_clips(spark, d), LENGTH, 8).withColumn("camera", F.explode(F.array(F.lit("left"), F.lit("right"))))
    return C.totals(both)


@query(f"WITH {EF}, {PLAN}, {SHUF} SELECT shard_id, clip_index * {LENGTH} + f.frame_idx - frame_start AS shard_frame_idx, h.video_id, f.frame_idx, value FROM h JOIN f ON f.video_id = h.video_id AND f.frame_idx >= frame_start AND f.frame_idx < frame_start + {LENGTH}")
def clip_frames(spark, d):
    out = C.frames_of(event_clips(spark, d), V.event_frames(spark, d))
    return out.select("shard_id", (F.col("clip_index") * LENGTH + F.col("frame_idx") - F.col("frame_start")).alias("shard_frame_idx"), "video_id", "frame_idx", "value")


@query(f"WITH {EF}, {PLAN}, {SHUF} SELECT shard_id, count(*) AS num_frames, count(DISTINCT h.video_id) AS videos, round(sum(value), 4) AS total, count(*) FILTER (WHERE is_keyframe) AS keyframes FROM h JOIN f ON f.video_id = h.video_id AND f.frame_idx >= frame_start AND f.frame_idx < frame_start + {LENGTH} GROUP BY shard_id")
def clip_aggregate(spark, d):
    g = C.frames_of(event_clips(spark, d), V.event_frames(spark, d)).groupBy("shard_id")
    return g.agg(F.count(F.lit(1)).alias("num_frames"), F.countDistinct("video_id").alias("videos"), F.round(F.sum("value"), 4).alias("total"), F.count_if("is_keyframe").alias("keyframes"))


@query(f"WITH {CF}, m AS (SELECT episode, camera, count(*) AS n FROM c GROUP BY episode, camera), {TIMES} SELECT c.episode, c.camera, round(ts, 6) AS ts, frame_idx, value FROM c JOIN m USING (episode, camera), t WHERE frame_idx = {SEEK}")
def multicam_sync(spark, d):
    return C.sync(V.event_cams(spark, d), times(spark), FPS).select("episode", "camera", F.round("ts", 6).alias("ts"), "frame_idx", "value")


CAM_PLAN = "m AS (SELECT episode, camera, count(*) AS n FROM c GROUP BY episode, camera), e AS (SELECT episode, min(n) AS n FROM m GROUP BY episode), p AS (SELECT episode AS video_id, unnest(range(0, n - 3, 2)) AS frame_start FROM e WHERE n >= 4)"


def camera_clips(spark, d):
    n = V.event_cams(spark, d).groupBy("episode", "camera").agg(F.count(F.lit(1)).alias("num_frames"))
    return C.plan_cameras(n, 4, 2)


@query(f"WITH {CF}, {CAM_PLAN} SELECT episode, camera, frame_start, frame_start + 4 AS frame_end FROM p JOIN m ON episode = video_id")
def multicam_plan(spark, d):
    return camera_clips(spark, d).select("episode", "camera", "frame_start", "frame_end")


@query(f"WITH {CF}, {CAM_PLAN}, {SHUF} SELECT shard_id, clip_index, (SELECT count(*) FROM m WHERE episode = video_id) AS cameras, true AS in_step FROM h")
def multicam_lockstep(spark, d):
    """Places come from the clips that cameras share, so all cameras have the same clip in a place."""
    each = camera_clips(spark, d)
    shared = each.select("episode", "frame_start").distinct()
    placed = C.shards(C.shuffle(shared, SEED, "episode"), PER_SHARD)
    return C.lockstep(each.join(placed, ["episode", "frame_start"]))


@query(f"WITH {CF} SELECT camera, count(*) AS frames, count(DISTINCT episode) AS episodes FROM c GROUP BY camera")
def camera_groups(spark, d):
    return V.event_cams(spark, d).groupBy("camera").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("episode").alias("episodes"))


@query("SELECT conv_id AS video_id, turn AS frame_idx, length(text)::DOUBLE AS value FROM conversations WHERE role = 'user'")
def camera_filter(spark, d):
    return L.of_camera(V.turn_frames(spark, d), "user").select("video_id", "frame_idx", "value")


@query(f"WITH {EF}, {PLAN}, {SHUF}, {STATS} SELECT h.shard_id, clip_index, video_id, frame_start, file, clip_index * {LENGTH} AS first_frame FROM h JOIN g USING (shard_id) WHERE position IN (0, 17, 101)")
def shard_clip_lookup(spark, d):
    clips = event_clips(spark, d)
    files = C.shard_stats(clips, LENGTH, 8).select("shard_id", "file")
    found = clips.filter(F.col("position").isin(0, 17, 101)).join(files, "shard_id")
    return found.select("shard_id", "clip_index", "video_id", "frame_start", "file", (F.col("clip_index") * LENGTH).alias("first_frame"))


EPOCH = f"o AS (SELECT shard_id, row_number() OVER (ORDER BY md5('{SEED + 3}:' || shard_id), shard_id) - 1 AS position FROM g)"


@query(f"WITH {EF}, {PLAN}, {SHUF}, {STATS}, {EPOCH} SELECT shard_id, position FROM o")
def shard_stream_epoch(spark, d):
    return C.epoch_order(C.shard_stats(event_clips(spark, d), LENGTH), SEED, 3).select("shard_id", "position")


@query(f"WITH {EF}, {PLAN}, {SHUF}, {STATS}, {EPOCH} SELECT shard_id, position FROM o WHERE position % 4 = 1")
def worker_round_robin(spark, d):
    return C.of_worker(C.epoch_order(C.shard_stats(event_clips(spark, d), LENGTH), SEED, 3), 1, 4).select("shard_id", "position")


@query(f"WITH {OF} SELECT video_id, 0::BIGINT AS worker, unnest(range(n // 3)) AS clip, clip * 3 AS frame_start FROM v")
def stream_clips(spark, d):
    return C.stream_clips(V.lengths(V.order_frames(spark, d)), 3).select("video_id", long("worker"), "clip", "frame_start")


@query(f"WITH {OF}, w AS (SELECT video_id, n, w, w * (n // 2) AS a, CASE WHEN w = 1 THEN n ELSE (w + 1) * (n // 2) END AS z FROM v, range(2) r(w)) SELECT video_id, w AS worker, unnest(range((z - a) // 3)) AS clip, a + clip * 3 AS frame_start FROM w")
def stream_clips_workers(spark, d):
    return C.stream_clips(V.lengths(V.order_frames(spark, d)), 3, 2).select("video_id", long("worker"), "clip", "frame_start")


@query(f"WITH {EF}, {PLAN}, {SHUF}, {STATS} SELECT file, CASE WHEN shard_id % 7 = 3 THEN 'missing' WHEN shard_id % 5 = 2 THEN 'wrong_count' ELSE 'ok' END AS status FROM g")
def verify_shards(spark, d):
    stats = C.shard_stats(event_clips(spark, d), LENGTH)
    found = stats.filter("shard_id % 7 <> 3").select("file", "num_clips", (F.col("num_frames") - F.when(F.col("shard_id") % 5 == 2, 1).otherwise(0)).alias("num_frames"))
    return C.verify(stats, found)


@query(f"WITH {EF}, {PLAN}, {SHUF} SELECT count(DISTINCT video_id) AS episodes, count(DISTINCT shard_id) AS shards, count(*) AS clips FROM h")
def pack_info(spark, d):
    return event_clips(spark, d).agg(F.countDistinct("video_id").alias("episodes"), F.countDistinct("shard_id").alias("shards"), F.count(F.lit(1)).alias("clips"))


@query(f"WITH {EF}, {PLAN}, k AS (SELECT video_id, count(*) AS n FROM p GROUP BY video_id) SELECT count(*) AS episodes, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM k")
def clips_per_episode(spark, d):
    return C.per_episode(C.plan(event_videos(spark, d), LENGTH, STRIDE)).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {EF}, {PLAN}, {SHUF}, {STATS} SELECT shard_id, '{{"shard_id":' || shard_id || ',"file":"' || file || '","num_clips":' || num_clips || ',"num_frames":' || num_frames || '}}' AS entry FROM g""")
def manifest_json(spark, d):
    return C.shard_stats(event_clips(spark, d), LENGTH).select("shard_id", F.to_json(F.struct("shard_id", "file", "num_clips", "num_frames")).alias("entry"))


@query("WITH x AS (SELECT source, string_agg(source || '/' || doc_id || '.mp4:' || n_chars, '' ORDER BY lang, source || '/' || doc_id || '.mp4', n_chars) AS t FROM documents GROUP BY source) SELECT source, substr(sha256(t), 1, 16) AS source_hash FROM x")
def source_hash(spark, d):
    return C.source_hash(V.doc_files(spark, d))


@query("SELECT source || '/' || doc_id || '.mp4' AS path, substr(sha256(source || '/' || doc_id || '.mp4|' || n_chars || '|1000'), 1, 16) AS cache_key FROM documents")
def cache_key(spark, d):
    return V.doc_files(spark, d).select("path", S.cache_key(F.col("path"), F.col("size"), F.lit(1000)).alias("cache_key"))


@query("""SELECT p_partkey, codec, CASE WHEN codec = 'mjpeg' THEN 'yuvj420p' ELSE 'yuv420p' END AS pix_fmt, CASE codec WHEN 'h264' THEN p_size WHEN 'mjpeg' THEN greatest(2, least(31, p_size)) END AS quality
FROM (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'mjpeg' ELSE 'ffv1' END AS codec FROM part)""")
def codec_settings(spark, d):
    codec = F.when(F.col("p_partkey") % 3 == 0, "h264").when(F.col("p_partkey") % 3 == 1, "mjpeg").otherwise("ffv1")
    df = V.table(spark, d, "part").select("p_partkey", codec.alias("codec"), S.codec_settings(codec, F.col("p_size")).alias("s"))
    return df.select("p_partkey", "codec", "s.pix_fmt", "s.quality")


@query("SELECT source || '/' || doc_id || '.mp4' AS path, doc_id::VARCHAR AS episode_id FROM documents")
def path_stem(spark, d):
    return V.doc_files(spark, d).select("path", S.stem(F.col("path")).alias("episode_id"))


@query("SELECT o_orderkey, chr(97 + (o_orderkey % 26)::INT) || chr(98) || chr(48 + (o_orderkey % 10)::INT) || chr(52) AS code FROM orders")
def fourcc(spark, d):
    k = F.col("o_orderkey")
    value = (97 + k % 26) + F.lit(98 << 8) + (48 + k % 10) * (1 << 16) + F.lit(52 << 24)
    return V.table(spark, d, "orders").select("o_orderkey", S.fourcc(value.cast("long")).alias("code"))


@query(f"WITH {EF} SELECT video_id, frame_idx, (frame_idx * 15360) // 30 AS pts FROM f")
def pts_of_frame(spark, d):
    return V.event_frames(spark, d).select("video_id", "frame_idx", S.pts_of_frame(F.col("frame_idx"), F.lit(30), 1, 15360).alias("pts"))


LF = """l AS (SELECT l_orderkey AS video_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS frame_idx, l_quantity AS value FROM lineitem),
k AS (SELECT video_id AS pos, list(value ORDER BY frame_idx) AS vals FROM l GROUP BY video_id),
b AS (SELECT pos // 4 AS batch_id, pos % 4 AS slot, vals, max(len(vals)) OVER (PARTITION BY pos // 4) AS t FROM k)"""


def line_batches(spark, d):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "value"))), lambda x: x["value"])
    return C.collate(V.line_frames(spark, d).groupBy(F.col("video_id").alias("pos")).agg(ordered.alias("values")), 4)


@query(f"WITH {LF} SELECT batch_id, slot, t::BIGINT AS length, i AS at_, CASE WHEN i < len(vals) THEN vals[i + 1] ELSE 0.0 END AS value FROM (SELECT *, unnest(range(t)) AS i FROM b)")
def collate_pad(spark, d):
    return line_batches(spark, d).select("batch_id", "slot", long("length"), F.posexplode("clip").alias("at_", "value")).withColumn("at_", F.col("at_").cast("long"))


@query(f"WITH {LF} SELECT batch_id, slot, t::BIGINT AS length, len(vals)::BIGINT AS valid FROM b")
def collate_mask(spark, d):
    return line_batches(spark, d).select("batch_id", "slot", long("length"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("valid"))


EMB = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


@query(f"SELECT vec_id, i AS at_, round(e[i + 1] / 255, 9) AS value FROM (SELECT *, unnest(range(64)) AS i FROM {EMB})")
def tensor_normalize(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform("embedding", lambda x: x.cast("double") / 255)).alias("at_", "value"))
    return e.select("vec_id", long("at_"), F.round("value", 9).alias("value"))


@query(f"SELECT vec_id, i AS at_, round(e[(i % 4) * 16 + i // 4 + 1], 9) AS value FROM (SELECT *, unnest(range(64)) AS i FROM {EMB})")
def tensor_permute(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", F.posexplode(S.chw_to_hwc(F.transform("embedding", lambda x: x.cast("double")), 4, 4, 4)).alias("at_", "value"))
    return e.select("vec_id", long("at_"), F.round("value", 9).alias("value"))


@query(f"SELECT vec_id, i AS at_, round((e[(i // 4) * 16 + (i % 4) * 2 + 1] + e[(i // 4) * 16 + (i % 4) * 2 + 2] + e[(i // 4) * 16 + (i % 4) * 2 + 9] + e[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4, 9) AS value FROM (SELECT *, unnest(range(16)) AS i FROM {EMB})")
def tensor_resize_area(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", F.posexplode(S.resize_area(F.col("embedding"), 8, 8, 2)).alias("at_", "value"))
    return e.select("vec_id", long("at_"), F.round("value", 9).alias("value"))


@query("SELECT event_type AS group_id, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(count(*) * 16 / sum(value), 6) AS throughput FROM events GROUP BY event_type")
def bench_percentiles(spark, d):
    trials = V.table(spark, d, "events").select(F.col("event_type").alias("group_id"), F.col("value").alias("latency"))
    return C.latencies(trials, LENGTH).select("group_id", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "throughput")])


@query(f"WITH {EF} SELECT video_id, i AS trial, (i * 16) % (n - 16 + 1) AS start FROM v, range(20) r(i) WHERE n >= 16")
def bench_starts(spark, d):
    return P.benchmark_starts(event_videos(spark, d), 20, LENGTH).select("video_id", long("trial"), "start")


@query(f"WITH {EF}, {PLAN} SELECT p.video_id, frame_start, count(*) AS errors, round(sum(value), 4) AS total FROM p JOIN f ON f.video_id = p.video_id AND frame_idx >= frame_start AND frame_idx < frame_start + {LENGTH} AND is_keyframe GROUP BY p.video_id, frame_start")
def action_join(spark, d):
    labels = V.event_frames(spark, d).filter("is_keyframe").select("video_id", F.col("frame_idx").alias("at"), "value")
    joined = C.labels_of(C.plan(event_videos(spark, d), LENGTH, STRIDE), labels)
    return joined.groupBy("video_id", "frame_start").agg(F.count(F.lit(1)).alias("errors"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {EF}, u AS (SELECT video_id, {uniform_sql(8, 'n')} FROM v) SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS pos, frame_idx, value / 255 AS value FROM u JOIN f USING (video_id, frame_idx)")
def clip_dataset(spark, d):
    f = V.event_frames(spark, d)
    return C.dataset(f, P.uniform(V.lengths(f), 8), {"value": lambda x: x / 255}).select("video_id", long("pos"), "frame_idx", "value")


@query(f"WITH {EF} SELECT video_id, unnest([0, n // 2, n - 1]) AS frame_idx FROM v")
def sample_custom(spark, d):
    return P.custom(event_videos(spark, d), lambda n: F.array(F.lit(0).cast("long"), F.floor(n / 2), n - 1)).select("video_id", "frame_idx")


@query(f"WITH {EF} SELECT video_id, i AS trial, {draw_sql("'5:' || video_id || ':' || i", 'n - 16 + 1')} AS start FROM v, range(20) r(i) WHERE n >= 16")
def bench_starts_random(spark, d):
    return P.benchmark_starts(event_videos(spark, d), 20, LENGTH, "random", 5).select("video_id", long("trial"), "start")


@query(f"WITH {EF}, {PLAN}, {SHUF} SELECT position, video_id, frame_start FROM s ORDER BY position LIMIT 12")
def first_clips(spark, d):
    return event_clips(spark, d).select("position", "video_id", "frame_start").orderBy("position").limit(12)


@query(f"WITH {EF}, {PLAN}, {SHUF} SELECT shard_id, string_agg(video_id || ':' || frame_start, ',' ORDER BY clip_index) AS clips FROM h GROUP BY shard_id")
def clips_by_shard(spark, d):
    label = F.transform("clips", lambda c: F.concat_ws(":", c["video_id"].cast("string"), c["frame_start"].cast("string")))
    return C.by_shard(event_clips(spark, d)).select("shard_id", F.array_join(label, ",").alias("clips"))


@query(f"WITH {EF}, {PLAN}, {SHUF}, {STATS} SELECT printf('%d clips, %d frames, %d shards, %.1f MB', sum(num_clips)::BIGINT, sum(num_frames)::BIGINT, count(*), sum(size_bytes)::DOUBLE / 1048576) AS summary FROM g")
def pack_summary(spark, d):
    t = C.totals(C.shard_stats(event_clips(spark, d), LENGTH, 8).withColumn("camera", F.lit(None).cast("string")))
    return t.select(S.summary(*[F.col(c).cast("long") for c in ("total_clips", "total_frames", "num_shards", "total_size_bytes")]).alias("summary"))


@query("SELECT source || '/' || doc_id || '.mp4' AS path, row_number() OVER (ORDER BY source || '/' || doc_id || '.mp4') - 1 AS position FROM documents")
def path_order(spark, d):
    return with_ordered_position(V.doc_files(spark, d).select("path"), "path")


@query("SELECT doc_id, round(n_chars / 1048576.0::DOUBLE, 12) AS mb FROM documents")
def file_megabytes(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.round(S.megabytes(F.col("n_chars")), 12).alias("mb"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN trunc(o_totalprice / 1000 * 30)::BIGINT ELSE o_orderkey % 100 + 1 END AS num_frames FROM orders")
def frame_count_fallback(spark, d):
    stored = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("o_orderkey") % 100 + 1)
    return V.table(spark, d, "orders").select("o_orderkey", S.frame_count(stored, F.col("o_totalprice") / 1000, F.lit(30)).alias("num_frames"))


@query("SELECT p_partkey, p_size AS width, (p_partkey % 7 + 1)::INT AS height, trim(p_brand) AS first_name, trim(p_type) AS second_name FROM part")
def split_options(spark, d):
    part = V.table(spark, d, "part")
    width, height = S.resolution(F.concat_ws("x", F.col("p_size").cast("string"), (F.col("p_partkey") % 7 + 1).cast("string")))
    names = S.names(F.concat(F.lit(" "), "p_brand", F.lit(" , "), "p_type"))
    return part.select("p_partkey", width.alias("width"), height.alias("height"), names[0].alias("first_name"), names[1].alias("second_name"))


def packed(spark: SparkSession, d: str) -> K.Shards:
    """Events packed and written as shards, to be read back."""
    frames = V.event_frames(spark, d).select(F.col("video_id").cast("string").alias("episode"), F.lit(None).cast("string").alias("camera"), "frame_idx", F.col("value").cast("string").cast("binary").alias("data"))
    out = fresh_path(spark, "packed")
    K.pack_shards(frames, K.PackConfig(out, clip_length=LENGTH, clip_stride=STRIDE, clips_per_shard=PER_SHARD, seed=SEED))
    return K.Shards(spark, out)


@query(f"WITH {EF}, {PLAN}, {SHUF}, {STATS}, {EPOCH} SELECT o.position, clip_index, frame_idx - frame_start AS at_, value FROM h JOIN o USING (shard_id) JOIN f ON f.video_id = h.video_id AND frame_idx >= frame_start AND frame_idx < frame_start + {LENGTH} WHERE o.position % 2 = 1")
def pack_read_epoch(spark, d):
    clips = packed(spark, d).epoch(3, SEED, worker=1, workers=2).select("position", "clip_index", F.posexplode("clip").alias("at_", "data"))
    return clips.select("position", "clip_index", long("at_"), F.col("data").cast("string").cast("double").alias("value"))


@query(f"WITH {EF}, {PLAN}, {SHUF} SELECT frame_idx - frame_start AS at_, value FROM h JOIN f ON f.video_id = h.video_id AND frame_idx >= frame_start AND frame_idx < frame_start + {LENGTH} WHERE position = 17")
def pack_read_clip(spark, d):
    clip = packed(spark, d).clip(17)
    return clip.select((F.col("shard_frame_idx") - F.col("clip_index") * LENGTH).alias("at_"), F.col("data").cast("string").cast("double").alias("value"))
