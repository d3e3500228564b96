"""The operators' registered queries, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, language, mixing, near_dedup, quality, sharding, substring, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column, folds: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % folds


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(rows))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' records; the predicate on their types is applied to headers, by the source."""
    path = warc.archive(table(spark, sf_dir, "pages"))
    records = spark.read.format("warc").option("payload", "digest").load(path).filter(F.col("record_type").isin("response", "revisit"))
    return records.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.concat_ws(",", "items").alias("items"), "best_score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id is not held out; nor is it learned from, as no label names it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 4) != 2)
    scored = quality.score(docs, quality.fit(docs, labels, "quality"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_shard_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_interleaved(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id is not held out, nor learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(fold(F.col("doc_id"), 3) != 1), "text", "lang", F.col("doc_id"))
    out = language.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_chat_format, op3_nearest, op4_warc, op5_decontaminate, op6_substring_dedup, op7_quality, op8_shard_interleaved, op9_language, op10_mix)}

_TURN = "coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10)"
_CONTROL = r"<\\*/?s>|\[\\*/?(?:ROLE|INST)\]"


def _op2_sql() -> str:
    escaped = " + ".join(f"coalesce(length({c}) + len(regexp_extract_all({c}, '{_CONTROL}')), 0)" for c in ("role", "text"))
    assistant = "coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')"
    return f"""
WITH rows_ AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg({_TURN}, '' ORDER BY turn, role, text)) AS turns_sha256,
  length({assistant}) AS loss_chars, sha256({assistant}) AS loss_sha256,
  CAST(sum({escaped} + length('<s>[ROLE][/ROLE]</s>')) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id"""


def _op4_sql() -> str:
    letters = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(hex_, {10 * k + 1}, 10))::BIGINT >> {35 - 5 * j}) & 31) + 1 AS INT), 1)"
        for k in range(4)
        for j in range(8)
    )
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex_ FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last_ FROM p)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, {letters} AS payload_digest,
  CASE WHEN page_id = last_ THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last_ THEN last_ END AS refers_to
FROM q"""


_OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
at_ AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
dup AS (SELECT r, p FROM (SELECT r, p, doc_id, min(doc_id) OVER (PARTITION BY array_to_string(list_slice(w, p, p + 12), ' ')) AS first_ FROM at_) WHERE first_ < doc_id),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS i FROM dup),
words_ AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
left_ AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words_ ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_ USING (r)"""

_HASH = "('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT"

_OP8_SQL = f"""
WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, source, {_HASH} AS h, octet_length(encode(coalesce(text, ''))) + 16 AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes_ FROM documents),
c AS (SELECT doc_id, source, h, CAST(size AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, bytes_), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM d, crc_table),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, crc) AS k, count(*) OVER (PARTITION BY source) AS n FROM c),
s AS (SELECT *, row_number() OVER (ORDER BY (k - 0.5::DOUBLE) / n, source IS NULL, source, k) - 1 AS at_, count(*) OVER () AS total FROM r)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(at_ * 40 // total AS INTEGER) AS shard,
  CAST(at_ - ((at_ * 40 // total) * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

_OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS no_src, {_HASH} AS h,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s0 AS (SELECT no_src, src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY no_src, src) - 1 AS k FROM d GROUP BY no_src, src),
s1 AS (SELECT *, k % 3 + 1 AS weight, source_size * 3 AS cap, CAST(source_size * 3 AS DOUBLE) / (k % 3 + 1) AS ratio FROM s0),
s2 AS (SELECT *, row_number() OVER w AS i, sum(source_size) OVER () AS total,
  coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_from FROM s1 WINDOW w AS (ORDER BY ratio, no_src, src)),
s3 AS (SELECT *, CAST(total - caps_before AS DOUBLE) / CAST(weights_from AS DOUBLE) AS level_here FROM s2),
s4 AS (SELECT *, (SELECT arg_min(level_here, i) FROM s3 WHERE ratio >= level_here) AS level FROM s3),
s5 AS (SELECT no_src, src, source_size, CASE WHEN ratio < level THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS repeats FROM s5),
g AS (SELECT no_src, src, h, sum(size) AS s, sum(sum(size)) OVER (PARTITION BY no_src, src ORDER BY h) AS upto FROM d GROUP BY no_src, src, h),
e AS (SELECT no_src, src, min(h) AS h, arg_min(s, h) AS s, arg_min(upto, h) AS upto FROM g JOIN s6 USING (no_src, src)
  WHERE target - repeats * source_size > 0 AND upto > target - repeats * source_size GROUP BY no_src, src),
b AS (SELECT s6.*, CASE WHEN e.h IS NULL THEN 0 WHEN s - (target - repeats * source_size - (upto - s)) < target - repeats * source_size - (upto - s) THEN e.h + 1 ELSE e.h END AS below
  FROM s6 LEFT JOIN e USING (no_src, src))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (repeats + (h < below)::INT) AS BIGINT) AS taken FROM d JOIN b USING (no_src, src)"""

#: What is learned, searched approximately or retrieved by score (op1, op3, op5, op7, op9) has no SQL form; tests hold it against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": _op2_sql(),
    "op4_warc": _op4_sql(),
    "op6_substring_dedup": _OP6_SQL,
    "op8_shard_interleaved": _OP8_SQL,
    "op10_mix": _OP10_SQL,
}
