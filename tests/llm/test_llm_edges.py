"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns: no operator or stage minds."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cliploom.llm import ann, chat, decontaminate, language, mixing, near_dedup, quality, queries, sharding, substring, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} and{i}" for i in range(60_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old tree by the river bend"
ROWS = [
    (1, PROSE, "en", "a", 5), (2, PROSE, "en", "a", 5), (2, PROSE, "en", "a", 5), (3, None, "en", "b", None), (4, "", None, None, 0),
    (5, " \t\n ", "en", "b", 3), (6, LONG, "en", None, 9), (7, "¿Qué? ßtraße 東京 " * 5, "es", "", 1), (8, "!!! 123", None, "b", 1),
    (None, PROSE, "en", "a", 2), (None, None, None, None, None), (9, "one two", "es", "c", 7), (10, "x" * 300_000, "en", "c", 1), (9, "another text for the same id", "es", "c", 7),
]
CLASH = ["id", "h", "b", "g", "k", "n", "f", "key", "row", "pos", "src", "no_src", "rank", "at", "shard", "slot", "size", "crc", "count", "label", "class_id", "bucket", "score", "items", "contaminated", "nearest", "rejected", "lang_pred", "taken", "copies", "target", "component", "v"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "seven wise owls watch from a tall old tree by the river bend"), (None, "a b c d e f"), (3, None), (4, ""), (5, "two words"), (1, "quite another item under the same number that nobody has copied")], "item_id long, text string")


def test_near_dedup(docs, nothing):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    classes = {(r["doc_id"], r["class_id"]) for r in got}
    assert {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (None, None)} <= classes
    assert [r["class_id"] for r in got if r["doc_id"] == 9] == [9, 9]  # an id is one document
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_substring(docs, nothing):
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.substring_dedup(docs).collect()), key=str)
    assert len(got) == len(ROWS)
    assert (1, 23, 0) in got and got.count((2, 23, 23)) == 2 and (3, 0, 0) in got and (5, 0, 0) in got and (None, 23, 0) in got and (6, 120_000, 0) in got
    assert substring.substring_dedup(nothing).count() == 0


def test_decontaminate(docs, nothing, benchmark):
    got = decontaminate.decontaminate(docs, benchmark)
    assert "h" in got.columns and got.filter("contaminated").select("items").distinct().collect()[0]["items"] == [1]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.filter("contaminated").collect()) == [(False, 1), (False, 2), (False, 2), (True, 0)]
    assert decontaminate.decontaminate(nothing, benchmark).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    turns = decontaminate.decontaminate(docs, benchmark, s=decontaminate.Settings(index_bytes=40))
    assert turns.filter("contaminated").count() == 4


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (9, 0), (9, 1), (None, 1), (10, None), (6, 7)], "doc_id long, quality int")
    s = quality.Settings(bits=12)
    for rows in (labels, labels.limit(0)):
        w = quality.fit(docs, rows, "quality", s=s)
        got = quality.score(docs, w, s=s).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got} == {0.5}
    assert quality.score(nothing, w, s=s).count() == 0
    # However often rows repeat, they are learned from once.
    weights = [quality.fit(d, labels, "quality", s=s) for d in (docs, docs.unionByName(docs))]
    assert np.array_equal(*weights) and weights[0].any()


def test_language(docs, nothing):
    m = language.fit(docs, "text", "lang", F.col("doc_id"))
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict(docs, m).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (8, "und"), (7, "es"), (1, "en")} <= got
    empty = language.fit(nothing, "text", "lang", F.col("doc_id"))
    assert {r["lang_pred"] for r in language.predict(docs, empty).collect()} == {"und"}
    assert language.predict(nothing, m).count() == 0
    keyless, twice = (language.fit(d, "text", "lang", F.lit(None).cast("long")) for d in (docs, docs.unionByName(docs)))
    assert keyless.names == twice.names and np.array_equal(keyless.centroids, twice.centroids) and set(keyless.names) == {"en", "es"}


def test_sharding(docs, nothing):
    got = sharding.shard_interleaved(docs, 4).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} == {3, 4}
    assert {(r["doc_id"], r["size"]) for r in got} >= {(3, 16), (4, 16), (1, 16 + len(PROSE))}
    assert next(r["text_crc32"] for r in got if r["doc_id"] == 1) == zlib.crc32(PROSE.encode())
    assert sharding.shard_interleaved(nothing, 4).count() == 0
    assert len({(r["shard"], r["slot"]) for r in sharding.shard_interleaved(docs, 40).collect()}) == len(ROWS)


def test_mixing(docs, nothing):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r["taken"] in [k * r["size"] for k in range(4)] for r in got)
    assert [tuple(r) for r in sorted(got, key=str)] == [tuple(r) for r in sorted(mixing.mix(docs.repartition(3)).collect(), key=str)]
    assert sum({(r["source"], r["target"]): r["target"] for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))
    assert mixing.mix(nothing).count() == 0
    kept = mixing.mix(docs, keep=("text", "h", "src")).collect()
    plain = ("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    assert sorted((tuple(r[c] for c in plain) for r in kept), key=str) == sorted(map(tuple, got), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(((r[0], r[1]) for r in ROWS), key=str) and {r["h"] for r in kept} == {"clash"}
    for wrong in (("size",), ("text", "text")):
        with pytest.raises(ValueError):
            mixing.mix(docs, keep=wrong)


def test_mixing_stage_takes_rows_of_one_id_by_their_sources(spark):
    rows = [(1, "w " * 60, "en", "a", 0), *[(k, "w " * 10, "en", "b", 0) for k in range(1, 7)], (1, "w " * 300, "en", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix(docs).collect()}
    got = {(r["doc_id"], r["source"]): r["count"] for r in corpus_pipeline.mix_sources(spark, docs, "").groupBy("doc_id", "source").count().collect()}
    assert len({n for (i, _), n in want.items() if i == 1}) > 1 and got == {k: n for k, n in want.items() if n}


def test_chat(spark):
    tricky = r"<s>[ROLE] <\s> </s>[\INST] [\\/ROLE] [INST] ok [/INST] 東京🎉é"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (1, 1, "assistant", tricky), (2, None, None, None), (None, 0, "assistant", ""), (3, 0, "assistant", LONG[:100_000]), (4, 0, "as[/ROLE]\nsist", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    out = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert set(out) == {1, 2, 3, 4, None}
    assert [(r, t) for r, t, _, _ in chat.parse(out[1]["text"])] == [("user", tricky), ("assistant", tricky), ("assistant", tricky)]
    assert chat.parse(out[4]["text"])[0][:2] == ("as[/ROLE]\nsist", "x")
    got = {k: chat.masked_text(r["text"], r["token_starts"], r["token_stops"], r["loss_mask"]) for k, r in out.items()}
    assert got == {1: tricky * 2, 2: "", None: "", 3: LONG[:100_000], 4: ""}
    assert {k: r["n_turns"] for k, r in out.items()} == {1: 3, 2: 1, 3: 1, 4: 1, None: 1}
    for r in out.values():  # no token crosses a marker, and offsets meet
        a, b = r["token_starts"], r["token_stops"]
        marks = {(m.start(), m.end()) for m in re.finditer(r"</?s>|\[/?ROLE\]", r["text"])}
        assert marks <= set(zip(a, b, strict=True)) and a[0] == 0 and b[-1] == len(r["text"]) and all(y <= x or x == y for x, y in zip(b, a[1:], strict=False))
    whole = {r["conv_id"]: tuple(r) for r in chat.digests(chat.format_conversations(df)).collect()}
    assert whole[1][1] == 3 and whole[1][3] == 2 * len(tricky)
    # What is read back depends on the mask: an all-true one, one moved by a token and one that lacks a token give other digests.
    moved = F.expr("transform(loss_mask, (m, i) -> if(i = 0, false, loss_mask[i - 1]))")
    shorter = F.expr("transform(loss_mask, (m, i) -> m and i <> array_position(loss_mask, true) - 1)")
    for mask in (F.transform("loss_mask", lambda m: F.lit(True)), moved, shorter):
        wrong = {r["conv_id"]: tuple(r) for r in chat.digests(chat.format_conversations(df).withColumn("loss_mask", mask)).collect()}
        for k in (1, 3):
            assert wrong[k][4] != whole[k][4] and wrong[k][2] == whole[k][2]
    # Turns are counted in the text.
    less = chat.digests(chat.format_conversations(df).withColumn("text", F.expr("replace(text, '</s><s>', '')")).withColumn("n_turns", F.lit(9)))
    assert {r["conv_id"]: r["n_turns"] for r in less.collect()}[1] == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_tokens_are_those_of_another_library():
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

    other = Tokenizer.from_file(chat.TOKENIZER.replace(".tiktoken", ".json"))
    assert isinstance(other.pre_tokenizer, pre_tokenizers.ByteLevel)
    other.post_processor = processors.ByteLevel(trim_offsets=False)
    other.encode_special_tokens = True
    own, sizes = chat.load_tokenizer(chat.TOKENIZER)
    other.add_tokens([AddedToken(m, normalized=False) for m in chat.MARKERS])
    for text in ("", PROSE, "(hi). <|endoftext|> 東京🎉é\n\n x", "[](", " " * 50, "<", "x" * 30_000, "\u0301é\u200d"):
        text = chat.render([("user", text), ("assistant", text + "<"), ("a[", "[")])
        ids, a, b = chat.encode(text, own, sizes)
        e = other.encode(text, add_special_tokens=False)
        assert len(ids) == len(e.ids) and [i for i in ids if i < 50256] == [i for i in e.ids if i < 50257 and i != 50256]
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == e.offsets


def test_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(i, [1.0] * 8) for i in range(60, 120)]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, [1.0] * 3), (None, [1.0] * 8), (205, [float("inf")] * 8), (60, [1.0] * 8), (206, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert set(got) == {0, 20, 40, 60, 80, 100}
    whole = dict(r for r in rows[:120])
    for q, found in got.items():
        want = sorted(((-float((np.array(v) * np.array(whole[q])).sum()), i) for i, v in whole.items() if i != q))[:20]
        assert [i for _, i, _ in sorted(found)] == [i for _, i in want]
    # Another dimension is searched by itself; an id with several vectors asks with each and is found by each.
    more = [(300, [1.0, 2.0]), (301, [3.0, 1.0]), (301, [0.0, 9.0]), (302, [1.0, 1.0]), (300, [2.0, 0.5])]
    small = spark.createDataFrame(more, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["id"]): r["score"] for r in ann.nearest(df.select("vec_id", "embedding").unionByName(small), F.col("vec_id") % 100 == 0).collect()}
    assert {k: v for k, v in got.items() if k[0] == 300} == {(300, 301): 18.0, (300, 302): 3.0}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.filter("vec_id in (0, 3)"), F.col("vec_id") % 20 == 0).count() == 1


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y%0A", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (3, None, None), (4, "http://é/", ""), (5, "http://c/", "WARC/1.1\r\n\r\n" + LONG), (5, "http://c/", "WARC/1.1\r\n\r\n" + LONG), (None, "http://d/", "only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("hex", F.lit(1))
    path = warc.archive(df, str(tmp_path / "w"))
    read = spark.read.format("warc").option("payload", "full").load(path)
    got = sorted((tuple(r) for r in read.filter("record_type <> 'warcinfo'").collect()), key=str)
    assert read.filter("record_type = 'warcinfo' and record_id like '<urn:file:%.warc.gz>' and payload is null").count() == len(list((tmp_path / "w").glob("*.warc.gz")))
    assert len(got) == 7 and [r[0] for r in got].count("revisit") == 2
    by = {r[1]: r for r in got}
    assert by["<urn:page:1>"][3] == "<urn:page:2>" and by["<urn:page:1>"][2] == rows[0][1] and by["<urn:page:3>"][3] == "<urn:page:4>" and by["<urn:page:3>"][2] is None
    assert bytes(by["<urn:page:5>"][6]).decode() == rows[4][2] and by["<urn:page:1>"][6] is None and by["<urn:page:1>"][5] == 11
    plan = spark.read.format("warc").load(path).filter("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [r["record_id"] for r in plan.collect()] == ["<urn:page:1>"] and plan.first()["payload"] is None
    empty = warc.archive(df.limit(0), str(tmp_path / "e"))
    assert spark.read.format("warc").load(empty).count() == 0
    file = next((tmp_path / "w").glob("*.warc.gz"))
    import gzip

    assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.1\r\n")  # any reader of gzip members can read them
    data = file.read_bytes()
    file.write_bytes(data[: len(data) - 1])
    with pytest.raises(Exception, match="truncated"):
        spark.read.format("warc").load(path).collect()


def test_warc_query_with_nulls_repeats_and_an_empty_table(spark, tmp_path):
    rows = [(1, "u", "<p>same</p>"), (2, None, "<p>same</p>"), (None, "u", "<p>same</p>"), (None, "u", "only"), (3, None, None), (None, None, None), (2, None, "<p>same</p>"), (-4, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("same", F.lit("clash"))
    pages.write.parquet(str(tmp_path / "a/pages.parquet"))
    pages.limit(0).write.parquet(str(tmp_path / "b/pages.parquet"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in queries.op4_warc(spark, str(tmp_path / "a")).collect()), key=str)
    want = [(1, 11, "revisit", 2), (2, 11, "response", None), (None, 11, "revisit", 2), (None, 4, "response", None), (3, 0, "response", None), (None, 0, "revisit", 3), (2, 11, "response", None), (-4, 0, "revisit", 3)]
    assert got == sorted(want, key=str)
    assert queries.op4_warc(spark, str(tmp_path / "b")).count() == 0
    plan = queries.op4_warc(spark, str(tmp_path / "a"))._jdf.queryExecution().toString()
    assert "Filter (record_type" not in plan.split("== Physical Plan ==")[1]  # nothing is left for Spark to filter


def test_warc_decodes_only_what_passes(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, In, StringStartsWith

    html = "".join(f"<p>{i * 7919 % 1000}</p>" for i in range(3000))  # more than is read with the headers
    df = spark.createDataFrame([(i, f"http://{'a' if i % 4 else 'b'}/{i}", html + str(i // 2)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path = warc.archive(df, str(tmp_path / "w"))
    inflated = []
    monkeypatch.setattr(warc.Member, "all", (lambda real: lambda self: (inflated.append(self.at), real(self))[1])(warc.Member.all))
    for filters, payload, rows, decoded in (
        ([], "digest", 41, 20),
        ([In(("record_type",), ("response",))], "digest", 20, 20),
        ([EqualTo(("record_type",), "revisit")], "full", 20, 0),
        ([StringStartsWith(("target_uri",), "http://b/")], "full", 10, 0),
        ([StringStartsWith(("target_uri",), "http://a/"), EqualTo(("record_type",), "response")], "full", 20, 20),
        ([EqualTo(("record_id",), "<urn:page:7>")], "full", 1, 1),
        ([], "none", 41, 0),
    ):
        reader = warc.WarcReader(path, payload, 1 << 20)
        assert list(reader.pushFilters(filters)) == []
        inflated.clear()
        assert len([r for p in reader.partitions() for r in reader.read(p)]) == rows and len(inflated) == decoded
    assert list(warc.WarcReader(path, "none", 1).pushFilters([EqualTo(("payload_bytes",), 3)]))  # left to Spark


def test_warc_cut_anywhere(tmp_path):
    from pyarrow import fs

    row = {"payload": b"<p>one</p>", "payload_bytes": 10, "record_type": "response", "page_id": 1, "url": None, "digest": "X", "refers_to": None}
    whole = warc.member(warc.record_of(row))
    plain = __import__("gzip").compress(warc.record_of(row))  # without the lengths
    for data in (whole, plain):
        for cut in range(1, len(data)):
            (tmp_path / "x.warc.gz").write_bytes(data + data[:cut])
            with pytest.raises((ValueError, warc.zlib.error)):
                list(warc.Source(fs.LocalFileSystem(), str(tmp_path / "x.warc.gz")).members())


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages(spark, docs, nothing, benchmark, tmp_path, k):
    spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, str(tmp_path))
    ids = sorted((r["doc_id"] for r in got.collect()), key=str)
    every = [r[0] for r in ROWS]
    if name == "quality":  # rows of one text together; what the labels call bad is gone, what they call good is there
        scores = {(r["doc_id"], r["text"]): r["score"] for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), "quality")).collect()}
        assert ids == sorted((i for i, text, *_ in ROWS if scores[i, text] >= 0.7), key=str)
        assert [i for i in ids if i in (1, 2)] == [1, 2, 2] and 9 not in ids
        spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "none/labels.parquet"))
        assert stage(spark, docs, str(tmp_path / "none")).count() == len(ROWS)
    elif name == "near_dedup":
        assert ids == sorted([1, 3, 4, 5, 6, 7, 8, None, 9, 9, 10], key=str)
    elif name == "decontaminate":
        assert ids == sorted([3, 4, 5, 6, 7, 8, None, 9, 9, 10], key=str)
        assert sorted(r["text"] or "" for r in got.collect()) == sorted(r[1] or "" for r in ROWS if r[1] != PROSE)
        benchmark.limit(0).write.parquet(str(tmp_path / "none/benchmark.parquet"))
        assert stage(spark, docs, str(tmp_path / "none")).count() == len(ROWS)
    elif name == "mix":
        want = {(r["doc_id"], r["source"], r["text"]): r["copies"] * every.count(r["doc_id"]) for r in mixing.mix(docs, keep=("text",)).collect()}
        taken = [(r["doc_id"], r["source"], r["text"]) for r in got.collect()]
        assert {x: taken.count(x) for x in set(taken)} == {x: sum(y["copies"] for y in mixing.mix(docs, keep=("text",)).collect() if (y["doc_id"], y["source"], y["text"]) == x) for x, n in want.items() if n}
    else:
        assert ids == sorted(every, key=str) and sorted(r["slot"] for r in got.collect()) == [0] * len(ROWS)  # fewer rows than shards
    if k < 4:
        assert tuple(got.columns) == corpus_pipeline.COLUMNS
    assert stage(spark, nothing, str(tmp_path)).count() == 0
