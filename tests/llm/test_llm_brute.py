"""Operators against brute force, SQL, round trips and held-out accuracy."""

import collections
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from cliploom.llm import ann, components, decontaminate, language, mixing, near_dedup, quality, queries, sharding, substring, words

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    norm = lambda rows: sorted(repr(tuple(round(float(v), 6) if isinstance(v, (int, float)) else v for v in r)) for r in rows)
    assert norm(got.select(*cols).collect()) == norm(duck.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall())


def brute_classes(rows, least=0.8, k=5):
    """Every pair of texts, by the definition."""

    def weights(text):
        w = text.lower().split()
        n = min(k, len(w))
        return collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else collections.Counter()

    def similarity(x, y):
        union = set(x) | set(y)
        return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in union) for i in set(x) & set(y))

    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = {i: weights(t) for i, t in rows}
    for a, (i, t) in enumerate(rows):
        for j, u in rows[:a]:
            if root(i) != root(j) and (t == u or (bags[i] & bags[j]) and similarity(bags[i], bags[j]) >= least):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def family(n, seed, changes):
    """Near copies of one text, each with words changed at random."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = family(70, 1, 9) + family(10, 2, 3) + ["alone " * 3] + [f"text number {i} is short" for i in range(5)] + ["same text here"] * 4
    texts += [f"{'line again and again ' * k}tail" for k in (3, 4, 5, 30, 31)]
    rows = list(enumerate(random.Random(3).sample(texts, len(texts))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    for s in (near_dedup.Settings(), near_dedup.Settings(small=4, block=8, broadcast_ids=0)):  # small buckets force the block comparison
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df, s=s).collect()}
        assert got == want
    assert len(set(want.values())) < len(rows)


def test_signatures_estimate_the_similarity():
    a, b = family(2, 5, 30)
    parts = near_dedup.shingles(pa.array([a, b + " again and again" * 9]), 5)
    sig = near_dedup.signatures(parts, 4000)
    x, y = (np.unique(p, return_counts=True) for p in parts)
    assert (sig[0] == sig[1]).mean() == pytest.approx(near_dedup.probability_jaccard(x, y), abs=0.03)


def test_links_lost_before_verification_are_few():
    """Of pairs at the threshold: none of the bands agrees, or the signatures agree too seldom."""
    s = near_dedup.Settings()
    assert (1 - s.similarity**s.rows) ** s.bands < 4.5e-4
    low = math.ceil(s.least_agreement * s.slots - 1e-9)
    assert low == 60 and sum(math.comb(s.slots, k) * s.similarity**k * (1 - s.similarity) ** (s.slots - k) for k in range(low)) < 1 / 500_000


def test_components(spark):
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {i: root(i) for i in parent}


def test_substring_in_chunks_and_ranges(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(40):
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(80))]
        if i % 3 == 0:
            a = rng.randrange(len(w) + 1)
            w[a:a] = passage[rng.randrange(10) : rng.randrange(18, 31)]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    first, want = {}, {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in rows:
        w = t.split()
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small = substring.Settings(chunk_bytes=300, range_cells=1 << 12, group_windows=16, chunk_rows=3)
    for s in (substring.Settings(), small, substring.Settings(broadcast_keys=0), substring.Settings(depth=1, cells_per_window=0.01)):
        assert {r["doc_id"]: r["kept_text"] for r in substring.substring_dedup(df, s=s).collect()} == want


def test_substring_reads_the_corpus_as_often_whatever_the_ranges(spark):
    read, packed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i, " ".join(f"w{(i * 7 + k) % (50 + i)}" for k in range(100))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    real, times = substring._windows, []
    substring._windows = lambda data, s, n: (packed.add(1), real(data, s, n))[1]
    try:
        for s in (substring.Settings(chunk_rows=7), substring.Settings(chunk_rows=7, range_cells=1 << 12, group_windows=16)):  # 1 range of a row, and 16
            before = read.value, packed.value
            substring.substring_dedup(df, s=s).count()
            chunks = spark.sparkContext.defaultParallelism * -(-(60 // spark.sparkContext.defaultParallelism) // 7)
            times.append((read.value - before[0], (packed.value - before[1]) / chunks))
    finally:
        substring._windows = real
    assert times[0] == times[1] and times[0][0] <= 4 * len(rows) and times[0][1] == 2


def test_tokens_are_pythons():
    texts = ["", None, "a  b\tc d", "x" * 3_000_000 + " y", " é ü ", "a\x1cb"]
    t = words.tokenize(pa.array(texts))
    want = [(s or "").encode().split() for s in texts]
    assert t.lengths.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(t.hashes.tolist())) == len(set(flat))
    again = words.tokenize(pa.array([w.decode() for w in flat]))
    assert again.hashes.tolist() == t.hashes.tolist()
    sliced = words.tokenize(pa.array(texts).slice(2, 3))
    assert sliced.hashes.tolist() == t.hashes[t.ends[1] : t.ends[4]].tolist()


def test_decontamination_finds_what_brute_force_finds(spark, duck):
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    spliced = {10_000 + i: texts[i][:200] + " " + t + " " + texts[i][200:] for i, (_, t) in zip(texts, items, strict=False)}
    texts |= spliced
    norm = lambda t: " ".join(decontaminate.terms(t))
    want = {i: sorted({k for k, t in items if f" {norm(t)} " in f" {norm(x)} "}) for i, x in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(df, bench).collect()}
    assert got == want and all(want[i] for i in spliced)


def test_short_items_are_found_verbatim(spark):
    items = [(1, "2+2=? 4"), (2, "Paris"), (2, "capital of Peru: Lima"), (3, "4 2"), (4, "?!"), (5, "two plus two is four, they say in this very long item")]
    texts = ["we know 2 + 2 = 4 for sure", "paris, PARIS", "Capital of Peru? LIMA", "2 2", "4", "capital of peru", "2 4 2", None, "", "parisian"]
    want = [[1], [2], [2], [], [], [], [3], [], [], []]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for s in (decontaminate.Settings(), decontaminate.Settings(index_bytes=40)):
        got = {r["doc_id"]: (r["items"], r["best_score"]) for r in decontaminate.decontaminate(df, bench, s=s).collect()}
        assert [got[i] for i in range(len(texts))] == [(w, float(bool(w))) for w in want]


def test_turns_give_the_results_of_one_index(spark):
    rng = random.Random(5)
    vocab = [f"t{min(rng.randrange(400), rng.randrange(400))}" for _ in range(400)]
    items = [(i % 25, " ".join(rng.choices(vocab, k=rng.randrange(6, 90)))) for i in range(30)]
    rows = []
    for i in range(120):
        w = items[i % 30][1].split()
        kept = [x if rng.random() < 0.8 else rng.choice(vocab) for x in w]
        rows.append((i, " ".join([*rng.choices(vocab, k=20), *kept, *rng.choices(vocab, k=20)])))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = ({r["doc_id"]: (r["items"], round(r["best_score"], 12)) for r in decontaminate.decontaminate(df, bench, s=s).collect()} for s in (decontaminate.Settings(), decontaminate.Settings(index_bytes=1500)))
    assert one == many and any(0.5 < score < 1 for _, score in one.values())


def test_index_retrieves_all_above_threshold():
    rng = random.Random(2)
    vocab = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=20))) for i in range(60)]
    s = decontaminate.Settings()
    ix = decontaminate.Index(items, s)
    for _ in range(200):
        base = items[rng.randrange(60)][1].split()
        passage = rng.sample(base, rng.randrange(5, 20)) + rng.choices(vocab, k=30)
        t = words.tokenize(pa.array([" ".join(passage)]), words.WORDS_ONLY)
        ids = ix.ids(t.hashes)
        found = np.unique(ids[ids >= 0])
        full = np.zeros(ix.n)
        for k in found:
            a, b = ix.start[k], ix.start[k + 1]
            full[ix.seg[a:b]] += ix.impact[a:b]
        want = {d: full[d] for d in range(ix.n) if full[d] >= s.threshold - 1e-9}
        assert dict(ix.search(found)) == pytest.approx(want)
        assert not want or len(ix.candidates(ids, t.ends))


@pytest.mark.parametrize("light", [0.0, 0.2, 0.34])
def test_no_passage_over_the_threshold_is_passed_over(light):
    """Candidates of whole documents, of several in a batch, against every passage and every segment."""
    rng = random.Random(7)
    vocab = [f"t{min(rng.randrange(300), rng.randrange(300))}" for _ in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(5, 150)))) for i in range(50)]
    s = decontaminate.Settings(light=light, block=4, threshold=0.35)
    ix = decontaminate.Index(items, s)
    assert {t for _, text in items for t in text.split()} == set(ix.term)  # every word is indexed
    texts = []
    for k in range(60):
        w = rng.choices(vocab, k=rng.randrange(0, 400))
        part = items[k % 50][1].split()
        at = rng.randrange(len(w) + 1)
        texts.append(" ".join(w[:at] + [x for x in part if rng.random() < 0.6] + w[at:]))
    t = words.tokenize(pa.array(texts), words.WORDS_ONLY, lower=True)
    ids = ix.ids(t.hashes)
    kept, retrieved, want = {(d, at): pivots for d, at, pivots in ix.candidates(ids, t.ends)}, set(), set()
    for k, (a, b) in enumerate(zip([0, *t.ends[:-1].tolist()], t.ends.tolist(), strict=True)):
        for at in range(0, max(1, b - a - s.passage + s.stride), s.stride):
            found = ids[a + at : min(a + at + s.passage, b)]
            found = np.unique(found[found >= 0])
            full = np.zeros(ix.n)
            for term in found:
                i, j = ix.start[term], ix.start[term + 1]
                full[ix.seg[i:j]] += ix.impact[i:j]
            over = set(np.flatnonzero(full >= s.threshold - 1e-9).tolist())
            want |= {(k, at, d) for d in over}
            if (k, at) in kept:
                retrieved |= {(k, at, d) for d, _ in ix.search(found, kept[k, at])}
                assert {d for d, _ in ix.search(found)} == over
    assert retrieved == want and len(want) > 50


def test_items_of_one_text_are_one_item(spark):
    bench = spark.createDataFrame([(i % 50 + 3, "which river flows through the old town? the green river") for i in range(5000)] + [(2, "another item about rivers? none of them")], "item_id long, text string")
    df = spark.createDataFrame([(1, "so which river flows through the old town? the green river it is")], "doc_id long, text string")
    for s in (decontaminate.Settings(), decontaminate.Settings(index_bytes=60)):
        assert decontaminate.decontaminate(df, bench, s=s).first()["items"] == [3]


def test_shards_match_the_mixture(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else f"s{i % 7}") for i in range(4000)]
    got = sharding.shard_interleaved(spark.createDataFrame(rows, "doc_id long, text string, source string"), 40).collect()
    counts = collections.Counter((r["shard"], r["source"]) for r in got)
    totals = collections.Counter(r["source"] for r in got)
    assert set(collections.Counter(r["shard"] for r in got).values()) == {100}
    assert all(abs(counts[k, src] - n / 40) <= (8 if src == 'big' else 2) for k in range(40) for src, n in totals.items())


def test_sources_of_one_row_and_rows_of_one_id_are_dealt_over_tasks(spark):
    rows = [(i, f"t{i}", f"host{i}") for i in range(3000)] + [(7, "same", "big")] * 3000 + [(None, None, None)] * 2000
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    real, tables = sharding.ranged, []
    sharding.ranged = lambda *a: (tables.append(real(*a)), tables[-1])[1]
    try:
        got = sharding.shard_interleaved(df, 40, rows_per_part=500).collect()
    finally:
        sharding.ranged = real
    for t in tables:
        assert max(r["count"] for r in t.groupBy("part").count().collect()) < 3 * 500
    assert sorted((r["shard"], r["slot"]) for r in got) == [(k, j) for k in range(40) for j in range(200)]
    # By definition: fractional ranks, then sources by name, null last.
    order = sorted([(0.5, False, f"host{i}", 1) for i in range(3000)] + [((k + 0.5) / 3000, False, "big", k) for k in range(3000)] + [((k + 0.5) / 2000, True, "", k) for k in range(2000)])
    assert [r["source"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] == [None if null else name for _, null, name, _ in order]


def test_targets_of_many_sources(spark):
    rng = random.Random(6)
    rows = [(f"s{i:04d}" if i else "", i == 0, rng.choice([0, 1, 5, 40, 900])) for i in range(500)]
    df = spark.createDataFrame(rows, "src string, no_src boolean, source_size long")
    want = {(s, null): 0.0 for s, null, _ in rows}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    weight = {r[:2]: k % 3 + 1 for k, r in enumerate(order)}
    left, open_ = float(sum(r[2] for r in rows)), dict.fromkeys(want)
    caps = {r[:2]: 3 * r[2] for r in rows}
    while True:  # give by weight, stop those that are over, share the rest
        level = left / sum(weight[k] for k in open_)
        over = [k for k in open_ if caps[k] < level * weight[k]]
        if not over:
            want |= {k: level * weight[k] for k in open_}
            break
        for k in over:
            want[k] = float(caps[k])
            left -= caps[k]
            del open_[k]
    for per in (50_000, 40):
        got = {(r["src"], r["no_src"]): r["target"] for r in mixing.targets(df, sources_per_part=per).collect()}
        assert got == pytest.approx(want)


def test_quality_equals_updates_step_by_step(spark):
    """Features of words by dictionary, one coordinate at a time; weights, scores and the order of learning."""
    rng = random.Random(8)
    good, bad = ["The river runs.", "a good, clear line", "words of sense"], ["buy buy buy now!!!", "click here here", "$$$ win ###"]
    rows = [(i, " ".join(rng.choices(good if i % 3 else bad, k=rng.randrange(1, 6)))) for i in range(60)] + [(60, ""), (61, None)]
    labels = [(i, int(i % 3 > 0)) for i in range(62) if i % 5]
    s = quality.Settings()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learned = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"), "quality", s=s)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, learned, s=s).collect()}

    def vector(text):
        w = re.findall(r"[0-9A-Za-z_]+|[^0-9A-Za-z_\s]+", (text or "").lower())
        found = collections.Counter(w)
        found.update("same" if a == b else (a, b) for a, b in zip(w, w[1:], strict=False))
        found.update("skip" for a, b in zip(w, w[2:], strict=False) if a == b)
        return {k: float(np.float32(n * (s.scale / max(len(w), 1)))) for k, n in found.items()} | {None: 1.0}

    z, n, texts = collections.defaultdict(float), collections.defaultdict(float), dict(rows)
    keys = spark.createDataFrame(labels, "id long, label int").withColumn("h", F.xxhash64(F.lit(s.seed), "id")).orderBy("h").collect()
    order = [(vector(texts[r["id"]]), r["label"]) for r in keys]
    weight = lambda k: 0.0 if abs(z[k]) <= s.l1 else (math.copysign(s.l1, z[k]) - z[k]) / ((s.beta + math.sqrt(n[k])) / s.alpha + s.l2)
    logistic = lambda t: 1 / (1 + math.exp(-t))
    steps = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for k in steps.permutation(len(order)):
            x, label = order[k]
            w = {f: weight(f) for f in x}
            error = logistic(sum(w[f] * v for f, v in x.items())) - label
            for f, v in x.items():
                g = error * v
                sigma = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / s.alpha
                z[f] += g - sigma * w[f]
                n[f] += g * g
    want = {i: logistic(sum(weight(f) * v for f, v in vector(t).items())) for i, t in rows}
    assert got == pytest.approx(want, abs=1e-4)
    assert max(want.values()) > 0.8 and min(want.values()) < 0.2


def test_language_is_that_of_the_nearest_centroid(spark, duck, monkeypatch):
    """Every n-gram by itself, every centroid by its whole cosine; and slices of a long text give its counts."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    m, s = language.fit(docs, "text", "lang", F.col("doc_id")), language.Settings()
    rows = [(i, t) for i, t in duck.execute("SELECT doc_id, text FROM documents ORDER BY length(text) LIMIT 60").fetchall()] + [(-1, "ÀB c!!d"), (-2, " 12 "), (-3, None), (-4, "x")]

    def place(gram):
        h = 0
        for c in gram:
            h = (h << 21 | ord(c)) % 2**64
        h = (h + len(gram)) % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> shift)) * factor % 2**64
        return (h ^ (h >> 31)) >> (64 - s.bits)

    def count(text):
        t = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return collections.Counter(place(t[i : i + k]) for k in s.orders for i in range(len(t) - k + 1))

    want = {}
    for i, text in rows:
        if not any(c.isalpha() for c in text or ""):
            want[i] = ("und", 0.0)
            continue
        v = {p: math.log1p(n) * m.idf[p] for p, n in count(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(float(c[p]) * x for p, x in v.items()) / norm for c in m.centroids]
        k = max(range(len(cosines)), key=lambda j: (round(cosines[j], 6), -j))
        want[i] = (m.names[k], cosines[k])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert {i: x[1] for i, x in got.items()} == pytest.approx({i: x[1] for i, x in want.items()}, abs=1e-5)
    table = language.letter_table()
    for width in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(language, "SLICE", width)
        for text in ("", "a", "ab  c 1 d", "  x", "no 12 letters  end  "):
            found = language.counts(text, table, s)
            assert ({} if found is None else {int(p): found[p] for p in np.flatnonzero(found)}) == (dict(count(text)) if any(map(str.isalpha, text)) else {})


def test_accuracy_of_held_out_rows(spark, duck):
    got = {r["doc_id"]: r for r in queries.op9_language(spark, DATA).collect() if r["held_out"]}
    langs = dict(duck.execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall())
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in got if i in langs]) > 0.9
    data = DATA.replace("0.001", "0.01")
    scored = {r["doc_id"]: r for r in queries.op7_quality(spark, data).collect() if r["held_out"]}
    quality = dict(duck.execute(f"SELECT doc_id, quality FROM '{data}/labels.parquet'").fetchall())
    assert np.mean([scored[i]["predicted"] == q for i, q in quality.items() if i in scored]) > 0.93
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in scored)


def test_recall_of_nearest(spark, duck):
    data = DATA.replace("0.001", "0.1")
    x = duck.execute(f"SELECT vec_id, embedding FROM '{data}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, v = np.array([i for i, _ in x]), np.array([e for _, e in x], np.float64)
    found = collections.defaultdict(set)
    for r in queries.op3_nearest(spark, data).collect():
        found[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = v @ v[q]
        score[q] = -np.inf
        hit += len(found[ids[q]] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hit / (20 * len(found)) >= 0.9


def test_recall_of_nearest_with_lists_fitted_in_levels(spark):
    """Directions without clusters, and lists so short that there are a thousand, in 16 cells."""
    v = np.random.default_rng(3).normal(size=(34_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.array(list(v))}))
    found = collections.defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 200 == 0, s=ann.Settings(list_size=32, cell=64, block=2000, query_block=100)).collect():
        found[r["query_id"]].add(r["id"])
    hit = 0
    for q in range(0, len(v), 200):
        score = v @ v[q]
        score[q] = -np.inf
        hit += len(found[q] & set(np.argsort(-score)[:20].tolist()))
    assert hit / (20 * 170) >= 0.9


def cells_of_centroids(cells=16, each=64):
    """Centroids that lie closer to those of their cell than to any other, as a fit in two levels leaves them."""
    rng = np.random.default_rng(4)
    c = np.repeat(rng.normal(size=(cells, 64)), each, 0) + rng.normal(size=(cells * each, 64)) * 0.6
    return (c / np.linalg.norm(c, axis=1, keepdims=True)).astype(np.float32)


def test_graph_leads_from_cell_to_cell():
    c = cells_of_centroids()
    near = ann.centroid_graph(c, 16)
    assert (near[:, :16] // 64 == np.arange(len(c))[:, None] // 64).mean() > 0.99
    graph = ann.with_far_links(near, 8, 0)
    for k, row in enumerate(graph.tolist()):
        others = [a for a in row if a != k]
        assert len(others) == len(set(others)) and set(near[k].tolist()) - {k} <= set(others)
    q = np.random.default_rng(5).normal(size=(200, 64)).astype(np.float32)
    exact = np.argsort(ann.distances(q, c), axis=1)[:, :256]

    def share(g):
        got = ann.search_graph(ann.Model(c, g, np.arange(0, len(c), 16), 1.0), q, 256, 96)[0]
        return np.mean([len(set(a) & set(b)) / 256 for a, b in zip(got.tolist(), exact.tolist(), strict=True)])

    assert share(near) < 0.9
    assert share(graph) >= 0.98


def test_what_a_poor_graph_misses_is_made_up_by_more_lists():
    """The number of lists is measured by searches of the graph, not by exact distances alone."""
    v = np.random.default_rng(6).normal(size=(6000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = cells_of_centroids()
    c = np.hstack([c, np.zeros((len(c), 1), np.float32)])
    s = ann.Settings(asked=64)
    entries = np.arange(0, len(c), 16)
    near = ann.centroid_graph(c, 16)
    good = ann.measured(ann.Model(c, ann.with_far_links(near, 8, 0), entries, 1.0), v, s)
    poor = ann.measured(ann.Model(c, near[:, :4], entries, 1.0), v, s)
    assert good.probes < poor.probes


def test_clustered_vectors_read_few_lists():
    """What is measured at fitting decides how much is read."""
    rng = np.random.default_rng(5)
    tops = rng.normal(size=(256, 32))
    tops /= np.linalg.norm(tops, axis=1, keepdims=True)
    shares = []
    for spread in (0.02, 5.0):
        x = tops[rng.integers(0, 256, 8000)] + rng.normal(size=(8000, 32)) * spread
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = np.array(ann.bisect(ann.widened(x, 1.0), 256, rng), np.float32)
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        s = ann.Settings(least=1)
        m = ann.measured(ann.Model(c, ann.centroid_graph(c, 16), np.arange(64), 1.0), x, s)
        shares.append(np.mean([len(own) for own in ann.lists_of_queries(m, ann.as_query(x[:200], 1.0), s)]) / 256)
    assert shares[0] < 0.02 < shares[1] < 0.5


def test_ties_of_nearest(spark):
    """Distinct rows of equal scores: 20,000 of few values, and one block of more ties than are returned."""
    rng = np.random.default_rng(4)
    v = rng.integers(0, 2, (2000, 8)).astype(float)
    v[~v.any(1)] = 1.0
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    for q in range(0, 2000, 100):
        score = (v * v[q]).sum(1)
        score[q] = -1
        assert got[q] == [(i, score[i]) for i in np.lexsort((np.arange(2000), -score))[:20].tolist()]
    x = np.hstack([np.ones((2000, 1)), rng.normal(size=(2000, 3))])  # equal scores with the query, other vectors
    tied = ann._best(*(pa.table({"id": np.array(i), "v": pa.array(w.tolist())}) for i, w in ((range(2000), x), ([5000], np.array([[1.0, 0, 0, 0]])))), np.zeros(2000, np.int64), [[0]], 20)
    assert tied.column("id").to_pylist() == list(range(20))


def test_pipeline_reduces_rows_without_an_id(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(100)) for c in "abc")
    rows = [(7, one), (None, one), (None, one + " more"), (None, two), (None, two), (None, two + " more"), (3, three), (3, three), (None, None), (None, None), (None, "short")]
    df = spark.createDataFrame([(i, t, "en", "a", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_near_duplicates(spark, df, "").collect()]
    of_two = [r for r in got if r in ((None, two), (None, two + " more"))]
    assert len(of_two) == 1
    assert sorted(got, key=str) == sorted([(7, one), (3, three), (None, None), (None, None), (None, "short"), *of_two], key=str)


def test_pipeline(spark, duck):
    """Each stage against the operator's own answer on the stage's input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, DATA).cache()
    quality = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    ids = {r["doc_id"] for r in kept.collect()}
    assert not [i for i in ids if quality.get(i) == 0] and len(ids) > 100
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    classes = brute_classes(rows)
    once = corpus_pipeline.keep_one_of_near_duplicates(spark, kept, DATA).cache()
    assert sorted(r["doc_id"] for r in once.collect()) == sorted({c for c in classes.values()})
    clean = corpus_pipeline.drop_contaminated(spark, once, DATA).cache()
    norm = lambda t: " ".join(decontaminate.terms(t))
    tests = [norm(t) for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()]
    want = sorted(r["doc_id"] for r in once.collect() if not any(f" {t} " in f" {norm(r['text'])} " for t in tests))
    assert sorted(r["doc_id"] for r in clean.collect()) == want
    mixed = corpus_pipeline.mix_sources(spark, clean, DATA)
    taken = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert max(taken.values()) <= 3 and set(taken) <= set(want)
    n = __spark_entry__.queries()["pipeline"](spark, DATA).count()
    assert n == sum(taken.values())
