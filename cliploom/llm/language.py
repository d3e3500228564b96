"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed character n-grams; each language has several
centroids, found by spherical k-means, and the text takes the language of the centroid of largest
cosine.  A text whose largest cosine lies under the threshold of its language is marked as
rejected.

The model is fitted on a bounded sample and broadcast: ``4 << bits`` bytes a centroid.  Scoring
reads every row, whole text, where it lies.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import limit_arrow_batches
from .words import mixed, pieces


@dataclass(frozen=True)
class Settings:
    bits: int = 13
    orders: tuple[int, ...] = (1, 2, 3)  #: lengths of the n-grams
    centroids: int = 4  #: for each language
    sample_of_each: int = 800  #: rows of each language to fit on, at most
    languages: int = 512  #: more than this is an error, as the model is broadcast
    rounds: int = 8
    reject_quantile: float = 0.005
    seed: int = 0


@dataclass
class Model:
    names: list[str] = field(default_factory=list)  #: language of each centroid
    centroids: np.ndarray | None = None  #: one row each, unit length, IDF not applied
    idf: np.ndarray | None = None
    least: dict[str, float] = field(default_factory=dict)  #: cosine under which a text is rejected


SLICE = 1 << 20  #: characters of a text counted at a time


def codes(text: str, table: np.ndarray) -> np.ndarray:
    """Code points in lower case; what is no letter becomes a space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(table[c], c, np.uint32(32))


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str | None, table: np.ndarray, s: Settings) -> np.ndarray | None:
    """Counts of hashed n-grams of a text with a space at either end; runs of spaces count once.  None for a text without a letter.

    A long text is counted in slices, each with the end of the one before it.
    """
    text, out, any_letter = text or "", np.zeros(1 << s.bits), False
    before, held = np.empty(0, np.uint64), np.array([32], np.uint32)
    for a in range(0, max(len(text), 1), SLICE):
        c = codes(text[a : a + SLICE], table)
        any_letter |= bool((c != 32).any())
        c = np.concatenate([held, c, np.full(int(a + SLICE >= len(text)), 32, np.uint32)])
        held = np.empty(0, np.uint32)
        last = np.append(before[-1] if len(before) else np.uint64(0), c[:-1])
        c = np.concatenate([before, c[(c != 32) | (last != 32)].astype(np.uint64)])
        for k in s.orders:
            begin = max(0, len(before) - k + 1)  # n-grams that end in this slice
            if (n := len(c) - begin - k + 1) > 0:
                h = c[begin : begin + n].copy()
                for j in range(1, k):
                    h = (h << np.uint64(21)) | c[begin + j : begin + j + n]
                h = mixed(h + np.uint64(k)) >> np.uint64(64 - s.bits)
                out += np.bincount(h.astype(np.int64), minlength=1 << s.bits)
        before = c[max(0, len(c) - max(s.orders) + 1) :]
    return out if any_letter else None


def vector(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count) * idf
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; a centroid that loses all its rows takes the row that fits worst."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        sims = x @ c.T
        mine = sims.argmax(1)
        for j in range(k):
            rows = x[mine == j]
            total = rows.sum(0) if len(rows) else x[sims.max(1).argmin()]
            c[j] = total / max(float(np.linalg.norm(total)), 1e-12)
    return c


def log_counts(text: str, table: np.ndarray, s: Settings) -> np.ndarray | None:
    """None for a text without a letter."""
    count = counts(text, table, s)
    return None if count is None else np.log1p(count).astype(np.float32)


def fit_arrays(rows: list[np.ndarray], langs: list[str], s: Settings) -> Model:
    rng = np.random.default_rng(s.seed)
    if not rows:
        return Model(idf=np.ones(1 << s.bits))
    x, y = np.array(rows), np.array(langs, object)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1.0
    x *= idf.astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    names, cents, least = [], [], {}
    for lang in sorted(set(langs)):
        own = x[y == lang]
        c = cluster(own, s.centroids, s.rounds, rng)
        names += [lang] * len(c)
        cents.append(c)
        least[lang] = float(np.quantile((own @ c.T).max(1), s.reject_quantile))
    return Model(names, np.vstack(cents).astype(np.float32), idf, least)


def fit(docs: DataFrame, text_col: str, lang_col: str, key: Column, s: Settings = Settings()) -> Model:
    """Fit on the rows of ``docs`` with a language: of each, those of smallest seeded hash.

    Sampling is by thresholds on the hash, from counts by language, so that a language with a
    third of all rows is never gathered; the sample has ``1.25 * sample_of_each`` rows of a
    language, about, and ``sample_of_each`` are used.  The hash is of key and text, so rows with a
    null key are sampled as any others; rows that repeat both, however many, count as one.
    """
    spark = docs.sparkSession
    limit_arrow_batches(spark)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(s.seed), key, text_col).alias("h")
    )
    totals = known.groupBy("lang").count().limit(s.languages + 1).collect()
    if len(totals) > s.languages:
        raise ValueError(f"more than {s.languages} languages")
    if not totals:
        return fit_arrays([], [], s)
    # A share of the hash's range: xxhash64 is uniform over signed 64-bit integers.
    share = [(r["lang"], int(-(2**63) + min(1.0, 1.25 * s.sample_of_each / r["count"]) * (2**64 - 1))) for r in totals]
    limits = spark.createDataFrame([(a, min(b, 2**63 - 1)) for a, b in share], "lang string, upto long")
    sample = known.join(F.broadcast(limits), "lang").filter(F.col("h") <= F.col("upto")).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def run(batches):
        table, held = letter_table(), {}
        for batch in batches:
            for text, lang, h in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "h")), strict=True):
                if (row := log_counts(text, table, s)) is not None:
                    # A heap of the smallest hashes of each language; row bytes only break ties.
                    own = held.setdefault(lang, [])
                    (heapq.heappush if len(own) < s.sample_of_each else heapq.heappushpop)(own, (-h, row.tobytes()))
        langs = sorted(held)
        rows = [np.frombuffer(r, np.float32) for lang in langs for _, r in sorted(held[lang])]
        m = fit_arrays(rows, [lang for lang in langs for _ in held[lang]], s)
        yield pa.RecordBatch.from_pydict({"name": ["/idf"], "v": [m.idf.astype(np.float32).tobytes()], "least": [0.0]})
        for name, c in zip(m.names, m.centroids if m.names else [], strict=True):
            yield pa.RecordBatch.from_pydict({"name": [f"={name}"], "v": [c.tobytes()], "least": [m.least[name]]})

    model = Model()
    cents = []
    for r in sample.repartition(1).mapInArrow(run, "name string, v binary, least double").collect():  # the model alone
        v = np.frombuffer(r["v"], np.float32)
        if r["name"] == "/idf":
            model.idf = v.astype(np.float64)
        else:
            model.names.append(r["name"][1:])
            cents.append(v)
            model.least[r["name"][1:]] = r["least"]
    model.centroids = np.array(cents, np.float32) if cents else None
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """``docs`` with nearest string, score double (the cosine), rejected boolean and lang_pred string.

    lang_pred is ``nearest``, or ``und`` if the text is null or has no letter (then score is 0).
    rejected is true where the cosine lies under the threshold of the language, and where
    lang_pred is ``und``.  Columns of these names are replaced.  Equal texts get equal results; a
    tie goes to the language that sorts first.  A model fitted on no rows says ``und`` of all.
    """
    limit_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = {"nearest": "string", "score": "double", "rejected": "boolean", "lang_pred": "string"}
    kept = docs.drop(*new)
    schema = kept.select("*", *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema

    def run(batches):
        m, table = shared.value, letter_table()
        least = np.array([m.least[n] for n in m.names])
        for batch in pieces(batches, text_col):
            near, score, out = [], [], []
            for text in batch.column(text_col).to_pylist():
                count = None if m.centroids is None else counts(text, table, s)
                if count is None:
                    near.append(None), score.append(0.0), out.append(True)
                    continue
                sims = m.centroids @ vector(count, m.idf).astype(np.float32)
                k = int(sims.argmax())
                near.append(m.names[k]), score.append(float(min(1.0, max(0.0, sims[k])))), out.append(bool(sims[k] < least[k]))
            added = [pa.array(near, pa.string()), pa.array(score, pa.float64()), pa.array(out), pa.array([n or "und" for n in near], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *new])

    return kept.mapInArrow(run, schema)
