"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Tokens are runs of word characters, lower case, and runs of other visible ASCII characters.  Hashes of
single tokens and of neighbouring pairs index one weight vector; a token that repeats the one
before it, or the one before that, is one feature whatever the token.  A document's features are
its n-gram counts divided by the token count and scaled, so that scores don't depend on length.

Training takes a bounded sample of labelled rows (the rows of smallest seeded hash, spread over
the corpus), in one task.  Scoring reads every row where it lies: the weights are broadcast
(``4 << bits`` bytes, whatever the corpus) and a score is a sum of gathered weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import limit_arrow_batches
from .words import MULTIPLIERS, WORDS_AND_MARKS, mixed, pieces, tokenize


@dataclass(frozen=True)
class Settings:
    bits: int = 20  #: the weight vector has 2 ** bits places
    sample: int = 16_000  #: labelled rows to train on, at most
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    scale: float = 20.0
    seed: int = 0


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: index of each feature, repeats included, the text that it is from, and the number of tokens of each text."""
    t = tokenize(texts, WORDS_AND_MARKS, lower=True)
    h, n, left = t.hashes, t.lengths, t.left()
    text = np.repeat(np.arange(len(n)), n)
    two, three = np.flatnonzero(left >= 2), np.flatnonzero(left >= 3)
    pairs = np.where(h[two] == h[two + 1], MULTIPLIERS[0], h[two] * MULTIPLIERS[0] + h[two + 1] * MULTIPLIERS[1])
    skips = three[h[three] == h[three + 2]]
    found = np.concatenate([h, pairs, np.full(len(skips), MULTIPLIERS[1])])
    return (mixed(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([text, text[two], text[skips]]), n


def sigmoid(z: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(z, -35.0), 35.0)))


class Ftrl:
    """Per-coordinate FTRL-proximal for the logistic loss; place ``2 ** bits`` is the intercept."""

    def __init__(self, s: Settings) -> None:
        self.s = s
        self.z = np.zeros((1 << s.bits) + 1)
        self.n = np.zeros((1 << s.bits) + 1)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        s, z = self.s, self.z[i]
        w = (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(self.n[i])) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    def learn(self, i: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(i)
        g = (sigmoid(float(w @ x)) - label) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[i] = n + g * g


def examples(texts: pa.Array, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse vectors of the texts, the intercept last."""
    place, text, tokens = features(texts, s.bits)
    key, count = np.unique((text << s.bits) | place, return_counts=True)
    cuts = np.searchsorted(key, np.arange(len(tokens) + 1) << s.bits)
    out = []
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        i, x = key[a:b] & ((1 << s.bits) - 1), count[a:b] * (s.scale / max(int(tokens[k]), 1))
        out.append((np.append(i, 1 << s.bits).astype(np.int32), np.append(x, 1.0).astype(np.float32)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], s: Settings) -> np.ndarray:
    """The weight vector.  Rows are visited in a seeded order, another in each epoch."""
    model, rng = Ftrl(s), np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            i, x = rows[k]
            model.learn(i, x.astype(np.float64), labels[k])
    return model.weights(slice(None)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> np.ndarray:
    """Weights learned from rows of ``docs`` that ``labels`` marks 0 or 1.

    ``labels`` is sampled by a threshold on a seeded hash of the id, set from its row count to
    give ``s.sample`` ids; every id can be among them.  Only the sample is joined to the texts, so
    no text is shuffled but those learned from.  An id with several labels has its largest, one
    with several rows its smallest text: rows that repeat an id, however many, reach the learning
    task as one.  Null ids and other labels are passed over.  Without labelled rows every score is one half.
    """
    spark = docs.sparkSession
    limit_arrow_batches(spark)
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    marked = marked.withColumn("h", F.xxhash64(F.lit(s.seed), "id"))
    n = marked.count()
    upto = min(2**63 - 1, int(-(2**63) + min(1.0, s.sample / max(n, 1)) * 2**64))
    chosen = marked.filter(F.col("h") <= upto)  # s.sample rows, give or take a few standard deviations
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").groupBy("h", "label").agg(F.min("text").alias("text"))

    def run(batches):
        rows, most = [], s.sample + s.sample // 4
        for batch in pieces(batches):
            if len(rows) < most:
                rows += zip(batch.column("h").to_pylist(), batch.column("label").to_pylist(), *zip(*examples(batch.column("text"), s), strict=True), strict=True)
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
        w = train([r[2:] for r in rows], [r[1] for r in rows], s)
        for at in range(0, len(w), 1 << 16):
            yield pa.RecordBatch.from_pydict({"at": [at], "w": [w[at : at + (1 << 16)].tobytes()]}, schema=pa.schema([("at", pa.int32()), ("w", pa.binary())]))

    out = np.zeros((1 << s.bits) + 1, np.float32)
    for row in sample.repartition(1).mapInArrow(run, "at int, w binary").collect():  # the model: 4 << bits bytes
        w = np.frombuffer(row["w"], np.float32)
        out[row["at"] : row["at"] + len(w)] = w
    return out


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", into: str = "score", s: Settings = Settings()) -> DataFrame:
    """``docs`` with a column ``into``, from 0 to 1, for the whole text of every row.

    A null text counts as empty; an empty text scores what the intercept says.  A column named
    ``into`` is replaced; other columns stay as they are.  Repeated rows score alike.
    """
    limit_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = docs.drop(into)
    schema = kept.select("*", F.lit(0.0).alias(into)).schema

    def run(batches):
        w = shared.value
        for batch in pieces(batches, text_col):
            place, text, tokens = features(batch.column(text_col), s.bits)
            z = float(w[-1]) + s.scale * np.bincount(text, w[place], len(tokens)) / np.maximum(tokens, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sigmoid(v) for v in z], pa.float64())], [*batch.schema.names, into])

    return kept.mapInArrow(run, schema)
