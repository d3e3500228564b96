"""Benchmark decontamination: a BM25 index of test items, queried with every training passage.

The index holds test items, in segments of bounded length.  An impact is the BM25 weight of a
term in a segment divided by the segment's sum, so that a passage scores 1 if it holds all terms
of the segment.  Posting lists are cut into aligned blocks of segments with the largest impact of
each block.

Retrieval is block-max WAND with the threshold fixed, so what is over it is retrieved, all of it;
nothing is ranked or cut.  It has two steps.  A pass over all passages of many documents at once does
what a pivot does: each segment's lightest terms, with ``light`` of its sum at most, are left out, and
a segment can reach the threshold only if its other, essential terms bring the rest; passages without
any such segment have no pivot.  Each passage that remains is searched by cursors, one for each of its
terms: the pivot is the first segment at which the bounds of the lists up to it reach the threshold;
if the block maxima there don't, the cursors skip to where they may; else they meet at the pivot and
its score is added up.

Retrieved items are verified: both question and answer must overlap with the words around the
passage.  Items of a few words are not indexed; they are found by their whole word sequence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import limit_arrow_batches, written
from .words import WORDS_ONLY, hash_words, pieces, tokenize, windows

TERM = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")  #: what tokenize() takes for words


@dataclass(frozen=True)
class Settings:
    passage: int = 96  #: words
    stride: int = 32
    segment: int = 64  #: words of an item indexed together; passage - stride, so that a passage holds it whole
    threshold: float = 0.5
    light: float = 0.25  #: share of a segment's weight in terms that the first pass leaves out
    overlap: float = 0.5  #: of the word n-grams of question and of answer
    gram: int = 3
    min_words: int = 5  #: items of fewer words are searched for by their whole word sequence
    k1: float = 1.2
    b: float = 0.75
    block: int = 32  #: segments
    index_bytes: int = 32 << 20  #: of item text in one index; more is searched in turns

    def __post_init__(self) -> None:
        if not self.light < self.threshold:
            raise ValueError("light must be under the threshold: else a segment could reach it by terms that the first pass leaves out")


def terms(text: str | None) -> list[str]:
    return TERM.findall(pc.utf8_lower(pa.scalar(text or "")).as_py())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Parts of a test item: at a marked answer, else after the last question mark, else at the last sentence, else at three quarters of the words."""
    for cut in (
        re.search(r"(?i)\banswer\s*:", text),
        re.search(r"(?s).*\?()(?=.*\w)", text),
        re.search(r"(?s).*[.!?\n]()(?=[^.!?\n]*\w[^.!?\n]*[.!?\s]*$)", text),
    ):
        if cut:
            at = cut.end()
            q, a = terms(text[:at]), terms(text[at:])
            if q and a:
                return q, a
    w = terms(text)
    at = len(w) - max(1, len(w) // 4)
    return w[:at], w[at:]


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], words: list[str], n: int) -> float:
    """Share of the part's n-grams that ``words`` has; an empty part overlaps wholly."""
    own = grams(part, n)
    m = min(n, len(part))
    return len(own & {tuple(words[i : i + m]) for i in range(len(words) - m + 1)}) / len(own) if own else 1.0


def segments_of(words: list[str], s: Settings) -> list[Counter]:
    """What is indexed of an item, the last words of a long one with those before them; nothing of one of fewer than ``s.min_words`` words."""
    last = max(0, len(words) - s.segment)
    return [Counter(words[min(at, last) :][: s.segment]) for at in range(0, len(words), s.segment)] if len(words) >= s.min_words else []


class Statistics(NamedTuple):
    """Of all segments of a benchmark."""

    segments: int
    mean: float  #: words of a segment
    df: dict[str, int]  #: segments that hold a term


class Index:
    """Of all items, or of a part of them with the statistics of all."""

    def __init__(self, items: list[tuple[int, str]], s: Settings, whole: Statistics | None = None) -> None:
        self.s, self.parts, segments, self.entry = s, [], [], []
        self.id = [item for item, _ in items]  # by entry, as items may share an id
        by_length: dict[int, dict[tuple[str, ...], list[int]]] = {}
        for entry, (_, text) in enumerate(items):
            w = terms(text)
            self.parts.append(question_and_answer(text) if len(w) >= s.min_words else ([], []))
            if 0 < len(w) < s.min_words:
                by_length.setdefault(len(w), {}).setdefault(tuple(w), []).append(entry)
            own = segments_of(w, s)
            segments += own
            self.entry += [entry] * len(own)
        # By length: sorted keys of the short items' word sequences, and their entries.
        self.short = {k: (np.unique(windows(hash_words([t for w in of for t in w], WORDS_ONLY), k)[::k]), of) for k, of in by_length.items()}
        n, local = len(segments), Counter(t for seg in segments for t in seg)
        total_n, mean, df = whole or Statistics(n, sum(sum(seg.values()) for seg in segments) / max(n, 1), local)
        self.term = {t: k for k, t in enumerate(local)}
        found = hash_words(list(local), WORDS_ONLY)
        self.term_order = np.argsort(found)
        self.term_hashes = found[self.term_order]
        self.may_be = np.zeros(1 << 20, bool)  # by the first bits of the hash
        self.may_be[found >> np.uint64(44)] = True
        lists: list[list[tuple[int, float]]] = [[] for _ in self.term]
        essential: list[list[tuple[int, float]]] = [[] for _ in self.term]
        self.least = np.zeros(n)  # what essential terms must bring
        for d, seg in enumerate(segments):
            length = sum(seg.values())
            raw = {t: np.log(1 + (total_n - df[t] + 0.5) / (df[t] + 0.5)) * f * (s.k1 + 1) / (f + s.k1 * (1 - s.b + s.b * length / mean)) for t, f in seg.items()}
            total, light = sum(raw.values()), 0.0
            for t in sorted(raw, key=lambda t: (raw[t], len(t), t)):  # of equal weight, the longer word is the rarer in running text
                light += raw[t] / total
                lists[self.term[t]].append((d, raw[t] / total))
                if light > s.light:
                    essential[self.term[t]].append((d, raw[t] / total))
                else:
                    self.least[d] = s.threshold - light
            self.least[d] = self.least[d] or s.threshold
        # Sparse tables by term: postings, by segment, and those of essential terms.
        self.start = np.cumsum([0, *map(len, lists)])
        self.e_start = np.cumsum([0, *map(len, essential)])
        self.e_seg = np.array([d for x in essential for d, _ in x], np.int64)
        self.e_impact = np.array([v for x in essential for _, v in x])
        self.seg = np.array([d for x in lists for d, _ in x], np.int64)
        self.impact = np.array([v for x in lists for _, v in x])
        tops: list[dict[int, float]] = [{} for _ in lists]  # by term, the largest impact in each block of segments
        for top, x in zip(tops, lists, strict=True):
            for d, v in x:
                top[d // s.block] = max(top.get(d // s.block, 0.0), v)
        self.bound = np.array([max(top.values()) for top in tops])
        # Term and segment, and term and block, as one ascending number: a list is searched from any place in one step.
        self.blocks = -(-n // s.block)
        self.place = np.repeat(np.arange(len(lists)), np.diff(self.start)) * n + self.seg
        self.top_place = np.array([k * self.blocks + b for k, top in enumerate(tops) for b in top], np.int64)
        self.top = np.array([v for top in tops for v in top.values()])
        self.n = n

    @staticmethod
    def _gather(start: np.ndarray, rows: np.ndarray) -> np.ndarray:
        a, n = start[rows], start[rows + 1] - start[rows]
        return np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())

    def search(self, found: np.ndarray, pivots: np.ndarray | None = None) -> list[tuple[int, float]]:
        """(segment, score) of all segments at or over the threshold, for the distinct terms ``found``.

        ``pivots`` are the segments, ascending, that a pass before has left; all, if None.
        """
        n, least, out = self.n, self.s.threshold - 1e-9, []
        pivots = np.arange(n) if pivots is None else pivots
        ends, bounds = self.start[found + 1], self.bound[found]
        at, segment = self.start[found], np.full(len(found), -1)  # the cursors

        to = 0
        while (k := int(np.searchsorted(pivots, to))) < len(pivots):
            to = int(pivots[k])
            behind = segment < to
            at[behind] = np.searchsorted(self.place, found[behind] * n + to)
            segment[behind] = np.where(at[behind] < ends[behind], self.seg[np.minimum(at[behind], len(self.seg) - 1)], n)
            order = np.argsort(segment, kind="stable")
            pivot = int(np.searchsorted(np.cumsum(bounds[order]), least))
            if pivot == len(order) or (d := int(segment[order[pivot]])) == n:
                break
            upto = segment <= d
            block = d // self.s.block
            own = found[upto] * self.blocks + block
            top = np.minimum(np.searchsorted(self.top_place, own), len(self.top) - 1)
            if self.top[top[self.top_place[top] == own]].sum() < least:  # no segment of the block; up to the next cursor, at most
                to = min((block + 1) * self.s.block, int(segment[~upto].min(initial=n)))
            elif int(segment[order[0]]) < d:
                to = d
            else:
                score = float(self.impact[at[upto]].sum())
                if score >= least:
                    out.append((d, score))
                to = d + 1
        return out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self.may_be[hashes >> np.uint64(44)])
        k = np.minimum(np.searchsorted(self.term_hashes, hashes[at]), len(self.term_hashes) - 1)
        same = self.term_hashes[k] == hashes[at] if len(at) else np.empty(0, bool)
        out[at[same]] = self.term_order[k[same]]
        return out

    def candidates(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """Passages (document, start) with the segments that essential terms may bring over the threshold; ``ends`` are the documents' ends in ``ids``."""
        s, none = self.s, []
        at = np.flatnonzero(ids >= 0)
        at = at[self.e_start[ids[at] + 1] > self.e_start[ids[at]]] if len(self.term) else at
        if not len(at):
            return none
        lengths = np.diff(ends, prepend=0)
        passages = (np.maximum(1, lengths - s.passage + s.stride) + s.stride - 1) // s.stride
        base = np.cumsum(passages) - passages
        doc = np.searchsorted(ends, at, "right")
        last_of_word = (at - (ends - lengths)[doc]) // s.stride
        # A word lies in passage // stride passages, less at the ends of a document.
        each = -(-s.passage // s.stride)
        word = np.repeat(np.arange(len(at)), each)
        j = last_of_word[word] - np.tile(np.arange(each), len(at))
        ok = (j >= 0) & (j < passages[doc[word]])
        word, j = word[ok], j[ok] + base[doc[word[ok]]]
        k = self._gather(self.e_start, ids[at[word]])
        n = self.e_start[ids[at[word]] + 1] - self.e_start[ids[at[word]]]
        key = np.repeat(j, n) * self.n + self.e_seg[k]
        if passages.sum() * self.n <= 1 << 22:
            total = np.bincount(key, self.e_impact[k])
            found = np.flatnonzero(total)
            total = total[found]
        else:
            found, inverse = np.unique(key, return_inverse=True)
            total = np.bincount(inverse, self.e_impact[k])
        chosen = found[total >= self.least[found % self.n] - 1e-9]
        of, first = np.unique(chosen // self.n, return_index=True)
        d = np.searchsorted(np.cumsum(passages), of, "right")
        return list(zip(d.tolist(), ((of - base[d]) * s.stride).tolist(), np.split(chosen % self.n, first[1:]), strict=True)) if len(of) else none

    def short_items(self, hashes: np.ndarray, ends: np.ndarray, words_of: Callable[[int], list[str]]) -> Iterator[tuple[int, int]]:
        """(document, entry) of the short items whose words follow each other in a document."""
        for length, (keys, of) in self.short.items():
            key = windows(hashes, length)
            at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key)
            doc = np.searchsorted(ends, at, "right")
            inside = at + length <= ends[doc]
            at, doc = at[inside], doc[inside]
            done: set[tuple[int, int]] = set()
            for d, i, k in zip(doc.tolist(), at.tolist(), key[at].tolist(), strict=True):
                if (d, k) not in done:
                    start = i - (int(ends[d - 1]) if d else 0)
                    entries = of.get(tuple(words_of(d)[start : start + length]), [])
                    done |= {(d, k)} if entries else set()
                    yield from ((d, e) for e in entries)

    def check(self, texts: pa.Array) -> list[tuple[list[int], float]]:
        """For each text, the items that it holds and the best score of a verified one."""
        s, t = self.s, tokenize(texts, WORDS_ONLY, lower=True)
        ids, ends = self.ids(t.hashes), t.ends
        best: list[dict[int, float]] = [{} for _ in range(len(texts))]
        words: dict[int, list[str]] = {}

        def words_of(doc: int) -> list[str]:
            nonlocal words
            if doc not in words:
                words = {doc: terms(texts[doc].as_py())}
            return words[doc]

        for doc, entry in self.short_items(t.hashes, ends, words_of):
            best[doc][entry] = 1.0
        for doc, at, pivots in self.candidates(ids, ends):
            start, own = (ends[doc - 1] if doc else 0) + at, best[doc]
            found = ids[start : min(start + s.passage, ends[doc])]
            scores: dict[int, float] = {}
            for d, score in self.search(np.unique(found[found >= 0]), pivots):
                scores[self.entry[d]] = max(score, scores.get(self.entry[d], 0.0))
            for entry, score in scores.items():
                w = words_of(doc)
                q, a = self.parts[entry]
                around = w[max(0, at - len(q) - len(a)) : at + s.passage + len(q) + len(a)]
                if entry in own or (overlap(q, around, s.gram) >= s.overlap and overlap(a, around, s.gram) >= s.overlap):
                    own[entry] = max(score, own.get(entry, 0.0))
        return [(sorted({self.id[e] for e in x}), max(x.values(), default=0.0)) for x in best]


def count_terms(items: DataFrame, s: Settings) -> DataFrame:
    """(term, df, words): the segments that hold each term; under the null term all segments and their words."""

    def run(batches):
        for batch in pieces(batches):
            segments = [seg for text in batch.column("text").to_pylist() for seg in segments_of(terms(text), s)]
            df = Counter(t for seg in segments for t in seg)
            words = sum(sum(seg.values()) for seg in segments)
            yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.string()), pa.array([len(segments), *df.values()], pa.int64()), pa.array([words, *[0] * len(df)], pa.int64())], ["term", "df", "words"])

    counts = items.select("text").mapInArrow(run, "term string, df long, words long")
    return written(counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "terms")


def statistics_for(part: list[tuple[int, str]], counts: DataFrame, s: Settings) -> Statistics:
    """Of all items, as to the terms of a part of them."""
    n, words = counts.filter("term is null").select("df", "words").first()
    own = counts.sparkSession.createDataFrame(pa.table({"term": pa.array(sorted({t for _, text in part for seg in segments_of(terms(text), s) for t in seg}), pa.string())}))
    return Statistics(n, words / max(n, 1), dict(counts.join(own, "term", "left_semi").select("term", "df").collect()))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", s: Settings = Settings()
) -> DataFrame:
    """``docs`` with contaminated boolean, items array<long> (sorted) and best_score double.

    * Every passage of every whole text is a query.  A null or empty text is clean.
    * Items without an id, with a null text or without words are not searched for.  Items of
      one id are all searched; items of one text are one item, under their smallest id.
    * Items of fewer than ``s.min_words`` words contaminate where all their words follow each
      other in a text, with score 1.
    * An empty benchmark leaves all rows clean.  Repeated rows get equal results.
    * Columns of the three names are replaced; all others stay, whatever their names.

    The index is broadcast; it is built from ``s.index_bytes`` of item text at most.  A larger
    benchmark is split by a hash of the text and searched in as many turns over the documents, by
    the statistics of all its segments, so that the results are those of one index but for the order of
    sums in a score.
    """
    spark = docs.sparkSession
    limit_arrow_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).dropna()
    items = written(items.groupBy("text").agg(F.min("id").alias("id")).select("id", "text"), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    turns = max(1, -(-size // s.index_bytes))
    counts = count_terms(items, s) if turns > 1 else None
    new = {"contaminated": "boolean", "items": "array<bigint>", "best_score": "double"}
    out = docs.drop(*new).select("*", F.lit(False).alias("contaminated"), F.array().cast("array<bigint>").alias("items"), F.lit(0.0).alias("best_score"))
    for turn in range(turns):
        part = items if turns == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(turns)) == turn)
        part = [(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()]
        shared = spark.sparkContext.broadcast(Index(part, s, statistics_for(part, counts, s) if turns > 1 else None))

        def run(batches, shared=shared):
            index = shared.value
            for batch in pieces(batches, text_col):
                items, best = batch.column("items").to_pylist(), batch.column("best_score").to_pylist()
                for k, (found, score) in enumerate(index.check(batch.column(text_col))):
                    items[k], best[k] = sorted({*items[k], *found}), max(best[k], score)
                cols = dict(zip(batch.schema.names, batch.columns, strict=True))
                cols |= {"contaminated": pa.array([bool(x) for x in items]), "items": pa.array(items, pa.list_(pa.int64())), "best_score": pa.array(best, pa.float64())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        if turn:
            out = written(out, "decontaminate")
        out = out.mapInArrow(run, out.schema)
    return out
