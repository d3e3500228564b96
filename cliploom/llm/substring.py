"""Exact substring dedup behind a count-min prefilter.

Words are runs of characters other than ASCII white space, as they stand.  A window is ``length``
consecutive words of one document.  A word goes if it is covered by a window whose word sequence
also starts in a document of smaller id.

Texts are packed into chunks of bounded size first, compressed, in a table that all passes read.

Pass 1 counts windows.  Each chunk has a count-min sketch of its own; it is sparse, so what is sent
of it is the sorted places of its counters, cut by ranges of places.  A range's task adds up the
sketches of all chunks, saturating, and answers each chunk with a bit for each of its counters: is
the sum two or more.  An estimate is never too low.

Pass 2 groups exactly, by 128-bit hash, only windows that are estimated to occur twice or more; none
is lost.  A chunk sends each of these once, with the smallest id that has it there, so however often
a window occurs, its group has a row for a chunk at most.  A group's task answers with a bit for
each: does an earlier document have it.  Pass 3 removes the words.

Nothing goes to the driver and no part of the sketch is broadcast.  Every pass reads the texts once,
whatever their number; what is sent for a window grows as the logarithm of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import limit_arrow_batches, written
from .words import MULTIPLIERS, mixed, pieces, tokenize, windows

DOC_BITS = 18  #: a chunk has fewer documents than this many bits number


@dataclass(frozen=True)
class Settings:
    length: int = 13  #: words of a window
    depth: int = 2  #: rows of the sketch
    cells_per_window: float = 3.0  #: of a row, for each window expected; up to twice as many, to be a power of two
    range_cells: int = 1 << 24  #: cells that one task adds up; a byte each
    group_windows: int = 1 << 20  #: windows of the corpus for each task of the exact grouping
    chunk_bytes: int = 8 << 20  #: of text; a longer text is a chunk of its own
    chunk_rows: int = 1 << 17
    bytes_per_word: float = 5.0  #: to size the sketch; wrong guesses cost speed only
    broadcast_keys: int = 1_000_000  #: up to so many keys of repeated texts (24 bytes each) go to all executors; more are joined

    def __post_init__(self) -> None:
        if self.chunk_rows >= 1 << DOC_BITS:
            raise ValueError(f"chunk_rows must be under {1 << DOC_BITS}")


@dataclass(frozen=True)
class Shape:
    """Of the sketch, and of the exact grouping."""

    width: int  #: cells of a row, a power of two
    range_cells: int
    group_bits: int

    @property
    def ranges(self) -> int:
        return self.width // self.range_cells

    @classmethod
    def for_windows(cls, n: int, s: Settings) -> Shape:
        width = 1 << max(16, int(n * s.cells_per_window).bit_length())
        return cls(width, min(width, s.range_cells), max(0, (n // s.group_windows).bit_length()))


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte of their places, compressed."""
    steps = np.diff(numbers.astype(np.int64), prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.compress(np.ascontiguousarray(steps.T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _chunks(docs: DataFrame, s: Settings) -> DataFrame:
    """(chunk, bytes, data): documents (id, text), packed as they lie."""

    def pack(batches):
        first, number, held, size, rows = TaskContext.get().partitionId() << 32, 0, [], 0, 0

        def chunk() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([first + number], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "bytes", "data"])

        few = (b.slice(k, s.chunk_rows) for b in batches for k in range(0, b.num_rows, s.chunk_rows))
        for batch in pieces(few, size=min(s.chunk_bytes, 1_000_000)):
            more = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if held and (size + more > s.chunk_bytes or rows + batch.num_rows > s.chunk_rows):
                yield chunk()
                number, held, size, rows = number + 1, [], 0, 0
            held.append(batch)
            size, rows = size + more, rows + batch.num_rows
        if held:
            yield chunk()

    return docs.mapInArrow(pack, "chunk long, bytes long, data binary")


def _documents(data: bytes) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(data)


@dataclass
class Windows:
    """Of a chunk."""

    at: np.ndarray  #: words before each, in the whole chunk
    doc: np.ndarray
    ids: np.ndarray  #: of the documents
    hashes: list[np.ndarray]  #: one or two of 64 bits


def _windows(data: bytes, s: Settings, n_hashes: int) -> Windows:
    at, doc, ids, hashes, words, docs = [], [], [], [[] for _ in range(n_hashes)], 0, 0
    for batch in _documents(data):
        t = tokenize(batch.column("text"))
        n = max(0, len(t.hashes) - s.length + 1)
        here = np.flatnonzero(t.left()[:n] >= s.length)
        at.append(here + words), doc.append(np.searchsorted(t.ends, here, "right") + docs), ids.append(batch.column("id").to_numpy())
        for out, m in zip(hashes, MULTIPLIERS, strict=False):
            out.append(windows(t.hashes, s.length, m)[here])
        words, docs = words + len(t.hashes), docs + batch.num_rows
    return Windows(np.concatenate(at), np.concatenate(doc), np.concatenate(ids), [np.concatenate(h) for h in hashes])


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return mixed(hashes * MULTIPLIERS[1] + np.uint64(row + 1)) & np.uint64(width - 1)


def _counters(cells: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's sketch: its places, ascending, and which count two documents or more.  A document counts once in a place."""
    key = np.sort((cells << np.uint64(DOC_BITS)) | doc.astype(np.uint64))
    place = key[np.append(True, key[1:] != key[:-1])] >> np.uint64(DOC_BITS) if len(key) else key
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.empty(0, np.int64)
    return place[first].astype(np.int64), np.diff(np.append(first, len(place))) > 1


def _sketches(chunks: DataFrame, shape: Shape, s: Settings) -> DataFrame:
    """(chunk, part, data): the places that each chunk counts in each range of each row."""

    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                w = _windows(data.as_py(), s, 1)
                for row in range(s.depth):
                    places, _ = _counters(_cells(w.hashes[0], row, shape.width), w.doc)
                    cuts = np.searchsorted(places, np.arange(shape.ranges + 1) * shape.range_cells)
                    used = np.flatnonzero(np.diff(cuts))
                    if len(used):
                        packed = [_packed(places[cuts[k] : cuts[k + 1]] - k * shape.range_cells) for k in used.tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), number)), pa.array((used + row * shape.ranges).astype(np.int32)), pa.array(packed, pa.binary())], ["chunk", "part", "data"])

    return chunks.select("chunk", "data").mapInArrow(run, "chunk long, part int, data binary")


def _added(sketches: DataFrame, shape: Shape) -> DataFrame:
    """(chunk, part, bits): of the places that a chunk counts, those whose sum over all chunks is two or more."""

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros(shape.range_cells, np.uint8)
        places = [_unpacked(x.as_py()) for x in table.column("data")]
        for p in places:
            sums[p] = np.minimum(sums[p] + 1, 2)
        bits = [sums[p] > 1 for p in places]
        some = [bool(b.any()) for b in bits]
        out = table.select(["chunk", "part"]).filter(pa.array(some))
        return out.append_column("bits", pa.array([np.packbits(b).tobytes() for b, ok in zip(bits, some, strict=True) if ok], pa.binary()))

    return sketches.groupBy("part").applyInArrow(add, "chunk long, part int, bits binary")


def _of_chunk(answers: DataFrame, *cols: str) -> DataFrame:
    """One row for each chunk; as many answers as it sent parts."""
    return answers.groupBy("chunk").agg(F.collect_list(F.struct(*cols)).alias("answers"))


def _repeated(w: Windows, answers: list[dict], shape: Shape, s: Settings) -> np.ndarray:
    """Numbers of the windows that are estimated to occur twice or more."""
    found = np.ones(len(w.at), bool)
    for row in range(s.depth):
        cells = _cells(w.hashes[0], row, shape.width)
        places, often = _counters(cells, w.doc)
        for a in answers:
            if a["part"] // shape.ranges == row:
                k = (a["part"] % shape.ranges) * shape.range_cells
                i, j = np.searchsorted(places, (k, k + shape.range_cells))
                often[i:j] |= np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=int(j - i)).astype(bool)
        places, mark = places[often], np.zeros(1 << 22, bool)
        mark[places & ((1 << 22) - 1)] = True
        cells = cells.astype(np.int64)
        near = np.flatnonzero(found & mark[cells & ((1 << 22) - 1)])
        k = np.searchsorted(places, cells[near])
        found[:] = False
        found[near[places[np.minimum(k, len(places) - 1)] == cells[near]]] = True
    return np.flatnonzero(found)


SENT = "chunk long, part int, first int, a binary, b binary, c binary"


def _sent(chunks: DataFrame, added: DataFrame, shape: Shape, s: Settings) -> DataFrame:
    """SENT: a row for each chunk and group of windows (hashes a and b, smallest ids c; ``first`` is their place
    in the chunk's list), and one of part -1 for each chunk: where its windows lie, which of the list each one is,
    and whether an earlier document of the chunk has it."""

    def run(batches):
        for batch in batches:
            for number, data, answers in zip(batch.column("chunk").to_pylist(), batch.column("data"), batch.column("answers").to_pylist(), strict=True):
                w = _windows(data.as_py(), s, 2)
                found = _repeated(w, answers or [], shape, s)
                if not len(found):
                    continue
                h1, h2 = (h[found] for h in w.hashes)
                ids = w.ids[w.doc[found]]
                order = np.lexsort((h2, h1))
                x, y = h1[order], h2[order]
                first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
                least = np.minimum.reduceat(ids[order], first)
                entry = np.empty(len(found), np.int64)
                entry[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(found))))
                x, y = x[first], y[first]
                group = (x >> np.uint64(64 - shape.group_bits)).astype(np.int64) if shape.group_bits else np.zeros(len(x), np.int64)
                cut = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(x)).tolist()
                rows = [(number, -1, len(x), _packed(w.at[found]), zstandard.compress(entry.astype("<u4").tobytes(), 1), np.packbits(ids > least[entry]).tobytes())]
                rows += [(number, int(group[i]), i, x[i:j].tobytes(), y[i:j].tobytes(), least[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["chunk", "part", "first", "a", "b", "c"])

    return chunks.select("chunk", "data").join(_of_chunk(added, "part", "bits"), "chunk", "left").mapInArrow(run, SENT)


def _earlier(sent: DataFrame) -> DataFrame:
    """(chunk, first, n, bits): of the windows that a chunk sent, those that a document of smaller id has."""

    def group(table: pa.Table) -> pa.Table:
        x, y, ids = (np.concatenate([np.frombuffer(v.as_py(), kind) for v in table.column(c)]) for c, kind in (("a", np.uint64), ("b", np.uint64), ("c", np.int64)))
        order = np.lexsort((y, x))
        u, v = x[order], y[order]
        start = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
        later = np.empty(len(x), bool)
        later[order] = ids[order] > np.repeat(np.minimum.reduceat(ids[order], start), np.diff(np.append(start, len(x))))
        n = pc.divide(pc.binary_length(table.column("a")), 8).to_numpy()
        bits = np.split(later, np.cumsum(n)[:-1])
        some = [bool(b.any()) for b in bits]
        out = pa.table({"chunk": table.column("chunk"), "first": table.column("first"), "n": pa.array(n, pa.int32())}).filter(pa.array(some))
        return out.append_column("bits", pa.array([np.packbits(b).tobytes() for b, ok in zip(bits, some, strict=True) if ok], pa.binary()))

    return sent.filter("part >= 0").groupBy("part").applyInArrow(group, "chunk long, first int, n int, bits binary")


KEPT = "id long, n_words long, n_removed long, kept_text string"


def _left_over(ids: pa.Array, words: list[list[bytes]], left: list[list[bytes]]) -> pa.RecordBatch:
    n = [len(w) for w in words]
    lost = [a - len(x) for a, x in zip(n, left, strict=True)]
    kept = pa.array([b" ".join(x) for x in left], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(lost, pa.int64()), kept], ["id", "n_words", "n_removed", "kept_text"])


def _split(texts: pa.Array) -> list[list[bytes]]:
    """Bytes split at ASCII white space alone."""
    return [x.split() if x else [] for x in texts.cast(pa.binary()).to_pylist()]


def _kept(chunks: DataFrame, sent: DataFrame, earlier: DataFrame, s: Settings) -> DataFrame:
    """KEPT of all documents of the chunks."""

    def run(batches):
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("n", "at", "entry", "own", "answers"))
            for data, n, at, entry, own, answers in zip(batch.column("data"), *cols, strict=True):
                gone = np.empty(0, np.int64)
                if n:
                    at, entry = _unpacked(at), np.frombuffer(zstandard.decompress(entry), "<u4")
                    removed = np.zeros(n, bool)
                    for a in answers or []:
                        removed[a["first"] : a["first"] + a["n"]] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"])
                    gone = at[removed[entry] | np.unpackbits(np.frombuffer(own, np.uint8), count=len(at)).astype(bool)]
                before = 0
                for docs in _documents(data.as_py()):
                    words = _split(docs.column("text"))
                    ends = np.cumsum([len(w) for w in words])
                    i, j = np.searchsorted(gone, (before, before + int(ends[-1])))
                    left = words
                    if i < j:
                        mark = np.zeros(int(ends[-1]) + 1, np.int32)
                        np.add.at(mark, gone[i:j] - before, 1)
                        np.add.at(mark, gone[i:j] - before + s.length, -1)
                        ok = np.cumsum(mark)[:-1] == 0
                        left = [w if (k := ok[e - len(w) : e]).all() else [x for x, keep in zip(w, k.tolist(), strict=True) if keep] for w, e in zip(words, ends.tolist(), strict=True)]
                    before += int(ends[-1])
                    yield _left_over(docs.column("id"), words, left)

    lists = sent.filter("part = -1").select("chunk", F.col("first").alias("n"), F.col("a").alias("at"), F.col("b").alias("entry"), F.col("c").alias("own"))
    told = lists.join(_of_chunk(earlier, "first", "n", "bits"), "chunk", "left")
    return chunks.select("chunk", "data").join(told, "chunk", "left").mapInArrow(run, KEPT)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, n_words, n_removed, kept_text), one row per input row; kept words are joined by one space.

    * A null or empty text has no words; a text shorter than a window keeps all of its words.
    * Windows are judged on the input.  Windows repeated within a document, or in rows of one id,
      are not removed for that; rows with a null id keep all their words and remove none elsewhere.
    * Equal rows get equal results.  An empty table gives an empty result.
    * Columns other than the two named are not read.
    """
    limit_arrow_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Rows that copy the whole text of a smaller id lose all their words, if they have a window: they go past the passes.
    whole = src.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).withColumn("key", F.unhex(F.md5("text")))
    firsts = written(whole.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("key", "first"), "firsts")
    marked = whole.join(F.broadcast(firsts) if firsts.count() <= s.broadcast_keys else firsts, "key", "left")
    copied = F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    chunks = written(_chunks(marked.filter(~copied).select("id", "text"), s), "chunks")
    shape = Shape.for_windows(int((chunks.agg(F.sum("bytes")).first()[0] or 0) / s.bytes_per_word), s)
    added = written(_added(_sketches(chunks, shape, s), shape), "added")
    sent = written(_sent(chunks, added, shape, s), "windows")
    found = _kept(chunks, sent, written(_earlier(sent), "earlier"), s)

    def rest(batches):
        for batch in pieces(batches):
            words = _split(batch.column("text"))
            left = [[] if copy and len(w) >= s.length else w for w, copy in zip(words, batch.column("copy").to_pylist(), strict=True)]
            yield _left_over(batch.column("id"), words, left)

    others = marked.filter(copied).select("id", "text", F.lit(True).alias("copy"))
    others = others.unionByName(src.filter(F.col("id").isNull() | F.col("text").isNull()).withColumn("copy", F.lit(False)))
    return found.unionByName(others.mapInArrow(rest, KEPT)).withColumnRenamed("id", id_col)
