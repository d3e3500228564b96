"""Approximate nearest neighbours by inner product, with balanced posting lists.

Vectors get one more component so that all have one length; the largest inner product then is the
smallest distance.  A sample is cut into clusters of equal size by repeated balanced bisection, one
list for ``list_size`` vectors; a large number of lists is fitted in two levels, the second cell by
cell.  The centroids, brought to the vectors' length, are broadcast (``max_lists`` at most), with a
graph that is searched in memory, best first.  Its links go to the nearest centroids, which mostly
lie in the same cell, and to some drawn at random, which lead from cell to cell.

Every vector goes to the list of its nearest centroid; a vector near a boundary goes to further
lists too, up to ``replicas``, where the centroid is at most ``1 + boundary`` times as far.  A query
reads the lists of its ``least`` nearest centroids, and further ones as long as their distance is at
most ``ratio`` times the nearest one's.  That ratio, and how many lists it can need, are measured
when the index is fitted, by searches of the graph on rows that the lists weren't fitted on (unless
the table is small), so that ``recall`` of their own neighbours would be found: few lists where
vectors have clusters, and, as nothing less finds them, a share of all lists where they have none.

Lists that lie beside each other form a shelf.  A shelf and its queries meet in blocks of bounded
size, so a list that holds a third of all vectors is as many tasks; a block gives back the best of
each query alone.  Of equal vectors only the ``top + 1`` smallest ids are listed: no other can be
among the ``top`` nearest of any query, as ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import limit_arrow_batches, written


@dataclass(frozen=True)
class Settings:
    top: int = 20
    list_size: int = 200  #: vectors of a list to aim at, before replicas
    max_lists: int = 1 << 16  #: bounds what is broadcast: some 24 MB for 64 components; lists are longer beyond it
    sample_of_list: int = 64  #: vectors to fit on, for each list
    cell: int = 256  #: lists that one task fits
    replicas: int = 4
    boundary: float = 0.3
    least: int = 32  #: lists that a query reads in any case
    recall: float = 0.97  #: of neighbours in a sample, to be found in the lists read
    measured: int = 8192  #: vectors of that sample
    asked: int = 256  #: of which so many are queries
    degree: int = 16  #: links of a centroid to the nearest ones
    far: int = 8  #: and to others, drawn at random
    beam: int = 96  #: candidates held while it is searched
    shelf: int = 16  #: lists compared together
    block: int = 16_384  #: vectors of a block
    query_block: int = 2048
    seed: int = 0


@dataclass
class Model:
    centroids: np.ndarray
    graph: np.ndarray  #: neighbours of each centroid
    entries: np.ndarray  #: centroids from which a search starts
    longest: float
    ratio: float = 1.0  #: how much farther than the nearest centroid those of the lists read may be
    probes: int = 1  #: lists read, at most


def widened(x: np.ndarray, longest: float) -> np.ndarray:
    """With the component that brings a listed vector's length to ``longest``."""
    rest = np.sqrt(np.maximum(longest * longest - (x * x).sum(1, keepdims=True), 0.0))
    return np.hstack([x, rest]).astype(np.float32)


def bisect(x: np.ndarray, parts: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Means of ``parts`` (a power of two) clusters of equal size."""
    if parts == 1 or len(x) < 2:
        return [x.mean(0)]
    c = x[rng.choice(len(x), 2, replace=False)]
    half = len(x) // 2
    for _ in range(8):
        order = np.argsort(((x - c[0]) ** 2).sum(1) - ((x - c[1]) ** 2).sum(1), kind="stable")
        c = np.array([x[order[:half]].mean(0), x[order[half:]].mean(0)])
    return bisect(x[order[:half]], parts // 2, rng) + bisect(x[order[half:]], parts // 2, rng)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared, less the length of x, which is the same for a row."""
    return (c * c).sum(1) - 2 * x @ c.T


def centroid_graph(c: np.ndarray, degree: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The nearest centroids of each from ``first`` to ``last``, and a ring through all so that the graph is connected."""
    n, k, at = len(c), min(degree, len(c) - 1), np.arange(len(c))[first:last]
    near = np.empty((len(at), k), np.int32)
    for a in range(0, len(at), 1024):
        d = distances(c[at[a : a + 1024]], c)
        d[np.arange(len(d)), at[a : a + 1024]] = np.inf
        near[a : a + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    ring = np.stack([(at + 1) % n, (at - 1) % n], 1)
    ring[(ring[:, :, None] == near[:, None, :]).any(2)] = -1
    ring[:, 1][ring[:, 0] == ring[:, 1]] = -1
    return np.hstack([near, np.where(ring < 0, at[:, None], ring)]).astype(np.int32)  # each neighbour once; the centroid itself fills up


def with_far_links(near: np.ndarray, far: int, seed: int) -> np.ndarray:
    """``near`` with links of each centroid to ``far`` others at random; each neighbour once, the centroid itself fills up."""
    n = len(near)
    out = np.sort(np.hstack([near, np.random.default_rng(seed).integers(0, n, (n, far), np.int32)]), axis=1)
    again = np.hstack([np.zeros((n, 1), bool), out[:, 1:] == out[:, :-1]])
    return np.where(again, np.arange(n, dtype=np.int32)[:, None], out)


def search_graph(m: Model, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of about the k nearest centroids of each row, nearest first: a best-first search of all rows at once."""
    n, lists = len(q), len(m.centroids)
    beam, k = min(max(beam, k), lists), min(k, lists)
    qq, cc = (q * q).sum(1), (m.centroids * m.centroids).sum(1)
    entry = m.entries[np.argsort(qq[:, None] + cc[m.entries] - 2 * q @ m.centroids[m.entries].T, axis=1)[:, :2]]
    ids = np.full((n, beam), -1, np.int64)
    dist, done = np.full((n, beam), np.inf, np.float32), np.zeros((n, beam), bool)
    seen = np.zeros((n, lists), bool)
    rows = np.arange(n)

    def add(new: np.ndarray, r: np.ndarray) -> None:
        fresh = ~seen[r[:, None], new]
        i, j = np.nonzero(fresh)
        at, c = r[i], new[i, j]
        seen[at, c] = True
        d = np.full(new.shape, np.inf, np.float32)
        d[i, j] = qq[at] + cc[c] - 2 * np.einsum("pd,pd->p", m.centroids[c], q[at])
        all_d = np.hstack([dist[r], d])
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        ids[r] = np.take_along_axis(np.hstack([ids[r], new]), keep, 1)
        done[r] = np.take_along_axis(np.hstack([done[r], np.zeros(new.shape, bool)]), keep, 1)
        dist[r] = np.take_along_axis(all_d, keep, 1)

    add(entry, rows)
    live = rows
    while len(live):
        waiting = np.where(done[live], np.inf, dist[live])
        at = waiting.argmin(1)
        go = np.isfinite(waiting[np.arange(len(live)), at])
        live, at = live[go], at[go]
        if not len(live):
            break
        done[live, at] = True
        add(m.graph[ids[live, at]].astype(np.int64), live)
    order = np.argsort(dist, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(dist, order, 1), 0)


def lists_of_vectors(m: Model, x: np.ndarray, s: Settings) -> list[list[int]]:
    ids, d = search_graph(m, x, s.replicas, s.beam // 2)
    d = np.sqrt(d)
    return [row[ok].tolist() for row, ok in zip(ids, np.isfinite(d) & (d <= (1 + s.boundary) * d[:, :1]), strict=True)]


def lists_of_queries(m: Model, q: np.ndarray, s: Settings) -> list[list[int]]:
    probes = max(m.probes, s.least)
    out = []
    for a in range(0, len(q), step := max(1, (1 << 22) // max(probes, s.beam))):  # bounds the search's memory
        ids, d = search_graph(m, q[a : a + step], probes, s.beam)
        d = np.sqrt(d)
        near = (d <= m.ratio * d[:, :1]) | (np.arange(d.shape[1]) < s.least)
        out += [row[ok].tolist() for row, ok in zip(ids, np.isfinite(d) & near, strict=True)]
    return out


def as_query(x: np.ndarray, longest: float) -> np.ndarray:
    """Brought to the listed vectors' length."""
    x = np.hstack([x, np.zeros((len(x), 1))])
    return (x * (longest / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30))).astype(np.float32)


def measured(m: Model, x: np.ndarray, s: Settings) -> Model:
    """``m`` with the ratio and the number of lists that find ``s.recall`` of the neighbours among the rows of ``x``.

    By exact distances first; both grow until a search of the graph finds as many.
    """
    asks = np.random.default_rng(s.seed).permutation(len(x))[: s.asked]
    if len(x) <= s.top or len(m.centroids) <= s.least:
        return m
    score = x[asks] @ x.T
    score[np.arange(len(asks)), asks] = -np.inf
    near = np.argpartition(-score, s.top - 1, axis=1)[:, : s.top]
    need, place = np.unique(near, return_inverse=True)
    lists = lists_of_vectors(m, widened(x[need], m.longest), s)
    lists = np.array([own + own[:1] * (s.replicas - len(own)) for own in lists])[place.reshape(near.shape)]  # query, neighbour, list
    q = as_query(x[asks], m.longest)
    far = np.sqrt(np.maximum((q * q).sum(1, keepdims=True) + distances(q, m.centroids), 0))
    rank = np.empty(far.shape, np.int64)
    np.put_along_axis(rank, np.argsort(far, axis=1, kind="stable"), np.arange(far.shape[1])[None], 1)
    flat = lists.reshape(len(asks), -1)
    ranks, ratios = (np.take_along_axis(v, flat, 1).reshape(lists.shape).min(2) for v in (rank, far / np.maximum(far.min(1, keepdims=True), 1e-30)))
    m.probes, m.ratio = int(np.quantile(ranks, s.recall)) + 1, float(np.quantile(ratios, 0.5 + s.recall / 2))
    while m.probes < len(m.centroids):
        read = np.zeros(far.shape, bool)
        for k, own in enumerate(lists_of_queries(m, q, s)):
            read[k, own] = True
        if np.take_along_axis(read, flat, 1).reshape(lists.shape).any(2).mean() >= s.recall:
            break
        m.probes, m.ratio = min(m.probes + m.probes // 8 + 1, len(m.centroids)), m.ratio * 1.02
    return m


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim, h) of rows that take part: no null, NaN or infinite component and not all zero; equal rows once."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    return rows.select("id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("h")).distinct()


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.array(flat.to_numpy(), np.float64).reshape(len(column), -1)


FOUND = "query_id long, id long, score double"


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``is_query`` marks, the ``s.top`` rows of largest inner product that the lists give, itself left out.

    * Rows with a null id, or a vector that is null, all zero or has a null or non-finite component take no part.
    * Vectors of different dimension have no inner product: each dimension is searched by itself.
      One with up to ``s.block`` rows, if it isn't the most frequent, is searched whole.
    * Nearest first; ties go to the smaller id.  Fewer rows than ``s.top`` give as many as there are.
    * Equal rows count once.  An id with several vectors asks with each and is found by each; it is
      never its own neighbour, and of several scores with another id the largest counts.
    * Scores are exact, in double precision, on the vectors as given.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    limit_arrow_batches(spark)
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    asking = vectors.filter(is_query).select(F.col(id_col).cast("long").alias("id")).distinct()
    queries = written(rows.select("id", "v", "dim").join(asking, "id", "left_semi"), "queries")
    # The smallest ids of equal vectors; first within slices, so that no task sees all copies.
    sliced = Window.partitionBy("h", "v", "slice").orderBy("id")
    listed = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("k", F.row_number().over(sliced)).filter(F.col("k") <= s.top + 1)
    listed = listed.withColumn("k", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).filter(F.col("k") <= s.top + 1)
    listed = written(listed.select("id", "v", "dim"), "distinct-vectors")
    sizes = listed.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"))
    sizes = written(sizes, "dimensions")
    largest = sizes.orderBy(F.desc("n"), "dim").first()
    if largest is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    indexed = {r["dim"]: r for r in sizes.filter(F.col("n") > s.block).collect()} | {largest["dim"]: largest}  # no more than one for s.block rows
    found = _searched_whole(listed.filter(~F.col("dim").isin(*indexed)), queries.filter(~F.col("dim").isin(*indexed)), s)
    for dim, r in indexed.items():
        of_dim = F.col("dim") == dim
        found = found.unionByName(_searched(listed.filter(of_dim).drop("dim"), queries.filter(of_dim).drop("dim"), r["n"], float(r["longest"]), s))
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= s.top).select("query_id", "rank", "id", "score")


def _searched_whole(listed: DataFrame, queries: DataFrame, s: Settings) -> DataFrame:
    """FOUND of dimensions of up to ``s.block`` rows each."""

    def compare(x: pa.Table, q: pa.Table) -> pa.Table:
        return _best(x, q, np.zeros(x.num_rows, np.int64), [[0]] * q.num_rows, s.top)

    return listed.groupBy("dim").cogroup(queries.groupBy("dim")).applyInArrow(compare, FOUND)


def _searched(listed: DataFrame, queries: DataFrame, n: int, longest: float, s: Settings) -> DataFrame:
    """FOUND of vectors of one dimension, by lists."""
    shared = listed.sparkSession.sparkContext.broadcast(fit(listed, n, longest, s))

    def deal(batches):
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                found = lists_of_vectors(m, widened(_matrix(batch.column("v")), m.longest), s)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(found, pa.list_(pa.int32()))], ["id", "v", "lists"])

    def ask(batches):
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                shelves = []
                for lists in lists_of_queries(m, as_query(_matrix(batch.column("v")), m.longest), s):
                    own: dict[int, list[int]] = {}
                    for k in lists:
                        own.setdefault(k // s.shelf, []).append(k)
                    shelves.append([{"shelf": k, "lists": v} for k, v in own.items()])
                kind = pa.list_(pa.struct([("shelf", pa.int32()), ("lists", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(shelves, kind)], ["id", "v", "shelves"])

    dealt = listed.mapInArrow(deal, "id long, v array<double>, lists array<int>").select("id", "v", F.explode("lists").alias("list"))
    dealt = written(dealt.withColumn("shelf", F.floor(F.col("list") / s.shelf).cast("int")), "dealt")
    asked = queries.mapInArrow(ask, "id long, v array<double>, shelves array<struct<shelf: int, lists: array<int>>>")
    asked = written(asked.select("id", "v", F.explode("shelves").alias("s")).select("id", "v", "s.shelf", "s.lists"), "asked")
    # One row for each shelf: s.max_lists / s.shelf at most.
    blocks = dealt.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / s.block).cast("int").alias("vb"))
    blocks = blocks.join(asked.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / s.query_block).cast("int").alias("qb")), "shelf")
    blocks = F.broadcast(written(blocks, "blocks"))
    left = dealt.join(blocks, "shelf").select("shelf", F.pmod(F.xxhash64("id"), F.col("vb")).cast("int").alias("vi"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("qi"), "list", "id", "v")
    right = asked.join(blocks, "shelf").select("shelf", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("vi"), F.pmod(F.xxhash64("id"), F.col("qb")).cast("int").alias("qi"), "lists", "id", "v")

    def compare(x: pa.Table, q: pa.Table) -> pa.Table:
        return _best(x, q, x.column("list").to_numpy(), q.column("lists").to_pylist(), s.top)

    key = ["shelf", "vi", "qi"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, FOUND)


def _best(x: pa.Table, q: pa.Table, list_of: np.ndarray, lists: list[list[int]], top: int) -> pa.Table:
    """FOUND: of each query the ``top`` best of its lists' vectors, by exact score, then id.

    A product of matrices gives scores that may be off by rounding.  All rows are kept whose rough
    score, with a margin for it, reaches what surely are ``top`` better ones; these are scored exactly.
    """
    empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not x.num_rows or not q.num_rows:
        return empty
    xi, qi, xv, qv = x.column("id").to_numpy(), q.column("id").to_numpy(), _matrix(x.column("v")), _matrix(q.column("v"))
    margin = 1e-12 * xv.shape[1] * np.linalg.norm(qv, axis=1) * np.linalg.norm(xv, axis=1).max()
    bar = np.full(len(qi), -np.inf)  # of each query: so many rows are known to score as much
    askers: dict[int, list[int]] = {}
    for k, own in enumerate(lists):
        for one in own:
            askers.setdefault(one, []).append(k)
    order = np.argsort(list_of, kind="stable")
    names, first = np.unique(list_of[order], return_index=True)
    rows_of = dict(zip(names.tolist(), np.split(order, first[1:]), strict=True))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for one in sorted(askers.keys() & rows_of.keys()):
        rows = rows_of[one]
        for a in range(0, len(askers[one]), 512):
            asks = np.array(askers[one][a : a + 512])
            rough = qv[asks] @ xv[rows].T
            if len(rows) > top and len(np.unique(xi[rows])) == len(rows):  # the query itself may be among them
                bar[asks] = np.maximum(bar[asks], np.partition(rough, len(rows) - top - 1, axis=1)[:, len(rows) - top - 1] - 2 * margin[asks])
            i, j = np.nonzero(rough >= bar[asks][:, None])
            held.append((asks[i], rows[j], rough[i, j]))
    if not held:
        return empty
    a, b, rough = (np.concatenate(c) for c in zip(*held, strict=True))
    ok = (rough >= bar[a]) & (xi[b] != qi[a])
    a, b = a[ok], b[ok]
    score = np.empty(len(a))
    for k in range(0, len(a), 1 << 16):
        score[k : k + (1 << 16)] = (xv[b[k : k + (1 << 16)]] * qv[a[k : k + (1 << 16)]]).sum(1)  # the same sum for equal vectors, whatever the block
    order = np.lexsort((xi[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    # Of each other id the best: a vector may be on several lists, and an id may have several vectors.
    number = np.unique(xi, return_inverse=True)[1]
    first = np.sort(np.unique(a * len(xi) + number[b], return_index=True)[1])
    a, b, score = a[first], b[first], score[first]
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))[: len(a)]
    keep = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) < top
    return pa.table({"query_id": pa.array(qi[a[keep]], pa.int64()), "id": pa.array(xi[b[keep]], pa.int64()), "score": pa.array(score[keep], pa.float64())})


def fit(listed: DataFrame, n: int, longest: float, s: Settings) -> Model:
    """On rows whose seeded hash lies under a threshold, ``s.sample_of_list`` for each list, about.

    One task cuts a part of the sample into cells; if there are several, each cell's sample is cut
    into lists by a task of its own.
    """
    spark = listed.sparkSession
    lists = 1 << (max(1, min(s.max_lists, n // s.list_size)).bit_length() - 1)
    cells = max(1, lists // s.cell)

    def sample(rows: int, last: bool = False) -> DataFrame:
        upto = min(2**63 - 1, int(-(2**63) + min(1.0, rows / max(n, 1)) * 2**64))
        key = F.xxhash64(F.lit(s.seed), "id")
        return listed.filter((F.bitwise_not(key) if last else key) <= upto).select("id", "v")

    def cut(rows: pa.Table, parts: int) -> list[np.ndarray]:
        x = widened(_matrix(rows.column("v")), longest)[np.argsort(rows.column("id").to_numpy(), kind="stable")]
        return [c.astype(np.float32) for c in bisect(x, parts, np.random.default_rng(s.seed))]

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            for c in cut(pa.Table.from_batches(held), lists if cells == 1 else cells):
                yield pa.RecordBatch.from_pydict({"c": [c.tobytes()]})

    found = sample(min(lists, s.cell) * s.sample_of_list).repartition(1).mapInArrow(run, "c binary").collect()  # s.cell centroids, or max_lists / cell
    if not found:  # the hash left no row of a very small table
        found = [{"c": widened(np.array([listed.first()["v"]]), longest).tobytes()}]
    c = np.array([np.frombuffer(r["c"], np.float32) for r in found])
    if cells > 1:
        tops = spark.sparkContext.broadcast(c)

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    cell = distances(widened(_matrix(batch.column("v")), longest), tops.value).argmin(1)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

        def cut_cell(rows: pa.Table) -> pa.Table:
            own = cut(rows, lists // cells)
            return pa.table({"cell": pa.array([rows.column("cell")[0].as_py()] * len(own), pa.int32()), "k": pa.array(range(len(own)), pa.int32()), "c": pa.array([x.tobytes() for x in own], pa.binary())})

        placed = sample(lists * s.sample_of_list).mapInArrow(place, "id long, v array<double>, cell int")
        found = written(placed.groupBy("cell").applyInArrow(cut_cell, "cell int, k int, c binary"), "centroids").orderBy("cell", "k").collect()  # s.max_lists centroids at most
        c = np.array([np.frombuffer(r["c"], np.float32) for r in found])
    c = c * (longest / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)).astype(np.float32)
    entries = np.random.default_rng(s.seed).permutation(len(c))[: max(64, int(len(c) ** 0.5))]
    m = Model(c, with_far_links(_graph(spark, c, s), s.far, s.seed), entries, longest)
    if len(c) <= s.least:
        return m
    shared = spark.sparkContext.broadcast(m)

    def measure(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            out = measured(shared.value, _matrix(rows.column("v"))[np.argsort(rows.column("id").to_numpy(), kind="stable")], s)
            yield pa.RecordBatch.from_pydict({"probes": [out.probes], "ratio": [out.ratio]})

    for r in sample(s.measured, last=True).repartition(1).mapInArrow(measure, "probes long, ratio double").collect():
        m.probes, m.ratio = r["probes"], r["ratio"]
    return m


def _graph(spark: SparkSession, c: np.ndarray, s: Settings) -> np.ndarray:
    """centroid_graph, by executors if there are many centroids."""
    step = 4096
    if len(c) <= step:
        return centroid_graph(c, s.degree)
    shared = spark.sparkContext.broadcast(c)

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_pydict({"k": [k], "rows": [centroid_graph(shared.value, s.degree, k * step, (k + 1) * step).tobytes()]})

    parts = -(-len(c) // step)
    rows = spark.range(0, parts, 1, parts).mapInArrow(run, "k long, rows binary").orderBy("k").collect()  # a few numbers for each centroid
    return np.vstack([np.frombuffer(r["rows"], np.int32).reshape(-1, min(s.degree, len(c) - 1) + 2) for r in rows])
