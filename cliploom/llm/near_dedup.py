"""Near-duplicate classes by ProbMinHash signatures, banding and verification.

A document is the weighted set of its word shingles; a shingle weighs as often as it occurs.  The
similarity of two documents is their probability Jaccard

    J(x, y) = sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i),

which for documents without repeated shingles is the Jaccard similarity of the shingle sets.

ProbMinHash: every shingle is a Poisson process of rate its weight, with arrivals and slots drawn
from a hash of the shingle; a slot of the signature keeps the shingle that arrives first.  Two
signatures agree in a slot with probability J.  A shingle whose next arrival comes after the last
first arrival of all slots is done (early termination), so that long texts cost hardly more than a
hash for each shingle.

Candidates share a band of slots; a pair of similarity 0.8 shares none with probability 0.0004.  All
are verified exactly on the whole texts, except pairs whose signatures agree in less than 0.6 of the
slots, five standard deviations under the threshold: one pair of similarity 0.8 in 700,000 would.

Copies, and groups of near copies, of any size: equal texts are one node from the start.  Within a
bucket of up to ``small`` nodes all pairs are candidates.  In a larger bucket all members are first
verified against a pivot, the member that shares most buckets with others, which joins nearly all
of a group of near copies at about one comparison a member.  What then is open are pairs of members
in different components.  They are compared in blocks: members outside the bucket's largest
component against all members, ``block`` by ``block``, in a group of bounded size that gives back
only links which join two components.  The end is that of comparing all candidate pairs: of any
pair never compared, both already were in one component.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import limit_arrow_batches, written
from .words import MULTIPLIERS, Tokens, mixed, pieces, tokenize, windows


@dataclass(frozen=True)
class Settings:
    shingle: int = 5  #: words
    similarity: float = 0.8
    bands: int = 20
    rows: int = 5  #: slots of a band; 20 bands of 5 find a pair of similarity 0.8 with probability 0.9996
    small: int = 32  #: a bucket of up to so many members is compared pair by pair
    block: int = 128  #: members on either side of a block of a larger bucket
    broadcast_ids: int = 1_000_000  #: up to so many ids (8 bytes each) go to the executors to pick texts; more are joined

    @property
    def slots(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreement(self) -> float:
        return self.similarity - 5 * (self.similarity * (1 - self.similarity) / self.slots) ** 0.5


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text a hash of each shingle, repeats included; a text of fewer than k words is one shingle, one without words has none."""
    t: Tokens = tokenize(texts, lower=True)
    whole, n = windows(t.hashes, k), t.lengths
    starts = t.ends - n
    return [whole[a : a + m - k + 1] if m >= k else windows(t.hashes[a : a + m], max(m, 1)) for a, m in zip(starts.tolist(), n.tolist(), strict=True)]


def weighted(texts: pa.Array, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, sorted, and their counts."""
    return [np.unique(p, return_counts=True) for p in shingles(texts, k)]


def signatures(parts: list[np.ndarray], slots: int) -> np.ndarray:
    """A row of ``slots`` shingles for each part."""
    n = len(parts)
    doc = np.repeat(np.arange(n), [len(p) for p in parts])
    # Equal shingles of a document are counted; 40 bits tell them apart within one.
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (np.concatenate([*parts, np.empty(0, np.uint64)]) >> np.uint64(24)))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    weight = np.diff(np.append(new, len(key))).astype(np.float64)
    doc = (key[new] >> np.uint64(40)).astype(np.int64)
    item = mixed(key[new] & np.uint64((1 << 40) - 1))
    first, out = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)
    at, time, step = np.arange(len(item)), np.zeros(len(item)), 0
    while len(at):
        step += 1
        r = mixed(item[at] + np.full(1, step, np.uint64) * MULTIPLIERS[0])
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight[at]
        slot = doc[at] * slots + (mixed(r ^ MULTIPLIERS[1]) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = time == first[slot]
        out[slot[won]] = item[at[won]]
        alive = time < first.reshape(n, slots).max(1)[doc[at]]
        at, time = at[alive], time[alive]
    return out.reshape(n, slots)


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets, each given as sorted distinct items and their weights."""
    items = np.union1d(x[0], y[0])
    a, b = np.zeros(len(items)), np.zeros(len(items))
    a[np.searchsorted(items, x[0])] = x[1]
    b[np.searchsorted(items, y[0])] = y[1]
    shared = (a > 0) & (b > 0)
    if not shared.any():
        return 0.0
    ratio = np.divide(b, a, out=np.full(len(a), np.inf), where=a > 0)
    order = np.argsort(ratio, kind="stable")
    r, sa, sb = ratio[order], np.cumsum(a[order]), np.cumsum(b[order])
    # For j of a ratio up to i's the larger term is a_j / a_i, else b_j / b_i.
    upto = np.searchsorted(r, ratio[shared], "right") - 1
    return float((1 / (sa[upto] / a[shared] + (sb[-1] - sb[upto]) / b[shared])).sum())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, class_id, is_representative), one row per input row.

    Documents are linked where the similarity of their texts is ``s.similarity`` or more, and
    classes are the connected components; class_id is the smallest id in the class.  Equal texts
    are always one class.

    * An id is one document: rows of one id with different texts are all in one class, whatever
      their similarity, as if they were linked.
    * A row with a null text or a null id is a class of its own, with its id for class_id.
    * Texts without words are linked only to equal texts.  A text shorter than a shingle is one
      shingle.  Repeated rows share a class; is_representative is true for all rows of that id.
    * An empty table gives an empty result; columns other than the two named are not read.
    """
    spark = docs.sparkSession
    limit_arrow_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    whole = src.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).withColumn("key", F.unhex(F.md5("text")))

    def sign(batches):
        for batch in pieces(batches):
            parts = shingles(batch.column("text"), s.shingle)
            sig = signatures(parts, s.slots)
            lines = sig.reshape(len(parts), s.bands, s.rows)
            band = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64), (len(parts), s.bands)).copy()
            for j in range(s.rows):
                band = mixed(band * MULTIPLIERS[0] + lines[:, :, j])
            short = (sig & np.uint64(255)).astype(np.uint8)
            has = [bool(len(p)) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("key"),
                    pa.array([b.view(np.int64) if ok else [] for b, ok in zip(band, has, strict=True)], pa.list_(pa.int64())),
                    pa.array([x.tobytes() for x in short], pa.binary()),
                ],
                ["id", "key", "bands", "sig"],
            )

    signed = written(whole.mapInArrow(sign, "id long, key binary, bands array<bigint>, sig binary"), "signed")
    # One node for each text.
    nodes = written(signed.groupBy("key").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    places = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = written(places.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("bucket", "n"), "buckets")
    members = written(places.join(shared, "bucket"), "members")
    links = _verified(_agreeing(_candidates(members, s), nodes, s), whole, s)
    labels = connected_components(links)
    late = _between_components(members, labels, nodes, whole, s)
    if late.take(1):
        labels = connected_components(links.unionByName(late))
    classes = nodes.select("key", F.col("id").alias("node")).join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("class_id"))
    classes = written(classes, "classes")
    found = signed.select("id", "key").join(classes, "key").select("id", "class_id")
    rest = src.filter(F.col("id").isNull() | F.col("text").isNull()).select("id", F.col("id").alias("class_id"))
    return found.unionByName(rest).select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("is_representative"))


def _candidates(members: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b): all of small buckets, and of the others each member with the pivot."""
    small = members.filter(F.col("n") <= s.small)
    pairs = small.select("bucket", F.col("id").alias("a")).join(small.select("bucket", F.col("id").alias("b")), "bucket").filter("a < b").select("a", "b")
    large = members.filter(F.col("n") > s.small)
    ties = written(members.groupBy("id").agg(F.sum("n").alias("ties")), "ties")
    pivots = large.join(ties, "id").groupBy("bucket").agg(F.max(F.struct("ties", (-F.col("id")).alias("minus"))).alias("p"))
    pivots = written(pivots.select("bucket", (-F.col("p.minus")).alias("pivot")), "pivots")
    compared = large.join(pivots, "bucket").filter("id <> pivot")
    return written(pairs.unionByName(compared.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))).distinct(), "pairs")


def _agreeing(pairs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Pairs whose signatures don't rule out the similarity."""
    sig = nodes.select("id", "sig")
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, s.slots) for c in ("sa", "sb"))
            ok = (x == y).mean(1) >= s.least_agreement
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return written(both.mapInArrow(run, "a long, b long"), "agreeing")


def _texts(ids: DataFrame, whole: DataFrame, s: Settings) -> DataFrame:
    """(id, text) of the nodes ``ids``."""
    ids = written(ids.distinct(), "ids")
    picked = F.broadcast(ids) if ids.count() <= s.broadcast_ids else ids
    return whole.join(picked, "id").groupBy("id", "key").agg(F.first("text").alias("text")).select("id", "text")


def _verified(pairs: DataFrame, whole: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b), a < b: pairs whose whole texts have the similarity."""
    texts = written(_texts(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), whole, s), "texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def run(batches):
        for batch in batches:
            for part in pieces(pieces([batch], "x"), "y"):
                x, y = weighted(part.column("x"), s.shingle), weighted(part.column("y"), s.shingle)
                ok = [probability_jaccard(u, v) >= s.similarity - 1e-12 for u, v in zip(x, y, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return written(both.mapInArrow(run, "a long, b long").distinct(), "verified")


def _between_components(members: DataFrame, labels: DataFrame, nodes: DataFrame, whole: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) that join components, found among the members of large buckets."""
    large = members.filter(F.col("n") > s.small)
    now = large.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("bucket", "n", "id", F.coalesce("label", "id").alias("component"))
    now = written(now, "large")
    counts = now.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.groupBy("bucket").agg(F.max(F.struct("m", "component")).alias("top"))
    state = now.join(written(counts, "largest"), "bucket").filter(F.col("top.m") < F.col("n"))
    state = state.withColumn("minor", F.col("component") != F.col("top.component"))
    rows, others = F.ceil((F.col("n") - F.col("top.m")) / s.block).cast("int"), F.ceil(F.col("n") / s.block).cast("int")
    held = state.select(
        "bucket", "id", "component", "minor", rows.alias("rows"), others.alias("others"),
        F.pmod(F.xxhash64("id"), rows).cast("int").alias("r"), F.pmod(F.xxhash64("id", F.lit(1)), others).cast("int").alias("o"),
    )
    held = written(held, "held")
    if not held.take(1):
        return held.select(F.col("id").alias("a"), F.col("id").alias("b"))
    texts = _texts(held.select("id"), whole, s).join(nodes.select("id", "bands", "sig"), "id")

    def shingled(batches):
        for batch in pieces(batches):
            w = weighted(batch.column("text"), s.shingle)
            items = [x.tobytes() for x, _ in w]
            count = [c.astype(np.uint32).tobytes() for _, c in w]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("bands"), batch.column("sig"), pa.array(items, pa.binary()), pa.array(count, pa.binary())], ["id", "bands", "sig", "items", "count"])

    payload = written(texts.mapInArrow(shingled, "id long, bands array<bigint>, sig binary, items binary, count binary"), "payload")
    asking = held.filter("minor").select("bucket", "r", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("o"), "id", "component", F.lit(True).alias("asks"))
    asked = held.select("bucket", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), "o", "id", "component", F.lit(False).alias("asks"))
    blocks = asking.unionByName(asked).join(payload, "id")

    def compare(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        found = _links_of_block(table, bucket, s)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return written(blocks.groupBy("bucket", "r", "o").applyInArrow(compare, "a long, b long").distinct(), "late")


def _links_of_block(table: pa.Table, bucket: int, s: Settings) -> list[tuple[int, int]]:
    ids, component = table.column("id").to_numpy(), table.column("component").to_pylist()
    asks = np.array(table.column("asks").to_pylist())
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    # A pair is compared in the first bucket that it shares; every shared bucket would do.
    here = (bands == bucket).argmax(1)
    items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
    count = [np.frombuffer(x, np.uint32) for x in table.column("count").to_pylist()]
    size, plain = np.array([len(x) for x in items]), np.array([int(c.sum()) == len(c) for c in count])
    right = np.flatnonzero(~asks)
    parent: dict[int, int] = {c: c for c in component}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for u in np.flatnonzero(asks):
        roots = np.array([root(component[v]) for v in right])
        ok = (roots != root(component[u])) & ((sig[right] == sig[u]).mean(1) >= s.least_agreement)
        ok &= ~((bands[right, : here[u]] == bands[u, : here[u]]).any(1))
        v = right[ok]
        bound = np.minimum(size[v], size[u]) / np.maximum(size[v], size[u])
        v = v[~(plain[v] & plain[u]) | (bound >= s.similarity - 1e-12)]
        if not len(v):
            continue
        flat = np.concatenate([items[k] for k in v])
        hit = items[u][np.minimum(np.searchsorted(items[u], flat), len(items[u]) - 1)] == flat
        shared = np.add.reduceat(hit, np.cumsum(size[v]) - size[v])
        similar = shared / (size[v] + size[u] - shared)
        for k, j in zip(v.tolist(), similar.tolist(), strict=True):
            if not (plain[k] and plain[u]):
                j = probability_jaccard((items[u], count[u]), (items[k], count[k]))
            if j >= s.similarity - 1e-12 and root(component[k]) != root(component[u]):
                out.append((min(int(ids[u]), int(ids[k])), max(int(ids[u]), int(ids[k]))))
                parent[root(component[k])] = root(component[u])
    return out
