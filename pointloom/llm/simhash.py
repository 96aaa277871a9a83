"""SimHash near-duplicates by pivot distance tables.

A fingerprint has 64 bits: a bit is 1 if more than half of the XXH64 hashes (seed 42) of the text's
word shingles have it. Fingerprints at ``radius`` or fewer differing bits link; linked fingerprints
and all documents that carry them form one class.

How links are found, without all pairs and without a cap:

1. Documents with one fingerprint are one node from the start (a partial aggregate, so copies of
   any number cost one row a task).
2. The 64 bits are cut into ``radius + 3`` runs. Two nodes that differ in at most ``radius`` bits
   agree on at least three runs, so each choice of three runs deals nodes to buckets, and every
   link lies inside a bucket.
3. Inside a bucket, distances to the reference fingerprints (pivots) are tabled once. A node is
   compared with those only whose table differs by ``radius`` or less in every column (triangle
   inequality), and survivors are verified by their true distance. Buckets give each node its
   smallest partner of the bucket's component (a star), not pairs.
4. A bucket of more than ``HOT`` nodes is not searched in one task. Its nodes are dealt to all
   fingerprints at ``radius // 2`` bits or less: two of them link exactly if they share such a
   middle, and a middle has at most 2081 nodes at radius 4, whatever the data.
5. Components come from rounds of smallest-neighbour contraction on the node table, each round
   written to the shared folder.

Defined results
    * null text counts as empty; a text without words has fingerprint zero, linked like any other;
    * fewer words than a shingle: one shingle, the whole sequence;
    * null doc_ids are kept as rows, and count only where a class has no other id (component null);
    * repeated rows stay; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common

BITS, SEED = 64, 42
#: Nodes of a bucket that one task searches.
HOT = 20_000
PIVOTS = 48


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Unsigned XXH64 of each shingle, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and just the six white-space bytes
    if not words:
        return np.empty(0, dtype=np.uint64)
    line, size, one = b" ".join(words), min(size, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    return np.fromiter((one(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), dtype=np.uint64, count=n)


def fingerprint(text: str, size: int) -> int:
    """Whether each bit is set in over half of the hashes, counted in runs of bounded length."""
    h = shingle_hashes(text, size)
    if not len(h):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, size: int, out: str = "fp") -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, fp long: the unsigned fingerprint seen as signed). Nothing is shuffled."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", size) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", out])
        common.released()

    common.bounded_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(scan, f"doc_id long, {out} long")


def run_masks(radius: int) -> list[int]:
    """Bit masks of each choice of three out of ``radius + 3`` runs of the 64 bits."""
    edges = np.linspace(0, BITS, radius + 4).round().astype(int).tolist()
    runs = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(runs, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivots(words: int = 1, count: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints of ``words`` times 64 bits: fixed, the same in every task."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, size=(count, words), dtype=np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits along the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def pivot_table(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Distance of each fingerprint to each reference, one row a reference."""
    return np.stack([distance(prints, r) for r in references])


class Overlaps:
    """Exact Jaccard likeness of a bucket's sets (sorted distinct 32-bit shingle hashes)."""

    MANY = 64

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes, self.held = sets, np.array([len(x) for x in sets], dtype=np.int64), None

    def _postings(self) -> tuple:
        """Which nodes have a shingle: for many partners at a time."""
        if self.held is None:
            _, which = np.unique(np.concatenate(self.sets), return_inverse=True)
            order = np.argsort(which, kind="stable")
            owner = np.repeat(np.arange(len(self.sets), dtype=np.int32), self.sizes)[order]
            self.held = which, np.concatenate([[0], np.cumsum(self.sizes)]), owner, np.concatenate([[0], np.cumsum(np.bincount(which))])
        return self.held

    def likeness(self, at: int, near: np.ndarray) -> np.ndarray:
        if len(near) < self.MANY:
            both = np.array([len(np.intersect1d(self.sets[at], self.sets[j], assume_unique=True)) for j in near.tolist()], dtype=np.int64)
        else:
            which, starts, owner, ends = self._postings()
            runs = [owner[ends[w] : ends[w + 1]] for w in which[starts[at] : starts[at + 1]].tolist()]
            both = np.bincount(np.concatenate(runs), minlength=len(self.sets))[near] if runs else np.zeros(len(near), dtype=np.int64)
        whole = self.sizes[at] + self.sizes[near] - both
        return np.where(whole > 0, both / np.maximum(whole, 1), 1.0)


def stars(ids: np.ndarray, prints: np.ndarray, radius: int, references: np.ndarray, sets: list[np.ndarray] | None = None, likeness: float = 0.0) -> np.ndarray:
    """For each node of a bucket the smallest id of its component there. ``prints``: nodes x words.

    Breadth first: each reached node is compared with the nodes not reached yet. The table is sorted
    by the first pivot, so candidates are one run of it; the other columns drop most of the rest. Where
    ``sets`` are given, a link also needs their exact likeness.
    """
    n = len(ids)
    root = ids.copy()
    if n < 2:
        return root
    table = pivot_table(prints, references[: max(2, min(len(references), n // 4))])
    order = np.argsort(table[0], kind="stable")
    table, prints, first = np.ascontiguousarray(table[:, order]), prints[order], table[0][order]
    overlaps = None if sets is None else Overlaps([sets[i] for i in order.tolist()])
    left = np.ones(n, dtype=bool)
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        members, queue = [seed], [seed]
        while queue:
            at = queue.pop()
            low, high = np.searchsorted(first, [first[at] - radius, first[at] + radius + 1])
            near = low + np.flatnonzero(left[low:high])
            for column in table[1:]:
                if len(near) < 8:
                    break
                kept = near[np.abs(column[near] - column[at]) <= radius]
                dense = 8 * len(kept) > 7 * len(near)
                near = kept
                if dense:
                    break  # pivots tell these nodes apart no more; the true distance does
            near = near[distance(prints[near], prints[at]) <= radius]
            if overlaps is not None and len(near):
                near = near[overlaps.likeness(at, near) >= likeness]
            left[near] = False
            members.extend(near.tolist())
            queue.extend(near.tolist())
        if len(members) > 1:
            spots = order[members]
            root[spots] = ids[spots].min()
    return root


LINK_SCHEMA = "a long, b long, band int, key long"


def searched(dealt: DataFrame, words: int, radius: int, hot: int, likeness: float = 0.0) -> DataFrame:
    """Rows (band, key, node, print binary; without print the node is its own 64-bit fingerprint), all of a bucket in one partition and sorted by it, to links: star
    edges (a, b) with band -1. Nodes of a bucket of more than ``hot`` come back unsearched, with their bucket. With a
    column ``shingles`` (binary: sorted distinct 32-bit hashes) a link also needs that exact ``likeness``.
    """
    references, own, exact = pivots(words), "print" not in dealt.columns, "shingles" in dealt.columns

    def prints_of(batch: pa.RecordBatch) -> np.ndarray:
        flat = batch.column("node").to_numpy().view(np.uint64) if own else np.frombuffer(b"".join(batch.column("print").to_pylist()), "<u8")
        return flat.reshape(-1, words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        held, prints_held, sets, hot_key = (none, none, none), np.empty((0, words), dtype=np.uint64), [], None
        for batch in itertools.chain(batches, [None]):  # the last key of a batch may go on in the next, so it waits
            now, prints = held, prints_held
            if batch is not None:
                now = tuple(np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, ("band", "key", "node"), strict=True))
                prints = np.concatenate([prints_held, prints_of(batch)])
                sets = sets + [np.frombuffer(x, "<u4") for x in batch.column("shingles").to_pylist()] if exact else []
            if not len(now[0]):
                continue
            band, key, node = now
            edges = np.concatenate([[0], np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1])) + 1, [len(band)]])
            last = len(edges) - 1 if batch is None else len(edges) - 2
            found: list[tuple] = []

            def unsearched(low: int, high: int, band=band, key=key, node=node, found=found) -> None:
                found.append((node[low:high], node[low:high], band[low:high], key[low:high]))

            for i in np.flatnonzero(np.diff(edges[: last + 1]) > 1).tolist():
                low, high = edges[i], edges[i + 1]
                if (band[low], key[low]) == hot_key:
                    unsearched(low + 1, high)
                elif high - low > hot:
                    unsearched(low, high)
                else:
                    root = stars(node[low:high], prints[low:high], radius, references, sets[low:high] if exact else None, likeness)
                    linked = np.flatnonzero(root != node[low:high])
                    if len(linked):
                        found.append((node[low:high][linked], root[linked], np.full(len(linked), -1), np.zeros(len(linked), dtype=np.int64)))
            low = edges[last]
            if low < len(band):
                known = (band[low], key[low]) == hot_key
                if known or len(band) - low > hot:
                    unsearched(low + known, len(band))
                    hot_key = (band[low], key[low])
                    now, prints, sets = tuple(x[: low + 1] for x in now), prints[: low + 1], sets[: low + 1]  # one stays, to know the key by
            held, prints_held, sets = tuple(x[low:] for x in now), prints[low:], sets[low:]
            if found:
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                columns[2] = columns[2].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "band", "key"])
        common.released()

    parts = common.partitions_of(dealt.sparkSession)
    placed = dealt.repartition(parts, "band", "key").sortWithinPartitions("band", "key")
    return common.written(placed.mapInArrow(scan, LINK_SCHEMA), "simhash-links")


def links(nodes: DataFrame, radius: int, hot: int = HOT) -> DataFrame:
    """``nodes(fp)``, distinct 64-bit fingerprints, to edges (a, b) with b < a that keep every component of the
    link graph. Lossless: see the module's text."""
    masks = [_signed(m) for m in run_masks(radius)]
    keyed = nodes.select(F.col("fp").alias("node"), F.posexplode(F.array(*(F.lit(m) for m in masks))).alias("band", "mask"))
    dealt = keyed.select("band", F.col("node").bitwiseAND(F.col("mask")).alias("key"), "node")
    found = searched(dealt, 1, radius, hot)
    edges = found.where("band < 0").select("a", "b")
    inside = found.where("band >= 0").select(F.col("a").alias("fp")).distinct()
    if inside.take(1):
        edges = edges.unionByName(middle_links(inside, radius))
    return edges.distinct()


def middle_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges through shared middles: exact, and no group is larger than the middles of one node."""
    half, rest = radius // 2, radius - radius // 2
    masks = [_signed(sum(1 << i for i in c)) for r in range(max(half, rest) + 1) for c in itertools.combinations(range(BITS), r)]
    at = nodes.select("fp", F.explode(F.transform(F.array(*(F.lit(m) for m in masks)), lambda m: F.col("fp").bitwiseXOR(m))).alias("middle"))
    if half != rest:  # an odd radius: middles at the two distances, then the true distance
        raise ValueError("the radius has to be even where a bucket is hot")
    least = at.groupBy("middle").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top")
    return at.join(least, "middle").where("fp > b").select(F.col("fp").alias("a"), "b").distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Edges (a, b) to (node, root): root is the smallest node reachable. Nodes without edges are left out.

    Each round: every node takes the smallest label among itself and its neighbours (large star), and
    pointers are doubled. A round is written to the shared folder; it ends when nothing changed.
    """
    spark = edges.sparkSession
    both = common.written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = common.written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "cc-labels")
    if not labels.take(1):
        return spark.createDataFrame([], "node long, root long")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "near").alias("low"))
        # what a node learned also holds for the root that it had
        roots = lower.groupBy("root").agg(F.min("low").alias("root_low")).withColumnRenamed("root", "old")
        jumped = lower.join(roots, lower.root == roots.old).select("node", "root", F.least("low", "root_low").alias("low"))
        far = jumped.select(F.col("node").alias("at"), F.col("low").alias("beyond"))
        step = jumped.join(far, jumped.low == far["at"], "left").select("node", F.least("low", F.coalesce("beyond", "low")).alias("root"), (F.col("root") != F.least("low", F.coalesce("beyond", "low"))).alias("moved"))
        now = common.written(step, "cc-labels")
        labels = now.select("node", "root")
        if not now.where("moved").take(1):
            break
    else:
        raise RuntimeError("components did not settle")
    return labels


def near_duplicate_classes(docs: DataFrame, size: int, radius: int, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id, class_fps): one row for each row of ``docs``.

    component_id is the smallest doc_id of the class, class_fps its number of fingerprints. Classes of one fingerprint need no join beyond
    their own aggregate; a fingerprint that a third of all documents share is one row on the small
    side, and its documents' side is split by adaptive execution.
    """
    marked = common.written(with_fingerprints(docs, size), "simhash")
    nodes = common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius, hot))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("class_fps"))
    classes = placed.join(smallest, "root").select("fp", "component_id", "class_fps")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id", "class_fps")


# -- near-duplicates at a likeness of 0.8

#: 256-bit fingerprints of the distinct five-word shingles.
WORDS, SHINGLE, LIKENESS = 4, 5, 0.8
#: Bands of two least shingles: sets that share 0.8 of their shingles meet in one of ten with 0.99996.
BANDS, LEAST = 10, 2
_mixers = np.random.default_rng(SEED + 1).integers(0, 1 << 63, size=(WORDS + BANDS * LEAST,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def radius_of(likeness: float, bits: int) -> int:
    """Four deviations above the differing bits that sets of this likeness expect: their angle's share, but 3/16 where
    the sets are small and halves tie (5 and 4 shingles; the most at 0.8)."""
    share = max(np.arccos(2 * likeness / (1 + likeness)) / np.pi, 3 / 16)
    return int(np.ceil(bits * share + 4 * np.sqrt(bits * share * (1 - share))))


def wide_fingerprint(text: str, size: int = SHINGLE) -> tuple[int, bytes, np.ndarray]:
    """Of the set of shingles: its hash, 256-bit fingerprint (little-endian), and the keys of the bands."""
    import xxhash

    h = np.unique(shingle_hashes(text, size))  # the likeness is one of sets, so a repeated line counts once
    node = xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), SEED)
    if not len(h):
        return node, bytes(8 * WORDS), np.zeros(BANDS, dtype=np.int64)
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    for i in range(0, len(h), 16_384):
        part = h[i : i + 16_384, None] * _mixers[None, :WORDS]
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(32)
        ones += np.unpackbits(np.ascontiguousarray(part, dtype="<u8").view(np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    least = np.array([(h * m).min() for m in _mixers[WORDS:]], dtype=np.uint64).reshape(BANDS, LEAST)
    keys = (least[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (least[:, 1] >> np.uint64(7))
    return node, np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").tobytes(), keys.view(np.int64)


def pair_blocks(hot_rows: DataFrame, hot: int) -> DataFrame:
    """Rows (band, key, node, ...) of buckets too large for one task, dealt to pairs of chunks of at most
    ``hot / 2`` nodes: two nodes of a bucket meet in a pair, and no task holds more than a pair."""
    sizes = hot_rows.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) * 2.5 / hot).cast("int").alias("chunks"))
    chunked = hot_rows.join(sizes, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    met = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return met.select("band", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *(c for c in hot_rows.columns if c not in ("band", "key")))


def near_duplicates(docs: DataFrame, likeness: float = LIKENESS, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, component): classes of texts whose five-word shingles (as sets) are alike by ``likeness`` or
    more, one row for each row of ``docs(doc_id, text)``; component is the smallest node id (a hash of the whole set).

    First links by fingerprints alone, whose angle allows for that likeness; then, among linked nodes only, the same
    search again with the exact likeness of their shingles. Only texts with one set of shingles are one node.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [wide_fingerprint(t.as_py() or "") for t in batch.column("text")]
            node = np.array([n for n, _, _ in made], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(node), pa.array([p for _, p, _ in made], pa.binary()), pa.array([k for _, _, k in made], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "node", "print", "keys"],
            )
        common.released()

    common.bounded_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    marked = common.written(plain.mapInArrow(scan, "doc_id long, text_hash long, node long, print binary, keys array<long>"), "near-prints")
    nodes = marked.select("node", "print", "keys").distinct()
    radius = radius_of(likeness, 64 * WORDS)

    def linked(rows: DataFrame, hot: int) -> DataFrame:
        """Edges of rows (band, key, node, print, ...), by buckets or, where these are too large, pairs of chunks."""
        rows = rows.distinct()
        found = searched(rows, WORDS, radius, hot, likeness)
        edges = found.where("band < 0").select("a", "b")
        large = found.where("band >= 0").select("band", "key").distinct()
        if large.take(1):
            inside = rows.join(large, ["band", "key"], "left_semi").select(rows.columns)
            edges = edges.unionByName(searched(pair_blocks(inside, hot), WORDS, radius, 1 << 62, likeness).select("a", "b"))
        return edges.distinct()

    exploded = nodes.select("node", "print", F.posexplode("keys").alias("band", "key")).select("band", "key", "node", "print")
    loose = components(linked(exploded, hot))
    # one text of each linked node gives its shingles (all texts of a node have the same); few documents have such a node
    chosen = marked.join(loose.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
    chosen = chosen.select("node", F.col("r.doc_id").alias("doc_id"), F.col("r.text_hash").alias("text_hash"))

    @F.pandas_udf("binary")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes(t or "", SHINGLE).astype("<u4")).tobytes() for t in texts], dtype=object)
        common.released()

    same = [plain["doc_id"].eqNullSafe(chosen["doc_id"]), plain["text_hash"] == chosen["text_hash"]]
    sets = common.written(plain.join(chosen, same).select("node", shingles("text").alias("shingles")).dropDuplicates(["node"]), "near-sets")
    exact = exploded.join(sets, "node").select("band", "key", "node", "print", "shingles")
    roots = components(linked(exact, max(2, hot // 4)))
    return marked.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("component"))


def deduplicated(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest (doc_id, hash of the text). Rows that
    repeat it go too. Rows without doc_id stay. Further columns are kept whatever their names."""
    return common.aside(docs, ("doc_id", "text"), lambda d: _deduplicated(d, likeness))


def _deduplicated(docs: DataFrame, likeness: float) -> DataFrame:
    classes = common.written(near_duplicates(docs, likeness).where("doc_id IS NOT NULL"), "near-classes")
    firsts = classes.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    joined = classes.join(firsts, "component")
    gone = joined.where(F.struct("doc_id", "text_hash") != F.col("first")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    same = [F.col("doc_id").cast("long") == F.col("gone_id"), F.xxhash64("text") == F.col("gone_hash")]
    kept = docs.join(gone, same, "left_anti")
    again = common.written(classes.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash")), "near-again")
    if not again.take(1):
        return kept
    twice = [F.col("doc_id").cast("long") == F.col("again_id"), F.xxhash64("text") == F.col("again_hash")]
    return kept.join(again, twice, "left_anti").unionByName(kept.join(again, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = near_duplicate_classes(docs, size=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
