"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling polynomial hash (mod 2**64, mixed). In each window of
``w`` k-grams the smallest hash is chosen, the rightmost one on ties, and its position is kept.
Two texts that share a run of ``w + k - 1`` code points always share a chosen k-gram.

Defined results
    * null text counts as empty; an empty text has no k-grams and an empty fingerprint;
    * a text shorter than ``k`` has one entry, the hash of the whole text at position 0;
    * a text with fewer than ``w`` k-grams has one window, so at least one entry;
    * hashes are compared by all bits but as many low ones as number a window's places (6 of 64 here); equal ones tie;
    * texts of any length are walked whole, in stretches;
    * equal texts have equal fingerprints; likeness of two empty fingerprints is 1, of an empty
      and a non-empty one 0;
    * extra columns of the input are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common

#: Code points in a k-gram, and k-grams in a window: shared runs of 64 code points are always met.
K, W = 32, 33
#: Windows of a text that are walked at once.
STRETCH = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; kept and grown by doubling."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = 1 << max(12, (n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        held = _powers[base] = np.multiply.accumulate(steps)
    return held[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def kgram_hashes(text: str, k: int = K) -> np.ndarray:
    """Hash of each k-gram; one hash of the whole text where it is shorter than ``k``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(points)
    if not n:
        return np.empty(0, dtype=np.uint64)
    k = min(k, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * _power(_INVERSE, n - k + 1))


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, in order of position. A long text is walked in stretches of ``STRETCH`` windows,
    each with the code points that its last window reaches, so memory is that of a stretch."""
    windows = len(text) - k - w + 2
    if windows <= STRETCH:
        return _winnow(text, k, w)
    parts = [(first, *_winnow(text[first : first + STRETCH + k + w - 2], k, w)) for first in range(0, windows, STRETCH)]
    h, at = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + p[0] for p in parts])
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = at[1:] != at[:-1]  # a stretch's first window may choose what the last one before it did
    return h[fresh], at[fresh]


def _winnow(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one stretch.

    Blocks of ``w``: a window is the end of one block and the start of the next, so running minima
    inside the blocks from both sides give every window's minimum in two passes.
    """
    h = kgram_hashes(text, k)
    n = len(h)
    if not n:
        return h, np.empty(0, dtype=np.int64)
    w = min(w, n)
    bits = max(1, (w - 1).bit_length())
    shift, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = h >> shift
    # the low bits hold the place in the block, reversed: the rightmost of equal hashes is smallest
    keys = ((padded.reshape(blocks, w) << shift) | (np.uint64(w - 1) - np.arange(w, dtype=np.uint64))).reshape(-1)
    grid = keys.reshape(blocks, w)
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)  # from a place to its block's end
    right = np.minimum.accumulate(grid, axis=1).reshape(-1)  # from the block's start to a place
    starts = np.arange(n - w + 1)
    a, b = left[starts], right[starts + w - 1]
    block = starts // w
    later = (b >> shift) <= (a >> shift)  # on ties the later block's entry
    key = np.where(later, b, a)
    at = np.where(later, (starts + w - 1) // w, block) * w + (w - 1) - (key & low).astype(np.int64)
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = at[1:] != at[:-1]
    at = at[fresh]
    return h[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """32 hex digits that stand for all chosen hashes and positions."""
    return hashlib.blake2b(hashes.tobytes() + positions.astype(np.int64).tobytes(), digest_size=16).hexdigest()


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by the first as many code points of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def document_fingerprints(docs: DataFrame, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """General form: ``docs`` with its whole fingerprint, ``hashes array<long>, positions array<long>``.

    Hashes are the unsigned 64-bit values seen as signed longs. A map over rows: nothing is shuffled.
    Columns named ``hashes`` or ``positions`` that ``docs`` already has are replaced.
    """

    @F.pandas_udf("hashes array<long>, positions array<long>")
    def chosen(texts):
        found = [winnow(t or "", k, w) for t in texts]
        return pd.DataFrame({"hashes": [h.view(np.int64) for h, _ in found], "positions": [p for _, p in found]})

    made = docs.withColumn("__winnow", chosen(common.whole_text(text)))
    kept = [c for c in docs.columns if c not in ("hashes", "positions")]
    return made.select(*(made[c] for c in kept), "__winnow.hashes", "__winnow.positions")


EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_chosen long"


def edit_report(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's opening, by ascending doc_id.

    Ids are cut into ranges whose first id exists; a range's first document is dealt to the range
    before it too, as its closing neighbour. So texts are shuffled once, no task needs another's
    rows, and no row is alone in being last but by the wrap to the first document. A null doc_id
    counts as below all others; rows with one doc_id follow by text.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    parts = common.partitions_of(spark)
    lowest = -(1 << 63)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text")).withColumn(
        "key", F.coalesce("doc_id", F.lit(lowest).cast("long"))
    )
    bounds = common.range_bounds(keyed, "key", 3 * parts)
    blocks = max(1, len(bounds))
    code = common.block_of(bounds or [0])(F.col("key"))
    block = (F.col("code") / 2).cast("long")
    places = F.when(
        F.col("code") % 2 == 1,
        F.array(F.struct(block.alias("block"), F.lit(0).alias("closing")), F.struct(((block + blocks - 1) % blocks).alias("block"), F.lit(1).alias("closing"))),
    ).otherwise(F.array(F.struct(block.alias("block"), F.lit(0).alias("closing"))))
    dealt = (
        keyed.withColumn("code", code)
        .select("doc_id", "key", "text", F.explode(places).alias("place"))
        .select("doc_id", "key", "text", "place.block", "place.closing")
        .repartition(parts, "block")
        .sortWithinPartitions("block", "closing", "key", "text")
        .select("doc_id", "text", "block", "closing")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (block, doc_id, text, hashes, positions, distinct hashes)
        for batch in batches:
            for first, last in common.slices(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), 4_000_000):
                part = batch.slice(first, last - first)
                rows: list[tuple] = []
                for doc_id, text, at, closing in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "block", "closing")), strict=True):
                    if closing and (held is None or held[0] != at):
                        continue  # a further row with the id that closes this range
                    hashes, positions = winnow(text, k, w)
                    distinct = np.unique(hashes)
                    if held is not None and held[0] == at:
                        rows.append(_report(held, text, distinct, k, w))
                    held = None if closing else (at, doc_id, text, hashes, positions, distinct)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in EDIT_SCHEMA.split(", ")])
        common.released()

    return dealt.mapInArrow(scan, EDIT_SCHEMA)


def _report(held: tuple, following: str, next_distinct: np.ndarray, k: int, w: int) -> tuple:
    _, doc_id, text, hashes, positions, distinct = held
    other = edited(text, following)
    h, p = (hashes, positions) if other == text else winnow(other, k, w)
    return (
        doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), digest(hashes, positions), digest(h, p),
        likeness(distinct, np.unique(h)), likeness(distinct, next_distinct), len(hashes),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))
