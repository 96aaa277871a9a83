"""Helpers that several training-data operators share.

Nothing here holds data of its own size on the driver: the helpers read settings, write
tables into the cluster's shared folder, and cut an ordered key into ranges.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table by Spark's own reader (the folder may be in any store)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset, in local mode (tests), a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame, needed: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(docs)``, which adds columns; those of ``docs`` that it doesn't need stand aside meanwhile under names of their
    own, so that none clashes with what it uses inside. An added column takes the place of one of the same name."""
    held = {c: f"__aside_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    made = work(docs.withColumnsRenamed(held))
    within = {held.get(c, c) for c in docs.columns}
    added = [c for c in made.columns if c not in within]
    return made.select(*(F.col(held.get(c, c)).alias(c) for c in docs.columns if c not in added), *added)


#: Bytes of the Arrow batches that go between Spark and Python.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes in this session, where it sets no bound of its own: Spark counts rows, and 10,000 rows of
    long texts are any size. One row is a batch at least."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def fold(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo ``buckets``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % buckets


def whole_text(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def released() -> None:
    """Gives memory that a worker no longer uses back to the system, where its library can; the worker lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(lengths: np.ndarray, most: int):
    """(first, last) index pairs that cut rows into runs of about ``most`` units, one row at least."""
    first, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(lengths):
        yield first, len(lengths)


def texts_of_size(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in batches whose texts have about ``most`` bytes, one row at least: large ones are
    cut, small ones gathered."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for first, last in slices(lengths, most):
            own = int(lengths[first:last].sum())
            if held and size + own > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(batch.slice(first, last - first))
            size += own
    if held:
        yield pa.concat_batches(held)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (UTF-8 of strings) of all values of a column, one after the other, and the n + 1 places where they begin and
    end. Null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) else b"")
    texts = pa.concat_arrays([texts])  # a slice may start inside its buffers
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if offsets and len(texts) else np.zeros(len(texts) + 1, dtype=np.int64)
    bytes_of = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return bytes_of[cuts[0] : cuts[-1]], cuts - cuts[0]


def strings(data: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The stretches of ``data`` from each of ``starts`` to the next as one Arrow column; nothing is copied."""
    cuts = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])


class IdTable:
    """Ids of distinct runs of text, each learned once by a worker: a number for each run, and the ids of all runs in one
    array. When it holds ``most`` runs, or 16 ids for each of so many, it starts anew."""

    def __init__(self, kind: np.dtype, most: int):
        self.kind, self.most = kind, most
        self._start()

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.cuts = np.empty(1 << 16, dtype=self.kind), np.zeros(1 << 12, dtype=np.int64)  # of run i: ids[cuts[i]:cuts[i + 1]]

    def fresh(self, runs: list[str]) -> list[int]:
        """Which of the distinct runs of a batch are to be learned."""
        if len(self.known) > self.most or self.cuts[len(self.known)] > 16 * self.most:
            self._start()
        return [i for i, r in enumerate(runs) if r not in self.known]

    def learn(self, runs: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        used = int(self.cuts[n])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + len(runs) >= len(self.cuts):
            self.cuts = np.concatenate([self.cuts, np.zeros_like(self.cuts)])
        self.ids[used : used + len(ids)] = ids
        self.cuts[n + 1 : n + len(runs) + 1] = used + np.cumsum(sizes)
        self.known.update(zip(runs, range(n, n + len(runs)), strict=True))

    def gathered(self, codes: np.ndarray, runs: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of ``sizes`` runs, ``runs[codes]`` in order: one text after the other, and how many each has."""
        number = np.fromiter(map(self.known.__getitem__, runs), dtype=np.int64, count=len(runs))
        per_run = (self.cuts[number + 1] - self.cuts[number])[codes]
        before = np.concatenate([[0], np.cumsum(per_run)])
        ids = self.ids[np.repeat(self.cuts[number][codes] - before[:-1], per_run) + np.arange(before[-1])]
        return ids, np.diff(before[np.concatenate([[0], np.cumsum(sizes)])])


_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def coded_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text (runs without the six white-space bytes, A-Z in lower case if ``lower``): a number for each word in order,
    how many each text has, and the distinct words by number."""
    data, cuts = text_bytes(texts)
    solid = ~_BLANKS[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = cuts[:-1][cuts[:-1] < len(data)]
    first[inner] = solid[inner]  # a text never goes on in the next
    at = np.flatnonzero(first)
    sizes = np.diff(np.searchsorted(at, cuts))
    coded = strings(_LOWER[data[solid]] if lower else data[solid], np.flatnonzero(first[solid]), pa.string()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), sizes, coded.dictionary


def range_bounds(df: DataFrame, key: str, blocks: int) -> list[int]:
    """Keys that occur in ``df`` and cut it into about ``blocks`` even ranges; the smallest key first.

    ``percentile_approx`` returns values of the column itself, so each bound is the first row of
    its range. At most ``blocks`` numbers reach the driver.
    """
    quantiles = [i / blocks for i in range(1, blocks)] or [0.5]
    row = df.agg(
        F.min(key).alias("low"),
        F.percentile_approx(key, quantiles, max(10_000, 20 * blocks)).alias("cuts"),
    ).first()
    if row is None or row["low"] is None:
        return []
    return sorted({row["low"], *(row["cuts"] if blocks > 1 else [])})


def block_of(bounds: list[int]):
    """A vectorised function: 2 * (range that a key falls in) + (1 if the key opens its range)."""
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf(T.LongType())
    def code(keys):
        values = keys.to_numpy(dtype=np.int64)
        at = np.maximum(np.searchsorted(cuts, values, side="right") - 1, 0)
        return pd.Series(2 * at + (cuts[at] == values))

    return code


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
