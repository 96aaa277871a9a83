"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A document's features are the n-grams (``GRAMS`` letters) of its words, each word between two blanks, present or not. For
each n-gram the training documents give ``r = log(share of toxic documents with it / share of others)``; a present feature
counts ``r`` in a logistic regression, so what says nothing starts near zero and what is rare among clean texts starts large.

Learning uses a bounded sample: of each class about ``TRAIN_DOCUMENTS`` labelled rows drawn by a hash of the id (twice as
many at most), their texts whole. Documents are counted for each n-gram by a Spark aggregation; the ``FEATURES`` n-grams
that tell the classes apart most surely (ratio over its standard error, ``SURE`` at least) are the model. What the driver
gets is bounded by documents times features, a bit each. Scores read every word of every text.

Defined results
    * null text counts as empty; an empty text has no features, and gets the score of the constant term;
    * words are runs without the six white-space bytes, in lower case; texts and words of any length count whole;
    * labels, lang, source and doc_id are no inputs of a score; equal texts have equal scores;
    * a document labelled several times counts once, with the mean of its labels (toxic: 0.5 or more); rows that repeat a
      document count once;
    * without labelled rows every score is 0 (nothing is flagged); with one kind of label, 1 or 0 as it says;
    * extra columns are kept by :func:`score`; its own columns replace those of the same name; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common

GRAMS = (3, 4, 5, 6)
TRAIN_DOCUMENTS, FEATURES = 4_000, 4_096
#: An n-gram is a feature from so many training documents on, and so many standard errors; ALPHA is added to all counts.
LEAST, SURE, ALPHA = 4, 4.0, 1.0
#: Weight of the squared weights, and steps of learning.
RIDGE, STEPS = 1e-5, 500
THRESHOLD = 0.5
#: Bytes of text that are scored at once, and words whose features a worker keeps.
RUN, KEPT = 2_000_000, 200_000

_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def grams(words: list[str], lengths: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of each word, one word after the other, and how many each has."""
    marked = [f" {w.lower()} " for w in words]
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    keys, owners = [], []
    at = np.arange(len(letters))
    h = np.zeros(len(letters), dtype=np.uint64)
    for n in range(1, max(lengths) + 1):
        h = h[: len(letters) - n + 1] * np.uint64(_BASE) + letters[n - 1 :] + np.uint64(1)
        if n in lengths:
            whole = at[: len(h)] + n <= ends[: len(h)]
            keys.append(_mix(h[whole] + np.uint64(n)))
            owners.append(owner[: len(h)][whole])
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.bincount(owners, minlength=len(words))


@dataclass
class Model:
    """Hashes of the features in order, what each adds to the score's logit if present, and the constant term."""

    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    base: float = 0.0
    constant: float | None = None


class Presence:
    """Features that occur in texts, by a table of the features of each word that is kept in the worker."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.table = keys, common.IdTable(np.dtype(np.int32), KEPT)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of each text's features, once each, in order."""
        codes, sizes, words = common.coded_words(texts)
        text = np.repeat(np.arange(len(sizes)), sizes)
        n = max(1, len(words))
        once = np.unique(text * n + codes)
        text, codes, words = once // n, once % n, words.to_pylist()
        fresh = [words[i] for i in self.table.fresh(words)]
        if fresh:
            keys, counts = grams(fresh)
            place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
            word = np.repeat(np.arange(len(fresh)), counts)[known]
            self.table.learn(fresh, place[known].astype(np.int32), np.bincount(word, minlength=len(fresh)))
        ids, counts = self.table.gathered(codes, words, np.bincount(text, minlength=len(sizes)))
        m = max(1, len(self.keys))
        pairs = np.unique(np.repeat(np.arange(len(sizes)), counts) * m + ids)
        return pairs // m, pairs % m


def fit(present: np.ndarray, ratios: np.ndarray, toxic: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression on ``present * ratios`` (documents by features) by accelerated gradients: what each feature adds
    to the logit, and the constant term."""
    x = present.astype(np.float32) * ratios.astype(np.float32)
    weight = weight / weight.sum()
    scaled = x * np.sqrt(weight)[:, None].astype(np.float32)
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(12):  # the largest curvature
        v = scaled.T @ (scaled @ v)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    share = float(np.clip(weight @ toxic, 1e-6, 1 - 1e-6))
    w, b = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    ahead, c, t = w, b, 1.0
    pace = 1 / (0.25 * (1.1 * top + 1) + RIDGE)
    for _ in range(steps):
        away = weight * (1 / (1 + np.exp(-np.clip(x @ ahead.astype(np.float32) + c, -40, 40))) - toxic)
        w_new, b_new = ahead - pace * (x.T @ away.astype(np.float32) + RIDGE * ahead), c - pace * away.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w * ratios, b


def drawn(labels: DataFrame, target: str, most: int) -> tuple[list[tuple[int, bool]], dict[bool, float]]:
    """Ids drawn of each class with their label, and how many labelled documents each drawn one stands for."""
    usable = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (common.fold(F.col("doc_id"), 5) != 0))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col(target).cast("double")) >= 0.5).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    ids: list[tuple[int, bool]] = []
    stands = {}
    for kind, n in sorted(counts.items()):
        bar = int(min(1.0, most / n) * (1 << 52))
        own = usable.where((F.col("toxic") == kind) & (F.xxhash64("doc_id").bitwiseAND((1 << 52) - 1) < bar)).orderBy("doc_id").limit(2 * most).collect()
        ids += [(r["doc_id"], kind) for r in own]
        stands[kind] = n / max(1, len(own))
    return ids, stands


def learned(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = TRAIN_DOCUMENTS, features: int = FEATURES) -> Model:
    """From labelled rows whose id is not held out. ``docs(doc_id, text)``, ``labels(doc_id, <target>)``."""
    spark = docs.sparkSession
    ids, stands = drawn(labels, target, most)
    if len(stands) < 2:
        return Model(constant=float(any(stands)) if stands else 0.0)
    known = spark.createDataFrame(ids, "doc_id long, toxic boolean")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = common.written(plain.join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text").distinct(), "toxicity-sample")  # 4 * most ids at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.texts_of_size(batches, RUN):
            codes, sizes, words = common.coded_words(batch.column("text"))
            keys, counts = grams(words.to_pylist())
            unique, number = np.unique(keys, return_inverse=True)
            toxic = np.array(batch.column("toxic").to_pylist(), dtype=bool)
            starts = np.cumsum(counts) - counts
            held = np.zeros((2, len(unique)), dtype=np.int64)
            for i, (first, last) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True)):
                own = np.unique(codes[first:last])
                n = counts[own]
                at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                held[int(toxic[i]), np.unique(number[at])] += 1
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(held[1]), pa.array(held[0])], names=["key", "toxic", "other"])

    totals = {r["toxic"]: r["count"] for r in met.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model(constant=float(any(totals)) if totals else 0.0)
    counted = met.mapInArrow(count, "key long, toxic long, other long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    ratio = F.log((F.col("toxic") + ALPHA) / (totals[True] + 2 * ALPHA)) - F.log((F.col("other") + ALPHA) / (totals[False] + 2 * ALPHA))
    error = F.sqrt(1 / (F.col("toxic") + ALPHA) + 1 / (F.col("other") + ALPHA))
    rated = counted.where(F.col("toxic") + F.col("other") >= LEAST).select("key", ratio.alias("r"), F.abs(ratio / error).alias("sure"))
    best = rated.where(F.col("sure") >= SURE).orderBy(F.desc("sure"), "key").limit(features).collect()
    if not best:
        n = sum(stands[k] * totals[k] for k in totals)
        return Model(constant=stands[True] * totals[True] / n)
    keys = np.array([r["key"] for r in best], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, ratios = keys[order], np.array([r["r"] for r in best])[order]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence(keys)
        for batch in common.texts_of_size(batches, RUN):
            text, feature = presence.of(batch.column("text"))
            bits = np.zeros((batch.num_rows, len(keys)), dtype=bool)
            bits[text, feature] = True
            rows = [b.tobytes() for b in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "bits"])

    rows = met.mapInArrow(describe, "doc_id long, toxic boolean, bits binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["bits"])))
    present = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), dtype=np.uint8).reshape(len(rows), -1), axis=1, count=len(keys))
    toxic = np.array([r["toxic"] for r in rows])
    weights, base = fit(present, ratios, toxic.astype(float), np.where(toxic, stands[True], stands[False]))
    return Model(keys, weights, base)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score double (0 to 1, higher: toxic likelier) and predicted int. The model is a few KB."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shipped.value
        presence = Presence(model.keys)
        for texts in batches:
            out = np.full(len(texts), model.base)
            for first, last in common.slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), RUN):
                own, feature = presence.of(texts.slice(first, last - first))
                out[first:last] += np.bincount(own, model.weights[feature], minlength=last - first)
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40))) if model.constant is None else np.full(len(texts), model.constant))

    return common.aside(docs, (text,), lambda d: d.withColumn("score", judged(F.col(text).cast("string"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = learned(docs, common.read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, model).select("doc_id", (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
