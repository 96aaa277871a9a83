"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE`` UTF-8 bytes over the whole text). Each passage
is described by counts of character classes and their pairs, by word repetition, and by its words (hashed to
``WORDS`` buckets, each with a learned vector), and encoded by a learned layer. Gated attention, ``softmax(a . (tanh(V h) * sigmoid(U h)))`` over the passages of a
document, weighs the passage codes ``h``; the weighted code gives the document's score. Only
document labels are used for learning; which passages count is learned with them.

Learning uses a bounded sample of whole documents: labelled rows drawn by a hash of the id (``TRAIN_DOCUMENTS`` expected, twice
as many at most), taken in the order of that hash as long as they have ``TRAIN_PASSAGES`` passages together; a document that
doesn't fit any more is passed over. Every passage of a taken document is learned from, and scores read every passage of every text.

Defined results
    * null text counts as empty; an empty text is one passage without any sign, and gets a score;
    * labels, lang, source and doc_id are no inputs of a score; equal texts have equal scores;
    * a document labelled several times counts once, with the mean of its labels; rows that repeat a document count once;
    * without labelled rows every score is 0.5; with one kind of label, that label's share;
    * extra columns are kept by :func:`score`; its own columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common

PASSAGE = 320
TRAIN_DOCUMENTS, TRAIN_PASSAGES = 3_000, 100_000
#: Buckets of words, and how much less than the other features each of them weighs at first.
WORDS, CALM = 128, 5.0
CODE, GATE, EPOCHS = 16, 8, 160
THRESHOLD = 0.7

#: Character classes of bytes: blank, line end, two halves of the small letters, capitals, digits,
#: full stop, comma, exclamation or question, bar, other signs, bytes of other letters.
_KINDS = 12
_kind = np.full(256, 10, dtype=np.int64)
_kind[[9, 11, 12, 13, 32]] = 0
_kind[10] = 1
_kind[97:110], _kind[110:123], _kind[65:91], _kind[48:58] = 2, 3, 4, 5
_kind[46], _kind[44], _kind[[33, 63]], _kind[124], _kind[128:] = 6, 7, 8, 9, 11
_PAIRS = _KINDS * _KINDS
FEATURES = _KINDS + _PAIRS + 5 + WORDS
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(1 << max(16, (n - 1).bit_length()), base, dtype=np.uint64)
        steps[0] = 1
        held = _powers[base] = np.multiply.accumulate(steps)
    return held[:n]


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`passages_of`, for single texts."""
    return passages_of(np.frombuffer(b"".join(texts), dtype=np.uint8), np.array([len(t) for t in texts], dtype=np.int64))


def passages_of(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32 rows) and the number of passages of each text. ``data``: bytes of all texts, one after
    the other; ``sizes``: how many each has."""
    counts = np.maximum(1, -(-sizes // PASSAGE))
    out = np.zeros((int(counts.sum()), FEATURES), dtype=np.float32)
    if not len(data):
        return out, counts
    starts = np.cumsum(sizes) - sizes
    base = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    home = base[owner] + (np.arange(len(data)) - starts[owner]) // PASSAGE
    total = len(out)
    kinds = _kind[data]
    held = np.bincount(home, minlength=total)
    length = np.maximum(1, held)[:, None]
    out[:, :_KINDS] = np.bincount(home * _KINDS + kinds, minlength=total * _KINDS).reshape(total, _KINDS) / length
    same = home[1:] == home[:-1]
    pairs = (home[1:] * _PAIRS + kinds[:-1] * _KINDS + kinds[1:])[same]
    out[:, _KINDS : _KINDS + _PAIRS] = 4 * np.bincount(pairs, minlength=total * _PAIRS).reshape(total, _PAIRS) / length
    # words: runs of bytes that are no white space, inside one text
    solid = kinds > 1
    first = solid.copy()
    first[1:] &= ~solid[:-1] | (owner[1:] != owner[:-1])
    last = solid.copy()
    last[:-1] &= ~solid[1:] | (owner[1:] != owner[:-1])
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(a):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
        word = (sums[b] - sums[a]) * _power(_INVERSE, len(data))[a]
        spot, doc = home[a], owner[a]
        words = np.bincount(spot, minlength=total)
        share = np.maximum(1, words)
        again = np.zeros(len(a))
        again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        twice = np.zeros(len(a))
        twice[2:] = (word[2:] == word[:-2]) & (doc[2:] == doc[:-2])
        at = _KINDS + _PAIRS
        out[:, at] = np.bincount(spot, again, minlength=total) / share
        out[:, at + 1] = np.bincount(spot, twice, minlength=total) / share
        out[:, at + 2] = np.bincount(spot, b - a, minlength=total) / share / 10
        out[:, at + 3] = words / 50
        bucket = ((word * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % WORDS
        out[:, at + 5 :] = np.sqrt(np.bincount(spot * WORDS + bucket, minlength=total * WORDS).reshape(total, WORDS) / share[:, None])
    out[:, _KINDS + _PAIRS + 4] = np.log1p(held) / 6
    return out, counts


@dataclass
class Model:
    """Scaling of the features, weights, and a constant score where nothing could be learned."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(model: Model, x: np.ndarray, counts: np.ndarray) -> tuple:
    """Score of each bag, and what learning needs again: codes, gates, attention."""
    w = model.weights
    starts = np.cumsum(counts) - counts
    h = np.tanh(x @ w["E"] + w["e"])
    v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    logit = (v * u) @ w["a"]
    logit = logit - np.repeat(np.maximum.reduceat(logit, starts), counts)
    power = np.exp(logit)
    attention = power / np.repeat(np.add.reduceat(power, starts), counts)
    bag = np.add.reduceat(attention[:, None] * h, starts)
    return _sigmoid(bag @ w["c"] + w["b"]), h, v, u, attention, bag


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam on the cross entropy of the bags' labels; all gradients by hand."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, float(labels.mean()) if len(labels) else 0.5)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    scale[-WORDS:] *= CALM
    x = ((x - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    w = {
        "E": rng.normal(0, FEATURES**-0.5, (FEATURES, CODE)), "e": np.zeros(CODE), "V": rng.normal(0, CODE**-0.5, (CODE, GATE)), "U": rng.normal(0, CODE**-0.5, (CODE, GATE)),
        "a": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, CODE**-0.5, CODE), "b": np.zeros(1),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    model = Model(mean, scale, w)
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, epochs + 1):
        g = gradients(model, x, counts, labels)
        for k in w:
            grad = g[k] + 1e-5 * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
            w[k] -= (0.02 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def gradients(model: Model, x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy of the bags' labels, by each weight."""
    w, starts = model.weights, np.cumsum(counts) - counts
    p, h, v, u, att, bag = forward(model, x, counts)
    d = ((p - labels) / len(labels)).astype(x.dtype)
    g = {"c": bag.T @ d, "b": d.sum(keepdims=True)}
    dbag = np.repeat(d[:, None] * w["c"], counts, axis=0)
    datt = (dbag * h).sum(axis=1)
    dlogit = att * (datt - np.repeat(np.add.reduceat(att * datt, starts), counts))
    g["a"] = (v * u).T @ dlogit
    dgate = dlogit[:, None] * w["a"]
    dv, du = dgate * u * (1 - v * v), dgate * v * u * (1 - u)
    g["V"], g["U"] = h.T @ dv, h.T @ du
    dh = (att[:, None] * dbag + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
    g["E"], g["e"] = x.T @ dh, dh.sum(axis=0)
    return g


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Of each text of a column (null: empty). Texts are read in runs of about a million bytes, without copies."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    data, cuts = common.text_bytes(texts)
    out = [np.empty(0)]
    for first, last in common.slices(np.diff(cuts), 1_000_000):
        x, counts = passages_of(data[cuts[first] : cuts[last]], np.diff(cuts[first : last + 1]))
        out.append(forward(model, ((x - model.mean) / model.scale).astype(np.float32), counts)[0].astype(np.float64))
    return np.concatenate(out)


def learned(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = TRAIN_DOCUMENTS) -> Model:
    """From labelled rows whose id is not held out. ``docs(doc_id, text)``, ``labels(doc_id, <target>)``.

    The drawn labels (see the module's text for the bounds) go out with the plan; passages are described where the
    texts are, and only the drawn documents' features come to the driver.
    """
    usable = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (common.fold(F.col("doc_id"), 4) != 2))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(target).cast("double")).alias("label"))
    rate = min(1.0, most / max(1, usable.count()))
    drawn = usable.where(F.xxhash64("doc_id").bitwiseAND((1 << 52) - 1) < int(rate * (1 << 52))).orderBy("doc_id").limit(2 * most).collect()
    if not drawn:
        return fit(np.empty((0, FEATURES), np.float32), np.empty(0, np.int64), np.empty(0))
    common.bounded_batches(docs.sparkSession)
    known = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in drawn], "doc_id long, label double")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = common.written(plain.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text").distinct(), "quality-sample")
    key = F.xxhash64("doc_id", "text").alias("key")
    sizes = met.select(key, F.xxhash64("doc_id").alias("draw"), F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE)).alias("n"))
    taken = whole_documents(sorted((r["draw"], r["key"], r["n"]) for r in sizes.collect()), TRAIN_PASSAGES)  # three numbers a drawn row
    if not taken:
        return fit(np.empty((0, FEATURES), np.float32), np.empty(0, np.int64), np.empty(0))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.texts_of_size(batches, 1_000_000):
            data, cuts = common.text_bytes(batch.column("text"))
            x, counts = passages_of(data, np.diff(cuts))
            rows = common.strings(x.reshape(-1).view(np.uint8), (np.cumsum(counts) - counts) * x.itemsize * FEATURES, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), rows], names=["doc_id", "label", "x"])

    chosen = met.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in taken], "key long")), key == F.col("key"), "left_semi")
    rows = chosen.mapInArrow(describe, "doc_id long, label double, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["x"])))
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(np.concatenate(parts), np.array([len(p) for p in parts]), np.array([r["label"] for r in rows], dtype=np.float32))


def whole_documents(drawn: list[tuple[int, int, int]], most: int) -> list[int]:
    """Keys of the (draw, key, passages) in order that have ``most`` passages together; what doesn't fit is passed over."""
    taken, held = [], 0
    for _, key, n in drawn:
        if held + n <= most:
            taken.append(key)
            held += n
    return taken


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score double (0 to 1, higher: better) and predicted int. The model is a few KB."""
    common.bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    @F.arrow_udf("double")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(scores(texts, shipped.value))
        common.released()

    judged = judged.asNondeterministic()  # else a filter on its result makes Spark score each text twice, in a worker more a task
    made = docs.withColumn("__score", judged(F.col(text).cast("string")))
    return made.select(*(made[c] for c in kept), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text")
    model = learned(docs, common.read_table(spark, sf_dir, "labels", "doc_id", "quality"))
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", (common.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
