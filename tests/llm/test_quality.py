import random
import zlib

import numpy as np
import pyarrow as pa
from conftest import sentence

from pointloom.llm import common, quality


def test_gradients():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 2, 4])
    x = rng.normal(0, 1, (10, quality.FEATURES)).astype(np.float32)
    labels = np.array([1, 0, 1, 0], dtype=np.float32)
    m = quality.fit(x, counts, labels, epochs=80)
    p = quality.forward(m, ((x - m.mean) / m.scale).astype(np.float32), counts)
    assert ((p[0] > 0.5) == (labels > 0.5)).all()
    starts = np.cumsum(counts) - counts
    assert np.allclose(np.add.reduceat(p[4], starts), 1, atol=1e-5) and (p[4] >= 0).all()


def small_model(rng, features=6, code=3, gate=2):
    w = {"E": rng.normal(0, 1, (features, code)), "e": rng.normal(0, 1, code), "V": rng.normal(0, 1, (code, gate)), "U": rng.normal(0, 1, (code, gate)), "a": rng.normal(0, 1, gate), "c": rng.normal(0, 1, code), "b": rng.normal(0, 1, 1)}
    return quality.Model(np.zeros(features), np.ones(features), w)


def plain_score(w, bag):
    """Gated attention over one document's passages, one by one."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    codes = [np.tanh(p @ w["E"] + w["e"]) for p in bag]
    power = [np.exp(sum(a * np.tanh(h @ w["V"])[i] * sigmoid(h @ w["U"])[i] for i, a in enumerate(w["a"]))) for h in codes]
    whole = sum(p / sum(power) * h for p, h in zip(power, codes, strict=True))
    return float(sigmoid(whole @ w["c"] + w["b"])[0])


def test_attention_against_one_document_at_a_time():
    rng = np.random.default_rng(3)
    m, counts = small_model(rng), np.array([1, 4, 2, 7])
    x = rng.normal(0, 1, (counts.sum(), 6))
    ends = np.cumsum(counts)
    want = [plain_score(m.weights, x[e - n : e]) for e, n in zip(ends, counts, strict=True)]
    assert np.allclose(quality.forward(m, x, counts)[0], want)


def test_gradients_against_differences():
    rng = np.random.default_rng(4)
    m, counts, labels = small_model(rng), np.array([2, 1, 3]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(0, 1, (6, 6))

    def loss():
        p = quality.forward(m, x, counts)[0]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for k, g in quality.gradients(m, x, counts, labels).items():
        for at in np.ndindex(m.weights[k].shape):
            was = m.weights[k][at]
            m.weights[k][at] = was + 1e-6
            high = loss()
            m.weights[k][at] = was - 1e-6
            low = loss()
            m.weights[k][at] = was
            assert np.isclose(g[at], (high - low) / 2e-6, atol=1e-7), (k, at)


def test_query_against_one_text_at_a_time(spark, folder):
    """The registered query, passage by passage in plain Python with the model that it learned."""
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.randint(1, 200)) if i % 2 else " ".join(sentence(rng, 60).upper().split()) + " 123 !!") for i in range(60)] + [(60, None), (61, ""), (62, "é日😀 " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.op5_quality_mil(spark, folder(documents=docs, labels=labels)).collect()}
    m = quality.learned(docs, labels)
    for i, text in rows:
        data = (text or "").encode()
        x, counts = quality.passages([data])
        assert counts[0] == max(1, -(-len(data) // quality.PASSAGE)) == len(x)
        want = plain_score({k: w.astype(float) for k, w in m.weights.items()}, (x - m.mean) / m.scale)
        assert abs(got[i].score - want) < 1e-4 and got[i].predicted == (got[i].score >= 0.7)


def test_labels_and_documents_said_twice(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (5 + i)) for i in range(40)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once, often = quality.learned(docs.distinct(), labels), quality.learned(docs, labels.unionByName(labels))
    assert all(np.array_equal(once.weights[k], often.weights[k]) for k in once.weights)


def test_passages_cover_the_text():
    x, counts = quality.passages([b"", b"a" * 319, b"a" * 321, b"one one one two"])
    assert counts.tolist() == [1, 1, 2, 1] and x.shape == (5, quality.FEATURES)
    assert (x[0] == 0).all()
    assert np.isclose(x[4, quality._KINDS + quality._PAIRS], 2 / 4)
    joined, _ = quality.passages([b"abc def"])
    apart, _ = quality.passages([b"zzz", b"abc def", b"def"])
    assert np.allclose(joined[0], apart[1])


def test_query(spark, folder):
    rng = random.Random(4)
    good = [(i, sentence(rng, 80), 1) for i in range(0, 160, 2)]
    bad = [(i, " ".join(w.upper() + "!!" for w in sentence(rng, 80).split()), 0) for i in range(1, 160, 2)]
    extra = [(500, None, None), (501, "", None), (502, "x" * 100_000, None), (None, "no id", None), (0, good[0][1], None)]
    rows = good + bad + extra
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if q is not None] + [(700, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.op5_quality_mil(spark, folder(documents=docs, labels=labels)).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    want = {i: q for i, _, q in good + bad}
    held = got[got.held_out & got.doc_id.isin(want)]
    assert len(held) and (held.predicted == held.doc_id.map(want)).all()
    none = quality.op5_quality_mil(spark, folder(documents=docs, labels=labels.limit(0))).toPandas()
    assert (none.score == 0.5).all()
    assert quality.op5_quality_mil(spark, folder(documents=docs.limit(0), labels=labels)).count() == 0


def test_learning_reads_whole_texts(spark, monkeypatch):
    """All passages of a long text are learned from; documents that together pass the bound are left out whole."""
    docs = spark.createDataFrame([(i, f"text {i} " * (10 if i else 20_000)) for i in range(30)] + [(30, None), (31, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(32)], "doc_id long, quality int")
    sizes = {r.doc_id: max(1, -(-len(r.text or "") // quality.PASSAGE)) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    given = []
    monkeypatch.setattr(quality, "fit", lambda x, counts, labels: given.append((len(x), counts.tolist())))
    quality.learned(docs, labels)
    assert sizes[0] > 128 and given[0] == (sum(sizes.values()), [sizes[i] for i in sorted(sizes)])
    monkeypatch.setattr(quality, "TRAIN_PASSAGES", 12)
    quality.learned(docs, labels)
    assert given[1][0] == sum(given[1][1]) == 12 and sizes[0] not in given[1][1]


def test_taken_documents_are_whole():
    assert quality.whole_documents([(1, 10, 4), (2, 20, 9), (3, 30, 3), (4, 40, 1)], 8) == [10, 30, 40]
    assert quality.whole_documents([], 8) == [] == quality.whole_documents([(1, 1, 9)], 8)


def test_batches_are_bounded_in_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(i, "long text " * 100_000) for i in range(24)], "doc_id long, text string").repartition(1)
    quality.score(docs, quality.Model(np.zeros(1), np.ones(1), {}, 0.5))
    largest = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").agg({"n": "max"}).first()[0]
    assert 1_000_000 <= largest < 2 * common.BATCH_BYTES


def test_operator_replaces_clashing_columns(spark, odd):
    out = quality.score(odd, quality.Model(np.zeros(1), np.ones(1), {}, 0.25))
    assert out.columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"]
    assert {(r.score, r.predicted) for r in out.collect()} == {(0.25, 0)}
