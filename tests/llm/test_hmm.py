import collections
import itertools
import zlib

import numpy as np
import pytest

from pointloom.llm import hmm


def toy(states=3, seed=0):
    rng = np.random.default_rng(seed)
    emit = rng.random((hmm.SYMBOLS, states))
    start, step = rng.random(states), rng.random((states, states))
    return hmm.Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


@pytest.mark.parametrize("piece", [1, 2, 3, 100])
def test_forward_and_counts_against_all_paths(piece):
    m, rng = toy(), np.random.default_rng(1)
    sizes = np.array([4, 1, 3, 7])
    symbols = rng.integers(0, hmm.SYMBOLS, sizes.sum()).astype("<u2")
    found = hmm.forward(symbols, sizes, m, piece)
    starts, steps, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.SYMBOLS, 3))
    for i, n in enumerate(sizes):
        s = symbols[sizes[:i].sum() : sizes[: i + 1].sum()]
        paths = {}
        for p in itertools.product(range(3), repeat=int(n)):
            v = m.start[p[0]] * m.emit[s[0], p[0]]
            for t in range(1, n):
                v *= m.step[p[t - 1], p[t]] * m.emit[s[t], p[t]]
            paths[p] = v
        total = sum(paths.values())
        assert np.isclose(found[i], np.log10(total))
        for p, v in paths.items():
            starts[p[0]] += v / total
            for t in range(n):
                emits[s[t], p[t]] += v / total
                if t:
                    steps[p[t - 1], p[t]] += v / total
    a, b, c = hmm.expected(symbols, sizes, m, piece)
    assert np.allclose(a, starts, atol=1e-5) and np.allclose(b, steps, atol=1e-5) and np.allclose(c, emits, atol=1e-5)


def test_states_sum_to_one():
    v = hmm.Vocabulary(100, 20, 5, {"a": 0}, np.array([50.0] + [0.0] * (hmm.FREQUENT - 1)), np.stack([np.eye(1, hmm.CLASSES, 3)[0] * 45, np.eye(1, hmm.CLASSES, 3)[0] * 18, np.eye(1, hmm.CLASSES, 3)[0] * 4]))
    m = hmm.first_model(v)
    mass = hmm.class_mass(v)
    known = (v.sums[0] + v.sums[1]) / mass
    whole = m.emit[: hmm.FREQUENT].sum(axis=0) + (m.emit[hmm.FREQUENT : hmm.END] * known[:, None]).sum(axis=0) + m.emit[hmm.END] + m.emit[hmm.UNKNOWN]
    assert np.allclose(whole, 1)


def test_pieces_of_long_texts_lose_nothing():
    m, rng = toy(5, 3), np.random.default_rng(2)
    sizes = np.array([40_000, 1, 300, 9_000])
    symbols = rng.integers(0, hmm.SYMBOLS, sizes.sum()).astype("<u2")
    whole = 10**9
    assert np.allclose(hmm.forward(symbols, sizes, m, 700), hmm.forward(symbols, sizes, m, whole), rtol=1e-10)
    for a, b in zip(hmm.expected(symbols, sizes, m, 700), hmm.expected(symbols, sizes, m, whole), strict=True):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-3)


def test_query(spark, odd, odd_rows, folder):
    got = hmm.op3_hmm_scores(spark, folder(documents=odd)).toPandas()
    assert len(got) == len(odd_rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = [(i, (t or "").encode().lower().split()) for i, t, *_ in odd_rows]
    c, ends = collections.Counter(), 0
    for i, w in words:
        if not held(i):
            c.update(w)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    want = collections.Counter()
    for i, w in words:
        base = sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w) + np.log10((ends + 1) / (n + v + 1))
        want[(i, held(i), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 6))] += 1
    have = collections.Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples())
    assert have == want
    assert np.isfinite(got.score).all() and (got.score < 0).all()
    assert got.score.sum() > got.base_score.sum()
    assert hmm.op3_hmm_scores(spark, folder(documents=odd.limit(0))).count() == 0


def test_no_training_rows(spark, odd):
    from pyspark.sql import functions as F

    got = hmm.language_model_scores(odd.where("doc_id < 5").withColumn("held", F.lit(True))).collect()
    assert len(got) == 5 and all(r.base_score == 0 and r.n_known == 0 and np.isfinite(r.score) for r in got)


def test_equal_blocks(spark):
    """One row many times over, in partitions of its own: blocks are equal, counts are of all of them."""
    from pyspark.sql import functions as F

    df = spark.range(4, numPartitions=4).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b a").alias("text"), F.lit(False).alias("held"))
    got = hmm.language_model_scores(df).collect()
    assert len(got) == 4 and {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(4, 4, 16)}
    assert all(np.isclose(r.base_score, 2 * np.log10(9 / 20) + 2 * np.log10(5 / 20)) for r in got)


def test_rounds_see_all_training_tokens(spark, monkeypatch):
    """Each training document is in one round by shares, whole, and in all after them."""
    from pyspark.sql import functions as F

    seen, whole = [], hmm.gathered

    def watched(data, model):
        rows = data.select("held", "sizes").collect()
        seen.append(sum(n + 1 for r in rows for h, n in zip(r.held, r.sizes, strict=True) if not h))
        return whole(data, model)

    monkeypatch.setattr(hmm, "gathered", watched)
    texts = [(1, "the cat sat on a mat " * 500), (2, "a dog ran"), (3, "the end"), *((i, "one more " + "text " * i) for i in range(4, 60))]
    hmm.language_model_scores(spark.createDataFrame(texts, "doc_id long, text string").withColumn("held", F.col("doc_id") == 3))
    total = 3001 + 4 + sum(3 + i for i in range(4, 60))
    by_share, rest = seen[: len(hmm.SHARES)], seen[len(hmm.SHARES) :]
    assert rest == [total] * hmm.ROUNDS and sum(by_share) == total and max(by_share) < total


def test_a_round_without_training_rows_keeps_the_model(spark):
    v = hmm.Vocabulary(100, 20, 5, {"a": 0}, np.array([50.0] + [0.0] * (hmm.FREQUENT - 1)), np.zeros((3, hmm.CLASSES)))
    none = spark.createDataFrame([([True], [1], hmm.squeezed(np.zeros(2, '<u2')), 0)], "held array<boolean>, sizes array<int>, symbols binary, share int")
    assert hmm.gathered(none, hmm.first_model(v)) is None
    assert np.array_equal(hmm.train(none, v).emit, hmm.first_model(v).emit)
