import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pointloom.llm import common, toxicity

BAD = ["blorgish", "snerkle", "fudwit"]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def made(rng, n, first=0):
    """(doc_id, text, toxic): toxic texts hold one or two bad words, some of them long."""
    rows = []
    for i in range(first, first + n):
        words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(rng.choice([5, 40, 400]))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(1, 2) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "s", "."])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_grams_of_words():
    words = ["Ab", "", "x" * 9, "日本語"]
    keys, counts = toxicity.grams(words)
    want = [[f" {w.lower()} "[i : i + n] for n in toxicity.GRAMS for i in range(len(w) + 2 - n + 1)] for w in words]
    assert counts.tolist() == [len(x) for x in want]
    code = {}
    for key, gram in zip(keys.tolist(), [g for x in want for g in x], strict=True):
        assert code.setdefault(gram, key) == key
    assert len(set(code.values())) == len(code)
    assert toxicity.grams([" "])[1].tolist() == [1] and toxicity.grams([])[1].tolist() == []


def test_presence_equals_sets():
    rng = random.Random(1)
    texts = [None, "", " \n", *(" ".join(rng.choice(["toxic", "tonic", "ton", "x"]) for _ in range(rng.randint(0, 9))) for _ in range(30))]
    keys = np.unique(toxicity.grams(["tonic", "xx"])[0])
    text, feature = toxicity.Presence(keys).of(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        words = sorted(set((t or "").lower().split()))
        want = sorted(set(toxicity.grams(words)[0].tolist()) & set(keys.tolist())) if words else []
        assert keys[feature[text == i]].tolist() == want


def test_fit_is_at_the_optimum():
    rng = np.random.default_rng(2)
    present = (rng.random((300, 12)) < 0.3).astype(np.uint8)
    ratios = rng.normal(0, 2, 12)
    toxic = (rng.random(300) < 1 / (1 + np.exp(-(present @ (ratios * 0.7) - 0.5)))).astype(float)
    weight = np.where(toxic > 0, 1.0, 3.0)
    w, b = toxicity.fit(present, ratios, toxic, weight, steps=3_000)
    x, own = present * ratios, w / ratios

    def loss(u, c):
        z = x @ u + c
        return (weight * (np.logaddexp(0, z) - toxic * z)).sum() / weight.sum() + toxicity.RIDGE / 2 * (u**2).sum()

    least = loss(own, b)
    for _ in range(50):
        assert least <= loss(own + rng.normal(0, 0.01, 12), b + rng.normal(0, 0.01)) + 1e-7


def test_held_out_accuracy_and_long_texts(spark):
    rng = random.Random(3)
    rows = made(rng, 900)
    docs = spark.createDataFrame([(i, t, "aside", 4) for i, t, _ in rows], "doc_id long, text string, score string, predicted int").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.learned(docs, labels)).collect()
    truth = {i: y for i, _, y in rows}
    out = [r["predicted"] == truth[r["doc_id"]] for r in got if held(r["doc_id"])]
    assert len(out) > 150 and sum(out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_ratios_and_features_are_those_of_all_drawn_documents(spark):
    rows = made(random.Random(4), 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learned(docs, labels)
    own = [(set(toxicity.grams(sorted(set(t.lower().split())))[0].tolist()), y) for i, t, y in rows if not held(i)]
    n = [sum(y == k for _, y in own) for k in (0, 1)]
    sure = {}
    for key in set().union(*(s for s, _ in own)):
        c = [sum(key in s for s, y in own if y == k) for k in (0, 1)]
        r = np.log((c[1] + 1) / (n[1] + 2)) - np.log((c[0] + 1) / (n[0] + 2))
        z = abs(r) / np.sqrt(1 / (c[1] + 1) + 1 / (c[0] + 1))
        if sum(c) >= toxicity.LEAST and z >= toxicity.SURE:
            sure[key] = z
    assert set(model.keys.tolist()) == set(sure) and len(sure) > 10
    few = toxicity.learned(docs, labels, features=7)
    assert len(few.keys) == 7 and min(sure[k] for k in few.keys.tolist()) >= sorted(sure.values())[-7]


def test_scores_do_not_depend_on_labels_held_out_or_on_order(spark):
    rows = made(random.Random(5), 150)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(common.fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.learned(docs, labels)).collect()}
    two = {r["doc_id"]: r["score"] for r in toxicity.score(docs.repartition(5), toxicity.learned(docs.repartition(7), flipped)).collect()}
    assert one == two


def test_odd_rows_and_odd_labels(spark, folder, odd):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(30)] + [(3, 0, 1), (3, 0, 1), (None, 1, 1), (4, None, 1), (999, 1, 1)], "doc_id long, toxic int, text int")
    for own in (labels, labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        got = toxicity.op12_toxicity(spark, folder(documents=odd, labels=own)).collect()
        assert len(got) == odd.count() and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
        same = [r["score"] for r in got if r["doc_id"] in (20, 21, 22)]
        assert len(same) == 3 and len(set(same)) == 1
    assert {r["score"] for r in toxicity.op12_toxicity(spark, folder(documents=odd, labels=labels.limit(0))).collect()} == {0.0}
    assert {r["score"] for r in toxicity.op12_toxicity(spark, folder(documents=odd, labels=labels.where("toxic = 1"))).collect()} == {1.0}
    assert toxicity.op12_toxicity(spark, folder(documents=odd.limit(0), labels=labels)).count() == 0


def test_held_out_rows_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    got = toxicity.op12_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.95
    assert not any(r["predicted"] for r in got if not r["toxic"])
