"""Mixing, top-k, license scans, the pipeline, and all SQL twins."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pointloom.llm import balltree, licenses, mixing, registry


# -- mixing


def test_poisson_inversion(spark):
    df = spark.createDataFrame([(i, f"s{i % 2}", "x" * (1 if i % 2 else 3)) for i in range(4000)], "doc_id long, source string, text string")
    table = {r.mix_source: r for r in mixing.rates(df, {"s0": 1.0, "s1": 3.0}).collect()}
    assert math.isclose(table["s0"].rate, 8000 * 0.25 / 6000) and math.isclose(table["s1"].rate, 8000 * 0.75 / 2000)
    for r in table.values():
        term, total = math.exp(-r.rate), 0.0
        for k in range(8):
            total += term
            assert math.isclose(r.cdf[k], total)
            term *= r.rate / (k + 1)
    out = mixing.mixed(df, {"s0": 1.0, "s1": 3.0})
    n = collections.Counter(r.source for r in out.collect())
    assert abs(n["s0"] / 2000 - 1 / 3) < 0.05 and abs(n["s1"] / 2000 - 3) < 0.15
    assert out.select("doc_id", "replica").distinct().count() == out.count()


def test_mixing_odd_rows(spark, odd):
    out = mixing.mixed(odd)
    assert out.columns == [*odd.columns, "replica", "shuffle_key"]
    assert mixing.mixed(odd, {}).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0
    assert out.exceptAll(mixing.mixed(odd.repartition(5))).count() == 0
    keys = [r.shuffle_key for r in out.coalesce(1).sortWithinPartitions("shuffle_key").collect()]
    assert keys == sorted(keys)
    huge = mixing.mixed(spark.createDataFrame([(1, "a", "x"), (2, "b", "y" * 50_000)], "doc_id long, source string, text string"), {"a": 1.0})
    assert 49_000 < huge.count() < 51_100


# -- top-k


def plain_top(rows, k):
    good = [(i, np.floor(64 * np.array(v, dtype=float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        v = min((v for i, v in good if i == q), key=lambda v: v.astype("<f8").tobytes())
        scored = sorted((-int(sum(int(a) * int(b) for a, b in zip(v, w, strict=False))), i) for i, w in good if i != q)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 8)]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 340)] + [(400, None), (401, []), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, [1.0] * 8), (5, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    points = balltree.quantised(df)
    want = plain_top(rows, 7)
    for shard, block, group in ((10_000, 10_000, 1_000), (40, 5, 3)):
        got = collections.defaultdict(list)
        for r in balltree.top_k(points, points.where("vec_id % 20 = 0"), 7, shard, block, group).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert got == want
    assert balltree.top_k(points.limit(0), points.limit(0), 3).count() == 0
    few = points.where("vec_id IN (0, 1, 2)")
    assert balltree.top_k(few, few.where("vec_id = 0"), 20).count() == 2


def test_empty_and_short_vectors_take_part(spark, folder):
    """An empty vector scores 0 with all; the query and its SQL agree."""
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, []), (3, [-1.0, -1.0]), (4, [0.5, 0.0, 9.0]), (20, []), (40, [-3.0]), (None, [1.0]), (5, None), (6, [None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    at = folder(embeddings=df)
    got = sorted(map(tuple, balltree.op9_top_k(spark, at).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{at}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.execute(balltree.OP9_SQL).fetchall())
    assert {(q, v) for q, _, v, s in got if q == 20 and s == 0} == {(20, i) for i in (0, 1, 2, 3, 4, 40)}


def test_large_components():
    a = np.array([[2.0**40, 1.0], [-(2.0**40), 0.0]])
    assert balltree.inner(a, a).tolist() == [[(1 << 63) - 1, -(1 << 63)], [-(1 << 63), (1 << 63) - 1]]


def test_tree_prunes():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(-5, 5, (2000, 4)) + c for c in ([0, 0, 0, 0], [900, 0, 0, 0], [0, 900, 0, 0])]).astype(float)
    tree = balltree.Tree(points, 64)
    assert sorted(tree.order.tolist()) == list(range(6000))
    for node in range(len(tree.center)):
        low, high = tree.runs[node]
        assert np.sqrt(((points[tree.order[low:high]] - tree.center[node]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-9


# -- licenses


def plain_scan(text):
    """The rules one by one in Python, suppression by comparing all pairs."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line = " " + " ".join(words) + " "
    base, at = set(), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += hits
        base |= {label} if hits else set()
    found = []
    for label, keyword, pattern, priority, weight in licenses.rules():
        if any(k in line for k in licenses.keywords_of(label, keyword)) and re.search(licenses.GATE, line):
            for m in re.finditer(f"(?<= )((?:{pattern}))(?= )", line):
                first = line[: m.start()].count(" ") - 1
                found.append((first, first + m[0].count(" "), priority, weight, label))
    kept = [
        d for d in set(found)
        if not any(e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or (e[2] == d[2] and ((e[0], e[1]) != (d[0], d[1]) or e[4] < d[4]))) for e in set(found))
    ]
    score = max([d[3] for d in kept] + ([0.6] if base else [0.0]))
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[4] for d in kept})), score, sorted(found)


TEXTS = [
    None, "", "...", "plain words only", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License. under the MIT license under the mit license", "CC BY-NC 4.0 or cc-by-nc-sa; CC-BY",
    "This work is licensed under the GNU General Public License, version 3. All rights reserved.", "SPDX-License-Identifier: Apache-2.0", "GNU Lesser General Public License v2.1 and GNU Affero General Public License version 3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "subject to the terms of the Mozilla Public License, v. 2.0", "https://creativecommons.org/licenses/by-nc/4.0/ BSD-3-Clause license",
    "Tous droits réservés", "BSD Zero Clause License; 0BSD", "The Software shall be used for Good, not Evil.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "apache license " * 3000 + "version 2", "under the mit license " * 2000, "UNDER THE MIT LICENSEK under the mİt license", "dedicated to the public domain; CC0 1.0 Universal",
]


def test_license_scan_against_plain_rules(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x"), (None, TEXTS[5], "x")], "doc_id long, text string, labels string")
    got = licenses.scan(df)
    assert got.columns == ["doc_id", "text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    for r in got.collect():
        found = sorted((d.first, d.last, d.priority, d.weight, d.label) for d in r.detections)
        have = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, found)
        assert have == plain_scan(r.text), (r.text or "")[:80]
    assert licenses.scan(df.limit(0)).count() == 0


def test_rules_are_many_and_gated():
    rules = licenses.rules()
    assert len(rules) > 250
    samples = {re.sub(r"\([^()]*\)\??|\[([^\]])[^\]]*\]|\?", lambda m: m[1] or "", p) for *_, p, _, _ in [(r[0], r[1], r[2], r[3], r[4]) for r in rules]}
    assert samples


def shortest(tree):
    """All shortest strings of a parsed pattern: each alternative, each sign of a class, optional parts left out."""
    out = [""]
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            more = [chr(value)]
        elif name == "ANY":
            more = ["a"]
        elif name == "IN":
            more = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in value]
        elif name == "SUBPATTERN":
            more = shortest(value[-1])
        elif name == "BRANCH":
            more = [x for branch in value[1] for x in shortest(branch)]
        elif name == "MAX_REPEAT":
            more = [""] if not value[0] else [x * value[0] for x in shortest(value[2])]
        else:
            raise ValueError(name)
        out = [a + b for a in out for b in more]
    return out


def test_every_pattern_implies_a_keyword_and_the_gate():
    from re import _parser

    for label, keyword, pattern, *_ in licenses.rules():
        for text in shortest(_parser.parse(pattern)):
            assert re.fullmatch(pattern, text) and re.search(licenses.GATE, text), (label, text)
            assert any(k in text for k in licenses.keywords_of(label, keyword)), (label, text)


def test_alternative_names_are_found(spark):
    names = {"gpl": "GNU GPL", "lgpl": "GNU LGPL", "mit": "Expat License", "cddl": "Common Development and Distribution License", "cc0": "Creative Commons Zero", "libpng": "PNG Reference Library License", "psf": "PSF License"}
    df = spark.createDataFrame([(label, f"Released under the {name}.") for label, name in [*names.items(), ("mit", "X11 license"), ("0bsd", "Zero Clause BSD"), ("bsd", "BSD style license")]], "want string, text string")
    assert [(r.want, r.labels) for r in licenses.scan(df).collect() if r.want != r.labels] == []


# -- the whole


def test_oracle_twins(spark, small):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    for name, sql in registry.ORACLE_SQL.items():
        found, want = registry.QUERIES[name](spark, small).toPandas(), con.execute(sql).df()
        assert sorted(found.columns) == sorted(want.columns), name
        one = lambda x: "null" if pd.isna(x) else f"{float(x):.12g}" if isinstance(x, (int, float)) else str(x)
        plain = lambda f: sorted(tuple(map(one, r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False, name=None))
        assert plain(found) == plain(want), name


def test_pipeline(spark, small):
    import corpus_pipeline as cp
    from pointloom.llm import common

    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    for name, stage in cp.STAGES:
        out = common.written(stage(spark, docs, small), f"test-{name}")
        if name != cp.STAGES[-1][0]:
            assert out.columns == names
        docs = out
    assert docs.where("NOT decoded_ok").count() == 0 and docs.count() > 50
    again = cp.run(spark, small)
    assert again.drop("ids").exceptAll(docs.drop("ids")).count() == 0


def test_pipeline_on_odd_rows(spark, odd_rows, folder):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in odd_rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    at = folder(documents=docs, labels=labels)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, at).count() >= 0, name
        assert stage(spark, docs.limit(0), at).count() == 0, name


def test_stages_leave_columns_alone(spark, folder, odd_rows):
    """Columns named like an operator's own keep their values, and stages that can learn nothing keep all rows."""
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(*r, 0.9) for r in odd_rows], "doc_id long, text string, lang string, source string, score double")
    for c in ("bits", "lang_pred", "predicted", "replica", "shuffle_key"):
        docs = docs.withColumn(c, F.lit("own"))
    at = folder(documents=docs, labels=spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        assert {(r.score, r.bits, r.lang_pred, r.predicted, r.replica, r.shuffle_key) for r in out.collect()} <= {(0.9, *["own"] * 5)}, name
    bare = folder(labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert cp.keep_quality(spark, docs, bare).count() == len(odd_rows)
    assert cp.keep_known_languages(spark, docs.withColumn("lang", F.lit(None).cast("string")), bare).count() == len(odd_rows)


CLASHING = ["cdf", "rate", "mix_source", "gone_id", "gone_hash", "again_id", "again_hash", "__words", "__at", "__held", "__score", "__lang", "__draw", "__source", "text_hash", "node", "component", "first", "print", "keys", "k", "words", "labels", "detections"]


def test_clashing_names_everywhere(spark, folder, odd_rows):
    """Columns named like what operators use inside stay as they are, in every stage and in the operators themselves."""
    import corpus_pipeline as cp
    from pointloom.llm import toxicity

    docs = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    at = folder(documents=docs, labels=spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int"))
    want = {tuple(f"own {c}" for c in CLASHING)}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns and {tuple(r) for r in out.select(*CLASHING).collect()} == want, name
    mixed = mixing.mixed(docs)
    assert mixed.columns == [*docs.columns, "replica", "shuffle_key"] and {tuple(r) for r in mixed.select(*CLASHING).collect()} == want
    scanned = licenses.scan(docs)
    kept = [c for c in CLASHING if c not in ("labels", "detections")]
    assert {tuple(r) for r in scanned.select(*kept).collect()} == {tuple(f"own {c}" for c in kept)} and scanned.columns.count("labels") == 1
    scored = toxicity.score(docs, toxicity.learned(docs, spark.read.parquet(f"{at}/labels.parquet")))
    assert scored.columns == [*docs.columns, "score", "predicted"] and {tuple(r) for r in scored.select(*CLASHING).collect()} == want


def test_language_of_many_signs_stays_and_random_letters_go(spark):
    import corpus_pipeline as cp

    rng = random.Random(11)
    signs = [chr(0x4E00 + i) for i in range(2_500)]
    chance = [1 / (i + 20) for i in range(2_500)]
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = [(i, "".join(rng.choices(signs, chance, k=rng.randint(80, 400))), "zz", "s") for i in range(150)]
    rows += [(1_000 + i, " ".join(rng.choice(words) for _ in range(60)), "aa", "s") for i in range(150)]
    junk = [(2_000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200)), rng.choice(["aa", None]), "s") for i in range(8)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")
    got = {r.doc_id for r in cp.keep_known_languages(spark, docs, "").select("doc_id").collect()}
    assert got >= {r[0] for r in rows} and len(got & {r[0] for r in junk if r[2] is None}) == 0


def test_top_k_of_long_vectors_keeps_to_its_bytes(spark, monkeypatch):
    """Shards, blocks and groups shrink with the vectors; what goes between the steps has no vectors."""
    rng = np.random.default_rng(12)
    vectors = rng.integers(-9, 9, (90, 40)).astype(float)
    points = spark.createDataFrame([(i, bytearray(v.astype("<f8").tobytes())) for i, v in enumerate(vectors)], "vec_id long, v binary").repartition(3)
    tables, written = {}, balltree.common.written
    monkeypatch.setattr(balltree.common, "written", lambda df, name: tables.setdefault(name, []).append(written(df, name)) or tables[name][-1])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in balltree.top_k(points, points.where("vec_id % 5 = 0"), 4, most_bytes=8 * 40 * 6).collect()}
    assert tables["top-k-going"][-1].columns == ["shard", "block", "places"] and tables["top-k-shards"][0].count() >= 15
    assert max(len(r.vectors) for r in tables["top-k-blocks"][0].collect()) <= 8 * 40 * 12
    for q in range(0, 90, 5):
        best = sorted((-int(vectors[q] @ vectors[j]), j) for j in range(90) if j != q)[:4]
        assert [got[q, i + 1] for i in range(4)] == [(j, -s) for s, j in best]


def test_registered_names():
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in registry.QUERIES) == 1


def test_keys_of_hash_split(spark):
    import zlib

    from pointloom.llm import common

    rows = spark.range(50).select("id", common.fold(F.col("id"), 4).alias("k")).collect()
    assert all(r.k == zlib.crc32(str(r.id).encode()) % 4 for r in rows)
