import random

import numpy as np
import xxhash
from conftest import sentence
from pyspark.sql import functions as F

from pointloom.llm import simhash as s


def plain_fingerprint(text, size):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    size = min(size, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), seed=42) for i in range(len(words) - size + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(values, radius):
    parent = list(range(len(values)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(values))]


def test_fingerprints():
    for text in ("", " ", "One", "one two THREE four five", "é ñ É the the the the the the"):
        assert s.fingerprint(text, 4) == plain_fingerprint(text, 4)


def test_query(spark, odd, odd_rows, folder):
    got = s.op7_simhash(spark, folder(documents=odd)).toPandas()
    prints = [plain_fingerprint(t or "", 4) for _, t, *_ in odd_rows]
    classes = plain_classes(prints, 4)
    ids = [i for i, *_ in odd_rows]
    want = []
    for i, p, c in zip(ids, prints, classes, strict=True):
        own = [x for x, k in zip(ids, classes, strict=True) if k == c and x is not None]
        want.append((i if i is not None else -1, f"{p:016x}", min(own) if own else -1))
    have = [(-1 if r.doc_id != r.doc_id else int(r.doc_id), r.fingerprint, -1 if r.component_id != r.component_id else int(r.component_id)) for r in got.itertuples()]
    assert sorted(have) == sorted(want)
    assert s.op7_simhash(spark, folder(documents=odd.limit(0))).count() == 0


def chained(n, seed=0):
    """Clusters of fingerprints that hang together by few bits, and strangers."""
    rng = random.Random(seed)
    out = []
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(n):
            out.append(x)
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
    return sorted({*out, *(rng.getrandbits(64) for _ in range(3 * n))})


def test_links_against_all_pairs_with_and_without_hot_buckets(spark):
    values = chained(40)
    df = spark.createDataFrame([(s._signed(v),) for v in values], "fp long")
    want = plain_classes(values, 4)
    for hot in (20_000, 5):
        roots = {r.node: r.root for r in s.components(s.links(df, 4, hot)).collect()}
        have = [roots.get(s._signed(v), s._signed(v)) for v in values]
        assert len(set(zip(want, have, strict=True))) == len(set(want)) == len(set(have)), hot


def test_stars_equal_all_pairs():
    values = np.array(chained(60, 1), dtype=np.uint64)
    ids = np.arange(len(values), dtype=np.int64)
    found = s.stars(ids, values[:, None], 4, s.pivots())
    assert found.tolist() == plain_classes(values.tolist(), 4)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 900)], "a long, b long")
    roots = {r.node: r.root for r in s.components(edges).collect()}
    assert {roots[i] for i in range(301)} == {0} and roots[1000] == 900
    assert s.components(edges.limit(0)).count() == 0


def near_copy(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(9)
    rows, n = [], 0
    for _ in range(25):
        base = " ".join(f"t{rng.randrange(10**6)}" for _ in range(200))
        for text in (base, base, near_copy(rng, base, 2), near_copy(rng, base, 3)):
            rows.append((n, text, "en", "s", len(text)))
            n += 1
    alone = [(1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(200)), "en", "s", 1) for i in range(100)]
    df = spark.createDataFrame(rows + alone, "doc_id long, text string, lang string, source string, n_chars long")
    for hot in (20_000, 2):
        kept = {r.doc_id for r in s.near_duplicates(df, hot=hot).groupBy("component").agg(F.min("doc_id").alias("doc_id")).collect()}
        assert kept == {*range(0, 100, 4), *range(1000, 1100)}, hot
    out = s.deduplicated(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {*range(0, 100, 4), *range(1000, 1100)}


def test_links_are_those_of_the_exact_likeness(spark):
    """Copies with more and more changed words: classes are the components of all pairs at 0.8 or more."""
    rng = random.Random(4)
    texts = []
    for _ in range(6):
        base = " ".join(f"t{rng.randrange(10**6)}" for _ in range(150))
        texts += [base, *(near_copy(rng, base, n) for n in (1, 2, 3, 3, 4, 5, 7, 9))]
    sets = [set(s.shingle_hashes(t, 5).tolist()) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if x in (a, b) else x for x in parent]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (20_000, 8):
        found = {r.doc_id: r.component for r in s.near_duplicates(df, hot=hot).collect()}
        pairs = set(zip(parent, (found[i] for i in range(len(texts))), strict=True))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}), hot


def test_a_repeated_line_neither_merges_nor_parts(spark):
    """Texts that differ beside one shingle that outnumbers all others; near copies of which one repeats a line; and
    the smallest sets at 0.8 (5 and 4 shingles)."""
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, "0 " * 300 + fresh(40)) for i in range(20)]
    for i in range(100, 140, 2):
        text = fresh(250) + "\nsee the notes of this page"
        rows += [(i, text), (i + 1, text + "\nsee the notes of this page" * 100)]
    for i in range(200, 400, 2):
        text = fresh(9)
        rows += [(i, text), (i + 1, text.rsplit(" ", 1)[0])]
    out = s.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == {*range(20), *range(100, 140, 2), *range(200, 400, 2)}


def test_exact_likeness_few_and_many():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype("<u4")) for _ in range(100)] + [np.empty(0, "<u4")] * 2
    o = s.Overlaps(sets)
    near = np.arange(102)
    many = o.likeness(3, near)
    few = np.concatenate([o.likeness(3, near[i : i + 10]) for i in range(0, 102, 10)])
    want = [len(set(sets[3]) & set(x)) / len(set(sets[3]) | set(x)) for x in sets]
    assert np.allclose(many, want) and np.allclose(few, want)
    assert o.likeness(100, np.array([101])).tolist() == [1.0]


def test_deduplication_of_odd_rows(spark, odd):
    out = s.deduplicated(odd).toPandas()
    ids = out.doc_id.dropna().astype(int).tolist()
    assert len(ids) == len(set(ids)) and 25 not in ids and 26 not in ids and 24 in ids and out.doc_id.isna().sum() == 1
    assert s.deduplicated(odd.limit(0)).count() == 0


def test_long_text():
    assert s.fingerprint(sentence(random.Random(0), 70_000), 4) == plain_fingerprint(sentence(random.Random(0), 70_000), 4)


def test_recall_on_documents_against_all_pairs(spark):
    """The classes of 1,000 documents are exactly the components of all pairs at a likeness of 0.8 or more."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = [np.unique(s.shingle_hashes(r.text or "", s.SHINGLE)) for r in rows]
    holders = {}
    for i, x in enumerate(sets):
        for h in x.tolist():
            holders.setdefault(h, []).append(i)
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = 0
    for i, x in enumerate(sets):
        both = np.bincount([j for h in x.tolist() for j in holders[h] if j < i] or [0], minlength=len(sets)) if len(x) else np.array([len(y) == 0 for y in sets]) * 1
        for j in np.flatnonzero(both[:i]).tolist():
            if not len(x) or both[j] >= 0.8 * (len(x) + len(sets[j]) - both[j]):
                pairs += 1
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    found = {r.doc_id: r.component for r in s.near_duplicates(docs).collect()}
    met = {(top(i), found[r.doc_id]) for i, r in enumerate(rows)}
    assert pairs > 50 and len(met) == len({a for a, _ in met}) == len({b for _, b in met})


def test_batches_of_texts_are_bounded_in_bytes(spark):
    from pointloom.llm import common

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(i, f"{i} " * 2_000) for i in range(40)], "doc_id long, text string")
    for work, n in ((lambda: s.with_fingerprints(docs, 4), 40), (lambda: s.deduplicated(docs), 40)):
        spark.conf.unset(key)
        assert work().count() == n and spark.conf.get(key) == str(common.BATCH_BYTES)
