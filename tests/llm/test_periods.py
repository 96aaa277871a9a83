import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=24, power=3):
    """All runs by comparing each word with the one q words on, for each q; a period that is no smallest one goes."""
    w, out = np.asarray(w, dtype=np.int64), []
    for q in range(1, len(w) // power + 1):
        edge = np.diff(np.concatenate([[0], (w[:-q] == w[q:]).astype(np.int8), [0]]))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            s, m = i, j + q - i
            if m >= max(least, power * q) and not any(q % d == 0 and (w[s : s + m - d] == w[s + d : s + m]).all() for d in range(1, q)):
                out.append((s, m, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    """The query's row by its definition."""
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    code = {x: c for c, x in enumerate(dict.fromkeys(w))}
    runs = brute([code[x] for x in w])
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2])) if runs else None
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())


def some_words(rng, most):
    w, kinds = [], rng.choice([1, 2, 3, 5, 50])
    while len(w) < rng.randint(0, most):
        if rng.random() < 0.5 and w:
            p = rng.randint(1, min(len(w), 15))
            w += (w[-p:] * rng.randint(1, 8))[: rng.randint(1, 60)]
        else:
            w += [rng.randrange(kinds) for _ in range(rng.randint(1, 20))]
    return w


def test_all_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        w = some_words(rng, 120)
        for least, power in ((2, 2), (6, 3)):
            assert periods.runs_of(np.array(w, dtype=np.int32), [(0, len(w))], least, power) == brute(w, least, power)


def test_stretches_of_repeats_hold_every_run():
    rng = random.Random(2)
    texts = [np.array(some_words(rng, 200), dtype=np.int32) for _ in range(600)]
    codes, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    held, before = {}, np.cumsum(sizes) - sizes
    for text, first, last in zip(*periods.repeated(codes, sizes), strict=True):
        held.setdefault(int(text), []).append((int(first - before[text]), int(last - before[text])))
    found = 0
    for i, t in enumerate(texts):
        want = brute(t)
        found += len(want)
        assert periods.runs_of(t, held.get(i, [])) == want
        assert all(any(a <= s and s + m <= b for a, b in held[i]) for s, m, _ in want)
    assert found > 200


def test_automaton_knows_all_substrings():
    rng = random.Random(3)
    for _ in range(50):
        w = [rng.randrange(3) for _ in range(30)]
        length, link, prefixes = periods.automaton(w)
        assert sum(length[v] - length[link[v]] for v in range(2, len(length))) == len({tuple(w[i:j]) for i in range(30) for j in range(i + 1, 31)})
        assert [length[v] for v in prefixes] == list(range(1, 31))


def test_long_texts_take_time_by_their_length():
    rng = random.Random(4)
    block = [rng.randrange(900) for _ in range(7_000)]
    w = np.array(block * 20)
    assert periods.runs_of(w, [(0, len(w))]) == [(0, 140_000, 7_000)]
    w = np.array([0] * 150_000)
    assert periods.runs_of(w, [(0, len(w))]) == [(0, 150_000, 1)]
    a, b = [0], [0, 1]  # many runs, deep and branched
    while len(b) < 80_000:
        a, b = b, b + a
    found = periods.runs_of(np.array(b), [(0, len(b))])
    assert all(m >= max(24, 3 * q) and b[s : s + m - q] == b[s + q : s + m] for s, m, q in found) and len(found) > 1_000


def test_planted_rule():
    assert periods.planted(0, 10).tolist() == [] and periods.planted(5, 11).tolist() == [0, 1, 2, 3, 4]
    at = periods.planted(20, 50).tolist()  # g = 5, a = 5, p = 1 + 15 // 8 = 2
    assert at == [0, 1, 2, 3, 4] + [5 + i % 2 for i in range(15)]


def test_query_equals_definition(spark, folder, odd, odd_rows):
    rng = random.Random(5)
    words = ["a", "b", "c", "Be", "be", "é", "日本", "x.y", "😀"]
    more = [(100 + i, " \n\t\x0b"[i % 4].join(words[c % 9] for c in some_words(rng, 150)), "en", "s") for i in range(120)]
    table = odd.withColumnsRenamed({"score": "n_runs", "labels": "runs", "fp": "start"}).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    got = sorted((tuple(r) for r in periods.op13_periodic_runs(spark, folder(documents=table.repartition(3))).collect()), key=str)
    assert got == sorted((row(r[0], r[1]) for r in odd_rows + more), key=str)
    assert sum(r[1] for r in got) > 30
    assert periods.op13_periodic_runs(spark, folder(documents=table.limit(0))).count() == 0


def test_whole_table_equals_definition(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where(F.length("text") < 8_000).select("doc_id", "text").collect()
    want = {r[0]: row(*r) for r in docs}
    got = [tuple(r) for r in periods.op13_periodic_runs(spark, small).collect()]
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(r == want[r[0]] for r in got if r[0] in want) and any(r[1] for r in got if r[0] in want)


def test_texts_and_runs_of_the_operator(spark):
    text = "x " + "one two three " * 9 + "y"
    (r,) = periods.periodic(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, period int")).collect()
    assert r["collapsed"] == "x one two three y" and [tuple(x) for x in r["runs"]] == [(1, 27, 3)] and r["exponent_milli"] == 9_000
