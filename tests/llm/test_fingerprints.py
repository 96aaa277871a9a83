import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm import fingerprints as f


def plain(text, k, w):
    """Winnowing from its definition."""
    h = f.kgram_hashes(text, k)
    n, chosen = len(h), []
    for s in range(max(1, n - w + 1) if n else 0):
        window = h[s : s + w] >> np.uint64(max(1, (min(w, n) - 1).bit_length()))
        at = s + max(i for i in range(len(window)) if window[i] == window.min())
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return chosen


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é😀", max_size=200), st.integers(1, 9), st.integers(1, 12))
def test_against_definition(text, k, w):
    hashes, at = f.winnow(text, k, w)
    assert at.tolist() == plain(text, k, w)
    assert (hashes == f.kgram_hashes(text, k)[at]).all() if len(at) else not text


def test_rolling_hash_depends_on_the_gram_only():
    a, b = f.kgram_hashes("abcdefgh" * 4, 5), f.kgram_hashes("defgh", 5)
    assert a[3] == b[0] == a[11]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcd", min_size=24, max_size=24), st.text(alphabet="xyz", max_size=60), st.text(alphabet="xyz", max_size=60))
def test_shared_runs_are_met(run, before, after):
    k, w = 8, 17
    a, b = set(f.winnow(before + run + after, k, w)[0].tolist()), set(f.winnow("q" * 30 + run, k, w)[0].tolist())
    assert a & b


def test_query_against_plain_edits(spark, odd, odd_rows, folder):
    got = f.op1_fingerprints(spark, folder(documents=odd)).toPandas()
    rows = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t, *_ in odd_rows))
    assert len(got) == len(rows)
    want = {}
    for n, (_, text, doc_id) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        cut = len(text) // 4
        other = text[: len(text) - cut] + following[:cut] if cut else text
        want.setdefault(doc_id, []).append((len(text), hashlib.sha256(other.encode()).hexdigest()))
    for doc_id, own in want.items():
        have = got[got.doc_id.isna()] if doc_id is None else got[got.doc_id == doc_id]
        assert sorted(zip(have.n_chars, have.edited_sha256, strict=True)) == sorted(own)
    same = got[got.doc_id.isin([24, 25])].fingerprint
    assert same.nunique() == 1
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert f.op1_fingerprints(spark, folder(documents=odd.limit(0))).count() == 0


def test_one_document_follows_itself(spark, folder):
    df = spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")
    row = f.op1_fingerprints(spark, folder(documents=df)).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0


def test_operator_keeps_positions(spark, odd):
    out = f.document_fingerprints(odd)
    assert set(out.columns) == {*odd.columns, "hashes", "positions"}
    row = out.where("doc_id = 0").first()
    h, p = f.winnow(row.text)
    assert row.positions == p.tolist() and row.hashes == h.view(np.int64).tolist()


def test_stretches_make_no_difference(monkeypatch):
    rng = np.random.default_rng(5)
    for text in ("".join(rng.choice(list("abé日"), 700)), "a" * 500, "ab" * 300 + "".join(rng.choice(list("xyz"), 300)), "", "short"):
        monkeypatch.setattr(f, "STRETCH", 1 << 18)
        want = f.winnow(text, 5, 9)
        for size in (1, 7, 64):
            monkeypatch.setattr(f, "STRETCH", size)
            got = f.winnow(text, 5, 9)
            assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1]), (text[:20], size)


def test_batches_of_texts_are_bounded_in_bytes(spark):
    """Spark counts rows of a batch, and rows of long texts are any size: the report bounds its batches' bytes, and none is lost."""
    from pointloom.llm import common, fingerprints

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.createDataFrame([(i, f"{i} " * 2_000) for i in range(40)], "doc_id long, text string")
    assert fingerprints.edit_report(docs).count() == 40 and spark.conf.get(key) == str(common.BATCH_BYTES)
