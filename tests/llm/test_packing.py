import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pointloom.llm import common, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**17 - 1), max_size=300), st.integers(17, 32))
def test_bits_round_trip(ids, bits):
    data = packing.pack_bits(np.array(ids, dtype=np.uint32), bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert packing.unpack_bits(data, len(ids), bits).tolist() == ids


def test_bits_for():
    assert [packing.bits_for(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_random_access():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 900, 40)
    ids = rng.integers(0, 50_000, counts.sum()).astype(np.uint32)
    shard = packing.Shard(packing.shard_bytes([None, *range(1, 40)], counts, ids, 16, block=128))
    starts = np.concatenate([[0], np.cumsum(counts)])
    for i in (0, 7, 39):
        assert shard.document(i).tolist() == ids[starts[i] : starts[i + 1]].tolist()
    for a, b in ((0, 0), (127, 129), (5, len(ids)), (len(ids) - 1, len(ids))):
        assert shard.read(a, b).tolist() == ids[a:b].tolist()
    assert shard.absent.tolist() == [1] + [0] * 39
    with pytest.raises(ValueError):
        packing.Shard(b"x" * 100)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aAzéÉßÀ×÷.,!<|>0123 ́日😀µªİ\x1c\x85"), st.characters(codec="utf-8")), max_size=60))
def test_encoder_equals_library(text):
    want = Tokenizer.from_file(PATH) if not hasattr(test_encoder_equals_library, "t") else test_encoder_equals_library.t
    test_encoder_equals_library.t = want
    got = packing.encoder(PATH).encode(pa.array([text]))[0].tolist()
    assert got == want.encode(text, add_special_tokens=False).ids


def test_special_strings(library):
    for text in ("a<|endoftext|>b", "x <|startoftext|> it's don't'll", "I'll they've we'd"):
        got = packing.encoder(PATH).encode(pa.array([text]))[0].tolist()
        assert got == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(" \n'aAé.<|>12日"), max_size=12)), max_size=6))
def test_texts_of_a_column_stand_apart(texts):
    enc = packing.encoder(PATH)
    ids, counts = enc.encode(pa.array(["x", *texts], pa.string()).slice(1), end_id=1)
    cuts = np.concatenate([[0], np.cumsum(counts)]).astype(int)
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_small_files(spark, odd):
    """Files of few ids: several a range, read back as one sequence."""
    whole, small = common.new_path(spark, "test-whole"), common.new_path(spark, "test-small")
    rows = []
    for path, most in ((whole, packing.SHARD_IDS), (small, 50)):
        manifest = packing.write_shards(odd, path, PATH, most=most)
        rows.append((manifest.count(), sorted((r.start, r.doc_id or -1, bytes(r.ids)) for r in packing.read_shards(spark, path, manifest).collect())))
    assert rows[0][1] == rows[1][1] and rows[1][0] > rows[0][0]


def test_query(spark, odd, odd_rows, library, folder):
    got = packing.op4_bit_packing(spark, folder(documents=odd)).toPandas()
    rows = sorted(((-1 if i is None else i, i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in odd_rows), key=lambda r: (r[0], np.array(r[2], "<u2").tobytes()))
    want, start = [], 0
    for _, i, ids in rows:
        want.append((-1 if i is None else i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    have = sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got.itertuples())
    assert have == sorted(want)
    assert packing.op4_bit_packing(spark, folder(documents=odd.limit(0))).count() == 0


def test_files_hold_everything(spark, odd):
    path = common.new_path(spark, "test-packed")
    manifest = packing.write_shards(odd, path, PATH)
    back = packing.read_shards(spark, path, manifest)
    assert back.count() == odd.count()
    assert manifest.selectExpr("sum(n_ids)").first()[0] == back.selectExpr("sum(n_tokens)").first()[0]
