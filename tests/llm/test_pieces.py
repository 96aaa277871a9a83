import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm import pieces

PATH = pieces.model_path()


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(PATH)


def plain(m, text):
    """Viterbi over the whole text at once."""
    best, back = [0.0] + [-np.inf] * len(text), [None] * (len(text) + 1)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - m.longest), j):
            node = 0
            for c in text[i:j]:
                node = m.trie[node].get(c, -1)
                if node < 0:
                    break
            piece = m.piece_at[node] if node > 0 else -1
            if piece >= 0:
                score, ids = best[i] + m.scores[piece], (piece,)
            elif j == i + 1:
                score, ids = best[i] + m.unknown_score, m.fallback(text[i])
            else:
                continue
            if score > best[j]:
                best[j], back[j] = score, (i, ids)
    out, j = [], len(text)
    while j:
        j, ids = back[j]
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]


TEXT = st.text(alphabet=st.one_of(st.sampled_from("  \n\tabcdethionrs▁éß日😀.,$&!"), st.characters(codec="utf-8")), max_size=80)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_against_whole_viterbi(text):
    m = pieces.pieces(PATH)
    line = pieces.BLANK + text.replace(" ", pieces.BLANK) if text else ""
    want = plain(m, line)
    ids, counts = m.encode(pa.array([None, text, "", text]))
    assert ids.tolist() == want + want and counts.tolist() == [0, len(want), 0, len(want)]
    assert [i for run in m.stream(line) for i in run] == want
    assert m.decode(want) == text.replace(pieces.BLANK, " ") == m.decode_all(np.array(want, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("tionhe s▁日の.a"), st.characters(codec="utf-8")), min_size=1, max_size=400), min_size=1, max_size=5))
def test_solver_commits_in_windows(stretches):
    """Stretches of several windows, side by side, any signs."""
    m = pieces.pieces(PATH)
    ids, counts = m.solve(stretches)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [plain(m, s) for s in stretches]


@pytest.mark.parametrize("text", ["tion" * 2000, "x" * 3000, "日本語の" * 700, "ab" * 40 + "é" + "=" * 1000])
def test_solver_on_long_stretches(model, text):
    for s in (text, pieces.BLANK + text):
        ids, counts = model.solve([s, "the"])
        assert ids[: counts[0]].tolist() == [i for run in model.stream(s) for i in run]


def test_stream_commits_early(model):
    runs = list(model.stream(pieces.BLANK + pieces.BLANK.join(["the", "quick", "station"] * 50)))
    assert len(runs) > 100 and max(map(len, runs)) < 12


def test_stream_window_is_bounded(model):
    assert sum(map(len, model.stream(pieces.BLANK + "tion" * 5000))) > 4000


def test_query(spark, odd, odd_rows, folder):
    got = pieces.op6_sentencepiece(spark, folder(documents=odd)).toPandas()
    assert len(got) == len(odd_rows) and got.decoded_ok.all()
    assert (got[got.n_chars == 0].n_pieces == 0).all()
    assert pieces.op6_sentencepiece(spark, folder(documents=odd.limit(0))).count() == 0


def test_operators_round_trip(spark, odd):
    coded = pieces.encode(odd, PATH)
    back = pieces.decode(coded, PATH)
    assert coded.columns == [*odd.columns, "ids"]
    assert back.where("decoded <> coalesce(text, '')").count() == 0


def test_one_pass_equals_encoding_and_decoding(spark, odd):
    path = pieces.model_path()
    one = sorted((tuple(r) for r in pieces.checked(odd.select("doc_id", "text", "score"), path).collect()), key=str)
    two = pieces.decode(pieces.encode(odd.select("doc_id", "text", "score"), path), path).collect()
    assert one == sorted(((r.doc_id, r.text, r.score, r.ids, r.decoded == (r.text or "").replace(pieces.BLANK, " ")) for r in two), key=str)
    assert all(r[4] for r in one)
