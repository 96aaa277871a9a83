"""SentencePiece encoding and decoding by streaming Viterbi.

The model file's pieces and stored scores are used as they are: among all ways to cut a text into
pieces, the one with the highest sum of scores is taken (on ties the cut whose last piece is
longest). A character that is no piece costs the lowest score less ``UNKNOWN`` and becomes its UTF-8
byte pieces. White space is kept: a blank is written as U+2581, one is put before the text, nothing
is normalised, so decoding gives the text back exactly.

The Viterbi state is a window: only the last ``longest piece`` boundaries can still be extended, so a ring of that
many scores is all that the recursion holds. Whenever the back pointers of all paths that survive in the window
run through one boundary, the ids up to it are committed and what stands before it goes.

:meth:`Pieces.solve` walks many stretches of text side by side in numpy, one boundary of each a step. It commits at the
end of a stretch and, in a longer one, every ``STEPS`` boundaries as far as the surviving paths agree. Texts are dealt to
stretches at boundaries at which paths are bound to meet: before a U+2581 that follows another character (no piece
crosses it), and around a sign that no longer piece holds. A worker remembers the ids of short stretches.
:meth:`Pieces.stream` is the same for a text that comes character by character.

Defined results
    * null or empty text has no ids and decodes to the empty text;
    * lone surrogates cannot occur in Spark strings; any other text decodes to itself;
    * repeated rows give repeated results; extra columns are kept by :func:`encode`, ``ids`` replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common

BLANK = "▁"
UNKNOWN = 10.0
#: Stretches that a worker remembers; boundaries walked between two commits; signs walked, and characters encoded, at once.
CACHE, STEPS, SIGNS, WALK = 150_000, 64, 40_000, 1_500_000
_NEGATIVE = -1e300
_CODE = 21  # bits of a code point


class Pieces:
    """Pieces and scores of a model file, as a character trie."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.texts: list[str] = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown_id = model.unk_id()
        self.scores = np.array([model.get_score(i) for i in range(size)])
        plain = [i for i in range(size) if not special[i] and i not in self.byte_of]
        self.longest = max((len(self.texts[i]) for i in plain), default=1)
        self.unknown_score = float(min((self.scores[i] for i in plain), default=0.0)) - UNKNOWN
        self.trie: list[dict[str, int]] = [{}]
        self.piece_at: list[int] = [-1]
        for i in plain:
            node = 0
            for c in self.texts[i]:
                if c not in self.trie[node]:
                    self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.piece_at.append(-1)
                node = self.trie[node][c]
            self.piece_at[node] = i
        inner = {c for i in plain if len(self.texts[i]) > 1 for c in self.texts[i]}
        crossing = any(BLANK in self.texts[i].lstrip(BLANK) for i in plain)
        # stretches: a blank's run with what follows, or one sign that no longer piece holds
        alone = "\n\t\r" if not inner & set("\n\t\r") else ""
        self.alone, self.crossing = alone if not crossing else "", crossing
        self.known = common.IdTable(np.dtype("<u4"), CACHE)
        self._dense()

    def _dense(self) -> None:
        """The trie for :meth:`solve`: a table over Latin-1 and the blank, sorted transitions for all other signs."""
        self.width = 257
        self.ids = np.array(self.piece_at, dtype=np.int32)
        self.gain = np.where(self.ids >= 0, self.scores[self.ids], _NEGATIVE)
        table = np.zeros((len(self.trie), self.width), dtype=np.uint16 if len(self.trie) < 1 << 16 else np.int32)
        other = []
        for node, row in enumerate(self.trie):
            for c, to in row.items():
                if c == BLANK or ord(c) < 256:
                    table[node, 256 if c == BLANK else ord(c)] = to
                else:
                    other.append((node << _CODE | ord(c), to))
        self.table = table.reshape(-1)
        other.sort()
        self.other, self.leads = (np.array([x[i] for x in other], dtype=np.int64) for i in range(2))

    def _onward(self, node: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Trie nodes after one more sign; 0 where there is none."""
        column = np.where(sign == 0x2581, 256, sign)
        plain = column <= 256
        if plain.all():
            return self.table[node * self.width + column].astype(np.int64)
        out = np.zeros(len(node), dtype=np.int64)
        out[plain] = self.table[node[plain] * self.width + column[plain]]
        if len(self.other):
            key = node[~plain] << _CODE | sign[~plain]
            spot = np.minimum(np.searchsorted(self.other, key), len(self.other) - 1)
            out[~plain] = np.where(self.other[spot] == key, self.leads[spot], 0)
        return out

    # -- one stretch, any characters, any length

    def stream(self, text: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text given character by character, committed as soon as no path disagrees.

        ``best[i]``: the score of reaching boundary i; ``back[i]``: where its last piece starts, and
        the piece. Only boundaries from which a piece can still reach the front, and those that
        paths of theirs run through since the last commit, are held.
        """
        best, back = {0: 0.0}, {}
        open_at: list[tuple[int, int]] = []  # (start of a piece in the making, trie node)
        done = at = 0
        for c in text:
            open_at.append((at, 0))
            at += 1
            going = []
            for start, node in open_at:
                to = self.trie[node].get(c)
                if to is not None:
                    going.append((start, to))
                    piece = self.piece_at[to]
                    if piece >= 0 and best[start] + self.scores[piece] > best.get(at, _NEGATIVE):
                        best[at], back[at] = best[start] + self.scores[piece], (start, (piece,))
                if start == at - 1 and (to is None or self.piece_at[to] < 0):
                    score = best[start] + self.unknown_score
                    if score > best.get(at, _NEGATIVE):
                        best[at], back[at] = score, (start, self.fallback(c))
            open_at = going
            live = {start for start, _ in going} | {at}
            meet = self._meeting(live, back, done)
            if meet > done:
                yield self._walked(meet, back, done)
                kept = {meet} | live
                for x in list(live):
                    while x > meet:
                        kept.add(x)
                        x = back[x][0]
                best = {k: v for k, v in best.items() if k in kept}
                back = {k: v for k, v in back.items() if k in kept and k > meet}
                done = meet
        if at > done:
            yield self._walked(at, back, done)

    @staticmethod
    def _meeting(live: set[int], back: dict, done: int) -> int:
        """The last boundary that the best paths to all live boundaries run through."""
        paths = set(live)
        while len(paths) > 1:
            top = max(paths)
            if top <= done:
                return done
            paths.discard(top)
            paths.add(back[top][0])
        return max(paths.pop(), done)

    @staticmethod
    def _walked(to: int, back: dict, since: int) -> list[int]:
        parts = []
        while to > since:
            to, ids = back[to]
            parts.append(ids)
        return [i for ids in reversed(parts) for i in ids]

    def fallback(self, c: str) -> tuple[int, ...]:
        data = c.encode("utf-8", "surrogatepass")
        return tuple(self.bytes[b] for b in data) if all(b in self.bytes for b in data) else (self.unknown_id,)

    # -- many stretches at once

    def _matches(self, signs: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the place where a piece ends: the score and id of the piece of each length, the longest first. ``left``: signs
        from each place to its stretch's end."""
        wide = self.longest
        gain, ids = np.full((len(signs), wide), _NEGATIVE), np.full((len(signs), wide), -1, dtype=np.int32)
        start, node = np.arange(len(signs)), np.zeros(len(signs), dtype=np.int64)
        for length in range(1, wide + 1):
            node = self._onward(node, signs[start + length - 1])
            good = self.ids[node] >= 0
            end = start[good] + length - 1
            gain[end, wide - length], ids[end, wide - length] = self.gain[node[good]], self.ids[node[good]]
            if length == 1:
                gain[~good, wide - 1] = self.unknown_score
            going = (node > 0) & (left[start] > length)
            start, node = start[going], node[going]
            if not len(start):
                break
        return gain, ids

    def solve(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of one sign or more, one after the other, and how many each has."""
        sizes = np.array([len(s) for s in stretches])
        signs = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        gain, ids = self._matches(signs, np.repeat(sizes + first, sizes) - np.arange(len(signs)))
        wide, order = self.longest, np.argsort(-sizes, kind="stable")
        first, n = first[order], sizes[order]
        best = np.full((len(n), wide + STEPS), _NEGATIVE)
        best[:, wide - 1] = 0.0
        chosen: list[tuple[np.ndarray, np.ndarray]] = []  # committed: places where pieces end, and their lengths
        held: dict[int, np.ndarray] = {}  # of a long stretch: lengths of the last pieces at boundaries not committed yet
        for at in range(0, int(n[0]), STEPS):
            alive = int(np.searchsorted(-n, -at, side="left"))  # stretches that go on beyond ``at``
            back = np.zeros((alive, STEPS), dtype=np.int32)
            rows = np.arange(alive)
            for t in range(min(STEPS, int(n[0]) - at)):
                m = int(np.searchsorted(-n, -(at + t), side="left"))
                found = best[:m, t : t + wide] + gain[first[:m] + at + t]
                k = found.argmax(axis=1)
                best[:m, t + wide] = found[rows[:m], k]
                back[:m, t] = wide - k
            ended = int(np.searchsorted(-n, -(at + STEPS), side="left"))  # those from here on have their last boundary
            for i in held.keys() & set(range(ended, alive)):
                lengths = np.concatenate([held.pop(i), back[i, : n[i] - at]])
                chosen.append(self._path(lengths, len(lengths), int(first[i] + n[i]) - len(lengths)))
                back[i] = 0
            spot, row = n[ended:alive] - at, np.arange(ended, alive)
            some = back[row, spot - 1] > 0
            spot, row = spot[some], row[some]
            while len(row):  # back from the ends, one piece of every stretch a step
                length = back[row, spot - 1]
                chosen.append((first[row] + at + spot - 1, length))
                spot = spot - length
                row, spot = row[spot > 0], spot[spot > 0]
            for i in range(ended):
                lengths = np.concatenate([held[i], back[i]]) if i in held else back[i]
                meet = self._meet(lengths)
                chosen.append(self._path(lengths, meet, int(first[i]) + at + STEPS - len(lengths)))
                held[i] = lengths[meet:]
            best[:ended, :wide] = best[:ended, STEPS:]
        place, length = (np.concatenate(c) for c in zip(*chosen, strict=True))
        sort = np.argsort(place)
        place, length = place[sort], length[sort]
        found = ids[place, wide - length]
        row = np.searchsorted(np.cumsum(sizes), place, side="right")
        lone = np.flatnonzero(found < 0)
        if len(lone):  # characters that are no pieces
            bytes_of = [self.fallback(chr(c)) for c in signs[place[lone]].tolist()]
            times = np.ones(len(found), dtype=np.int64)
            times[lone] = [len(b) for b in bytes_of]
            at = (np.cumsum(times) - times)[lone]
            found, row = np.repeat(found, times), np.repeat(row, times)
            found[np.repeat(at, times[lone]) + np.concatenate([np.arange(len(b)) for b in bytes_of])] = [i for b in bytes_of for i in b]
        return found.astype("<u4"), np.bincount(row, minlength=len(stretches))

    def _meet(self, lengths: np.ndarray) -> int:
        """The last boundary (0: where ``lengths`` begins) that the paths to all boundaries of the window run through."""
        paths = set(range(max(0, len(lengths) - self.longest + 1), len(lengths) + 1))
        while len(paths) > 1:
            top = max(paths)
            paths.discard(top)
            paths.add(max(0, top - int(lengths[top - 1])))
        return paths.pop()

    @staticmethod
    def _path(lengths: np.ndarray, to: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where the pieces on the path to a boundary end, and their lengths."""
        ends = []
        while to > 0:
            ends.append(to - 1)
            to -= int(lengths[to - 1])
        at = np.array(ends, dtype=np.int64)
        return at + base, lengths[at]

    def _stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Stretches of all texts (as numbers), how many each text has, and the distinct stretches, with plain blanks. A
        blank goes before each text that isn't empty."""
        data, cuts = common.text_bytes(pc.replace_substring(texts.cast(pa.string()), BLANK, " "))
        some = np.diff(cuts) > 0
        data = np.insert(data, cuts[:-1][some], 32)
        cuts = cuts + np.concatenate([[0], np.cumsum(some)])
        blank, alone = data == 32, np.isin(data, np.frombuffer(self.alone.encode(), np.uint8))
        first = alone.copy()
        if self.crossing:
            first[:] = False
        else:
            first[1:] |= alone[:-1] | (blank[1:] & ~blank[:-1])
        first[cuts[:-1][some]] = True
        at = np.flatnonzero(first)
        coded = common.strings(data, at, pa.string()).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), np.diff(np.searchsorted(at, cuts)), coded.dictionary.to_pylist()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), one after the other, and how many each has."""
        codes, sizes, stretches = self._stretches(texts)
        fresh = sorted((stretches[i] for i in self.known.fresh(stretches)), key=len)
        for first, last in common.slices(np.array([len(s) for s in fresh], dtype=np.int64), SIGNS):
            self.known.learn(fresh[first:last], *self.solve([s.replace(" ", BLANK) for s in fresh[first:last]]))
        return self.known.gathered(codes, stretches, sizes)

    def decode(self, ids: Iterable[int]) -> str:
        """The text; bytes that are no UTF-8 become U+FFFD. The blank put before the text goes."""
        parts: list[bytes] = []
        for i in ids:
            parts.append(bytes([self.byte_of[i]]) if i in self.byte_of else self.texts[i].encode())
        text = b"".join(parts).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text

    def decode_all(self, data: bytes) -> str:
        """As :meth:`decode`, for ids as :meth:`encode` gives them: one lookup in a table an id."""
        if not hasattr(self, "spelled"):
            self.spelled = [bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(self.texts)]
        text = b"".join(map(self.spelled.__getitem__, np.frombuffer(data, "<u4").tolist())).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


_held: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One for each worker process."""
    if path not in _held:
        _held[path] = Pieces(path)
    return _held[path]


def _coded(texts: pd.Series, path: str) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Runs of rows: their texts, all ids, and how many each text has."""
    values = [t or "" for t in texts]
    for first, last in common.slices(np.array([len(v) for v in values]), WALK):
        yield values[first:last], *pieces(path).encode(pa.array(values[first:last], pa.string()))
    pa.default_memory_pool().release_unused()


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ids binary (little-endian unsigned 32-bit). A map over rows: nothing is shuffled.

    A text that itself holds U+2581 could not be told from one with blanks; its ids are exact, and its
    decoded form has a blank there.
    """

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        out = []
        for _, found, counts in _coded(texts, path):
            data, cuts = found.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
            out += [data[a:b] for a, b in zip(cuts, cuts[1:])]
        return pd.Series(out, dtype=object)

    made = docs.withColumn("__ids", ids(F.col(text).cast("string")))
    return made.select(*(made[c] for c in docs.columns if c != "ids"), made["__ids"].alias("ids"))


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``coded`` with decoded string."""

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        model = pieces(path)
        return pd.Series([None if x is None else model.decode_all(x) for x in column], dtype=object)

    made = coded.withColumn("__decoded", text(F.col(ids)))
    return made.select(*(made[c] for c in coded.columns if c != "decoded"), made["__decoded"].alias("decoded"))


def checked(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ids binary, as :func:`encode` gives them, and decoded_ok boolean (whether decoding gives the text back,
    U+2581 taken as a blank), in one pass: a task needs one worker with the model, not one to encode and one to decode."""
    common.bounded_batches(docs.sparkSession)

    @F.pandas_udf("ids binary, decoded_ok boolean")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        for texts in batches:
            out = []
            for values, found, counts in _coded(texts, path):
                data, cuts = found.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
                for v, a, b in zip(values, cuts, cuts[1:], strict=False):
                    own = data[a:b]
                    out.append((own, model.decode_all(own) == v.replace(BLANK, " ")))
            yield pd.DataFrame(out, columns=["ids", "decoded_ok"]).astype({"ids": object, "decoded_ok": "bool"})
        _held.pop(path, None)  # what a later stage's task in this worker doesn't need
        del model
        common.released()

    made = docs.withColumn("__coded", coded(F.col(text).cast("string")))
    return made.select(*(made[c] for c in docs.columns if c not in ("ids", "decoded_ok")), "__coded.ids", "__coded.decoded_ok")


def report(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: its other columns, n_pieces long, ids_crc32 long (of the ids' bytes), decoded_ok
    boolean (whether decoding gives the text back, U+2581 taken as a blank)."""
    plain = docs.withColumn("text", F.col("text").cast("string"))

    @F.pandas_udf("n_pieces long, ids_crc32 long, decoded_ok boolean")
    def coded(texts: pd.Series) -> pd.DataFrame:
        model, out = pieces(path), []
        for values, found, counts in _coded(texts, path):
            data, cuts = found.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
            for v, a, b in zip(values, cuts, cuts[1:], strict=False):
                out.append(((b - a) // 4, crc32(data[a:b]), model.decode_all(data[a:b]) == v.replace(BLANK, " ")))
        return pd.DataFrame(out, columns=["n_pieces", "ids_crc32", "decoded_ok"]).astype({"n_pieces": "int64", "ids_crc32": "int64", "decoded_ok": "bool"})

    made = plain.withColumn("__coded", coded("text"))
    return made.select(*(made[c] for c in docs.columns if c not in ("text", "n_pieces", "ids_crc32", "decoded_ok")), "__coded.n_pieces", "__coded.ids_crc32", "__coded.decoded_ok")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text")
    return report(docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")), model_path())
