"""Language-model scoring by a hidden Markov model.

Tokens are words and one end a text. The model has ``STATES`` latent states; a state emits a symbol,
and the symbol's words share its probability:

    * each of the ``FREQUENT`` most frequent training words, and the end, is a symbol of its own;
    * the other words fall into ``CLASSES`` symbols by a hash of their last letters; inside a class o a
      word seen c times has (c + 1) / (N_o + V_o + U_o): N_o tokens, V_o words, U_o words seen once;
    * all words that training never saw are one more outcome, which takes U_o of each class.

So a state's outcomes sum to 1 over training words, the unknown word and the end, and the score is the
exact log10 likelihood of the token sequence by the scaled forward recursion.

Learning is Baum-Welch by shares (incremental expectation maximisation): a hash deals the training
documents to ``SHARES`` parts of growing size; each of the first rounds goes over one part with the
model that the parts before it gave; ``ROUNDS`` more go over all training documents. Documents count whole. Tasks emit expected counts as fixed-point numbers (sums are exact in any order), which are added
up by state and symbol; only tables of that fixed size (states times symbols) reach the driver.

What grows with the corpus stays distributed. Documents become blocks of a bounded number of bytes; a
block holds its distinct words once, so counting shuffles a word once a block (not once an occurrence).
Counts come back to their block as numbers; only words that may be frequent come with their letters.

Documents are never cut. One longer than ``PIECE`` tokens is walked in pieces that are all lanes of one
numpy step: each piece first gives its transfer matrix (what any state before it leads to), the chain of
these gives the exact chances at every piece's edges, and no count or likelihood is lost between pieces.

Defined results
    * null text counts as empty: its one token is the end;
    * no training documents: base scores are 0 and the model falls back on its flat prior;
    * repeated rows give repeated results; extra columns are ignored; null ids stay null and count as
      the empty id for the training split; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm import common

STATES, FREQUENT, CLASSES = 8, 4_096, 2_048
#: Bytes of text in a block, tokens in a piece (a lane), and tokens that a worker walks at once.
BLOCK_BYTES, PIECE, WALK = 6_000_000, 2_048, 600_000
#: Sixteenths of the training documents that the rounds by shares take, and the weight of each round's counts.
SHARES, WEIGHTS = (1, 1, 1, 1, 2, 2, 4, 4), (1.0, 0.8, 0.8, 0.8, 0.7, 0.7, 0.7, 0.7)
#: Rounds over all training documents after those.
ROUNDS = 2
PRIOR, FIXED = 200.0, float(1 << 20)
END, UNKNOWN = FREQUENT + CLASSES, FREQUENT + CLASSES + 1
SYMBOLS = FREQUENT + CLASSES + 2
SUFFIX = 3


# -- documents to blocks

BLOCK_SCHEMA = "block long, words array<string>, n_train array<int>, doc_ids array<long>, held array<boolean>, shares array<int>, sizes array<int>, tokens binary"
_SHARE_OF = np.repeat(np.arange(len(SHARES)), SHARES)


def blocks(docs: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """``docs(doc_id, text, held)`` to blocks. Tokens are numbers of the block's own words, frequent ones first."""
    names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()  # the table is written once, so a block keeps its number
        for number, batch in enumerate(common.texts_of_size(batches, most)):
            codes, sizes, words = common.coded_words(batch.column("text"))
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            shares = _SHARE_OF[batch.column("dealt").to_numpy(zero_copy_only=False)]
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            place = np.empty(len(words), dtype=np.int32)
            place[order] = np.arange(len(words))
            codes = place[codes]
            train = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(words)).astype(np.int32)
            row = [part << 32 | number, words.take(pa.array(order)), train, batch.column("doc_id"), held, shares, sizes.astype(np.int32), squeezed(codes.astype("<i4"))]
            yield pa.RecordBatch.from_arrays([_lone(x, k) for x, k in zip(row, kinds, strict=True)], names=names)

    dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(sum(SHARES))).cast("int").alias("dealt")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held")
    return plain.select("*", dealt).mapInArrow(scan, BLOCK_SCHEMA)


def _lone(value, kind: pa.DataType) -> pa.Array:
    """A column of one row; a list is given as an array."""
    if not pa.types.is_list(kind):
        return pa.array([value], kind)
    flat = value if isinstance(value, pa.Array) else pa.array(value, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(kind.value_type))


# -- counts over all blocks

@dataclass
class Vocabulary:
    """What has a fixed size of the training counts."""

    tokens: int  # N
    kinds: int  # V
    ends: int
    frequent: dict[str, int]  # word -> symbol
    counts: np.ndarray  # of the frequent words
    sums: np.ndarray  # N_o, V_o, U_o by class


def counted(held: DataFrame) -> DataFrame:
    """(block, idx, c long, o short, word, first boolean): training count of each block's words over all blocks, and their
    classes; ``first`` on one row of each word. One shuffle, by word: a word has a row a block at most, which is less than
    a block has words, so no word weighs more than a task's share of them."""
    each = held.select("block", F.posexplode(F.arrays_zip("words", "n_train")).alias("idx", "x")).select("block", "idx", F.col("x.words").alias("word"), "x.n_train")
    own = Window.partitionBy("word")
    first = F.row_number().over(own.orderBy("word")) == 1  # any one of them; the table is written once
    group = F.pmod(F.xxhash64(F.substring("word", -SUFFIX, SUFFIX)), F.lit(CLASSES)).cast("short")
    return each.select("block", "idx", F.sum(F.col("n_train").cast("long")).over(own).alias("c"), group.alias("o"), "word", first.alias("first"))


def vocabulary(held: DataFrame, counts: DataFrame) -> Vocabulary:
    seen = counts.where("first AND c > 0")
    sums = np.zeros((3, CLASSES))
    for r in seen.groupBy("o").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("u")).collect():
        sums[:, r["o"]] = r["n"], r["v"], r["u"]
    ends = held.select(F.sum(F.size(F.filter("held", lambda x: ~x))).alias("n")).first()["n"] or 0
    total, kinds = int(sums[0].sum()) + ends, int(sums[1].sum()) + (ends > 0)
    # how often a frequent word stands at least, to a power of 2: few others are sorted with them, whatever the number of tasks
    power, least, above = F.floor(F.log2("c")), 0, 0
    for r in sorted(seen.groupBy(power.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["k"]):
        least, above = r["k"], above + r["n"]
        if above >= FREQUENT:
            break
    top = seen.where(power >= least).orderBy(F.desc("c"), "word").limit(FREQUENT).select("word", "c", "o").collect()
    for r in top:
        sums[:, r["o"]] -= r["c"], 1, r["c"] == 1
    return Vocabulary(total, kinds, ends, {r["word"]: i for i, r in enumerate(top)}, np.array([r["c"] for r in top] + [0] * (FREQUENT - len(top)), dtype=float), sums)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers compressed byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def spread(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


CODED_SCHEMA = "doc_ids array<long>, held array<boolean>, sizes array<int>, known array<int>, base array<double>, inner array<double>, symbols binary, share int"


def coded(held: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Documents as symbols, a row for each block and share. By document: words (without the end), known tokens, base
    score, and the log10 of what its words have inside their symbols."""
    shipped = held.sparkSession.sparkContext.broadcast(vocab)
    names = [x.split()[0] for x in CODED_SCHEMA.split(", ")]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.int32()]

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        v, rows = shipped.value, []
        if left.num_rows:
            place, n = right.column("idx").to_numpy(), right.num_rows  # a row for each word of the block
            c, group = np.empty(n), np.empty(n, dtype=np.int64)
            c[place], group[place] = right.column("c").to_numpy(), right.column("o").to_numpy()
            base_word = np.log10((c + 1) / (v.tokens + v.kinds + 1))
            base_end = np.log10((v.ends + 1) / (v.tokens + v.kinds + 1))
            symbol = np.full(n, -1, dtype=np.int64)
            symbol[place] = pc.fill_null(pc.index_in(right.column("word"), pa.array(list(v.frequent), pa.string())), -1).to_numpy()
            rare = np.flatnonzero((symbol < 0) & (c > 0))
            group = group[rare]
            symbol[rare] = FREQUENT + group
            symbol[c == 0] = UNKNOWN
            inner = np.zeros(n)
            inner[rare] = np.log10((c[rare] + 1) / class_mass(v)[group])
            for i in range(left.num_rows):
                sizes, shares = (left.column(n)[i].values.to_numpy() for n in ("sizes", "shares"))
                tokens = spread(left.column("tokens")[i].as_py(), "<i4")
                owner = np.repeat(np.arange(len(sizes)), sizes)
                total = lambda x: np.bincount(owner, x[tokens], minlength=len(sizes)) if len(tokens) else np.zeros(len(sizes))
                flat = np.full(len(tokens) + len(sizes), END, dtype="<u2")
                flat[np.arange(len(tokens)) + owner] = symbol[tokens]
                home = np.repeat(shares, sizes + 1)
                by_document = [left.column("doc_ids")[i].values, left.column("held")[i].values, *(pa.array(x) for x in (sizes, (total((c > 0).astype(float)) + (v.ends > 0)).astype(np.int32), total(base_word) + base_end, total(inner)))]
                for share in np.unique(shares).tolist():
                    own = pa.array(np.flatnonzero(shares == share))
                    rows.append([x.take(own) for x in by_document] + [squeezed(flat[home == share]), share])
        made = [pa.RecordBatch.from_arrays([_lone(x, k) for x, k in zip(r, kinds, strict=True)], names=names) for r in rows]
        return pa.Table.from_batches(made, schema=pa.schema(list(zip(names, kinds, strict=True))))

    frequent = F.when(F.col("c") >= float(vocab.counts[vocab.counts > 0].min(initial=np.inf)), F.col("word")).alias("word")  # all that may be
    asked = counts.select("block", "idx", "c", "o", frequent)
    return held.drop("words", "n_train").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(one, CODED_SCHEMA)


# -- the model

def class_mass(v: Vocabulary) -> np.ndarray:
    return v.sums[0] + v.sums[1] + v.sums[2] + 1.0 / CLASSES


@dataclass
class Model:
    start: np.ndarray  # states
    step: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states; the unknown word's row is derived


def prior(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Share of each symbol with no states told apart, and by how much smoothing raises its counts."""
    weight, raised = np.zeros(SYMBOLS), np.ones(SYMBOLS)
    weight[:FREQUENT] = np.where(v.counts > 0, v.counts + 1, 0)
    raised[:FREQUENT] = np.where(v.counts > 0, (v.counts + 1) / np.maximum(v.counts, 1), 1)
    weight[FREQUENT:END] = class_mass(v)
    raised[FREQUENT:END] = class_mass(v) / np.maximum(v.sums[0], 1)
    weight[END] = v.ends + 1
    return weight / weight.sum(), raised


def model_of(start: np.ndarray, step: np.ndarray, emit: np.ndarray, v: Vocabulary) -> Model:
    """A model from expected counts (states; states x states; symbols x states)."""
    share, raised = prior(v)
    e = emit * raised[:, None] + PRIOR * share[:, None]
    e[UNKNOWN] = 0
    e /= e.sum(axis=0, keepdims=True)
    e[UNKNOWN] = (e[FREQUENT:END] * ((v.sums[2] + 1.0 / CLASSES) / class_mass(v))[:, None]).sum(axis=0)

    step = step + 1.0
    return Model((start + 1) / (start + 1).sum(), step / step.sum(axis=1, keepdims=True), e)


def first_model(v: Vocabulary, states: int = STATES, seed: int = 11) -> Model:
    """Emissions near the prior, told apart by chance; states that last."""
    rng = np.random.default_rng(seed)
    share, _ = prior(v)
    emit = share[:, None] * np.exp(0.6 * rng.standard_normal((SYMBOLS, states)))
    size = max(v.tokens, 1) / states
    return model_of(np.ones(states), 50 * (np.full((states, states), 0.05 / states) + 0.95 * np.eye(states)) * 100, emit * size, v)


def lanes(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side: their order by falling length, where each step begins (and the last ends), and the
    places of all tokens step by step, so that a step's tokens are neighbours."""
    order = np.argsort(-sizes, kind="stable")
    alive = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
    cuts = np.concatenate([[0], np.cumsum(alive)])
    step = np.repeat(np.arange(len(alive)), alive)
    return order, cuts, first[order][np.arange(cuts[-1]) - cuts[step]] + step


@dataclass
class Walk:
    """Sequences (sizes of 1 or more) cut into pieces of at most PIECE tokens, with what stands at the edges of pieces."""

    first: np.ndarray  # place of each piece's first token
    sizes: np.ndarray
    owner: np.ndarray  # sequence of each piece
    opens: np.ndarray  # whether the piece opens its sequence
    before: np.ndarray  # state chances at the token before the piece (not used where it opens)
    enter: np.ndarray  # chances of the first token's state, before its symbol
    exit: np.ndarray  # what the rest of the sequence makes of the last token's state, up to a factor
    reach: np.ndarray  # log10 likelihood of what stands before the piece


def walk(symbols: np.ndarray, sizes: np.ndarray, model: Model, piece: int) -> Walk:
    k, counts = len(model.start), -(-sizes // piece)
    lengths = np.full(int(counts.sum()), piece, dtype=np.int64)
    heads = np.cumsum(counts) - counts
    lengths[heads + counts - 1] = sizes - (counts - 1) * piece
    n, opens = len(lengths), np.zeros(len(lengths), dtype=bool)
    opens[heads] = True
    w = Walk(np.cumsum(lengths) - lengths, lengths, np.repeat(np.arange(len(sizes)), counts), opens, np.zeros((n, k)), np.tile(model.start, (n, 1)), np.ones((n, k)), np.zeros(n))
    long = np.flatnonzero(counts > 1)
    if not len(long):
        return w
    mine = np.flatnonzero(counts[w.owner] > 1)
    transfer, weight = np.zeros((n, k, k)), np.zeros(n)
    for a, b in common.slices(lengths[mine] * k, 4 * WALK):
        transfer[mine[a:b]], weight[mine[a:b]] = transfers(symbols, w.first[mine[a:b]], lengths[mine[a:b]], model)
    for j in range(1, int(counts.max())):  # one step for all sequences that have a piece j
        at = heads[long[counts[long] > j]] + j
        ahead = np.einsum("ni,nij->nj", w.enter[at - 1], transfer[at - 1])
        mass = ahead.sum(axis=1)
        w.before[at] = ahead / mass[:, None]
        w.enter[at] = w.before[at] @ model.step
        w.reach[at] = w.reach[at - 1] + weight[at - 1] + np.log10(mass)
    for j in range(int(counts.max()) - 1, 0, -1):
        at = heads[long[counts[long] > j]] + j
        later = np.einsum("nij,nj->ni", transfer[at], w.exit[at]) @ model.step.T
        w.exit[at - 1] = later / later.max(axis=1, keepdims=True)
    return w


def transfers(symbols: np.ndarray, first: np.ndarray, sizes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the matrix (scaled, and its scale's log10) from the chances of its first token's state to what its last has."""
    order, cuts, spots = lanes(first, sizes)
    k, n = len(model.start), len(sizes)
    own, turn = np.take(model.emit.T, symbols[spots], axis=1), model.step.T
    held, weight = np.repeat(np.eye(k)[:, :, None], n, axis=2), np.zeros(n)  # state now, state before, piece
    for t, (low, high) in enumerate(zip(cuts, cuts[1:])):
        m = high - low
        now = held[:, :, :m] if t == 0 else (turn @ held[:, :, :m].reshape(k, k * m)).reshape(k, k, m)
        now = now * own[:, None, low:high]
        if t % 4 == 3:
            c = now.max(axis=(0, 1))
            now /= c
            weight[:m] += np.log10(c)
        held[:, :, :m] = now
    out, logs = np.empty((n, k, k)), np.empty(n)
    out[order], logs[order] = held.transpose(2, 1, 0), weight
    return out, logs


def forward(symbols: np.ndarray, sizes: np.ndarray, model: Model, piece: int = PIECE) -> np.ndarray:
    """log10 likelihood of each sequence (sizes of 1 or more), many at a time, scaled at each token."""
    w = walk(symbols, sizes, model, piece)
    last = np.append(w.opens[1:], True)[: len(w.opens)]  # what stands before a sequence's last piece is known by now
    out = np.empty(len(sizes))
    first, lengths, enter = w.first[last], w.sizes[last], w.enter[last]
    for a, b in common.slices(lengths, WALK):
        order, cuts, spots = lanes(first[a:b], lengths[a:b])
        own, turn = np.take(model.emit.T, symbols[spots], axis=1), np.ascontiguousarray(model.step.T)
        alpha, total, scale = np.ascontiguousarray(enter[a:b][order].T), np.zeros(b - a), np.ones(b - a)
        for t, (low, high) in enumerate(zip(cuts, cuts[1:])):
            m = high - low
            now = alpha[:, :m] if t == 0 else turn @ alpha[:, :m]
            now = now * own[:, low:high]
            c = now.sum(axis=0)
            now /= c
            alpha[:, :m] = now
            scale[:m] *= c
            if t % 16 == 15:  # a product of 16 factors stays far from underflow
                total[:m] += np.log10(scale[:m])
                scale[:m] = 1.0
        out[a:b][order] = total + np.log10(scale)
    return out + w.reach[last]


def expected(symbols: np.ndarray, sizes: np.ndarray, model: Model, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, steps and emissions of sequences (sizes of 1 or more)."""
    whole, k = walk(symbols, sizes, model, piece), len(model.start)
    starts, steps, emits = np.zeros(k), np.zeros((k, k)), np.zeros((SYMBOLS, k))
    for a, b in common.slices(whole.sizes, WALK):
        low, high = int(whole.first[a]), int(whole.first[b - 1] + whole.sizes[b - 1])
        one = Walk(whole.first[a:b] - low, *(getattr(whole, n)[a:b] for n in ("sizes", "owner", "opens", "before", "enter", "exit", "reach")))
        for total, x in zip((starts, steps, emits), _expected(symbols[low:high], one, model), strict=True):
            total += x
    return starts, steps, emits


def _expected(symbols: np.ndarray, w: Walk, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of pieces; in single precision, for they are scaled at each token and only summed here."""
    order, cuts, spots = lanes(w.first, w.sizes)
    k = len(model.start)
    step = model.step.astype(np.float32)
    turn = np.ascontiguousarray(step.T)
    symbols = symbols[spots].astype(np.int64)
    own = np.take(np.ascontiguousarray(model.emit.T, dtype=np.float32), symbols, axis=1)
    alphas = np.empty_like(own)
    alpha, ranges = np.ascontiguousarray(w.enter[order].T, dtype=np.float32), list(zip(cuts.tolist(), cuts[1:].tolist()))
    for t, (low, high) in enumerate(ranges):
        m = high - low
        now = np.multiply(alpha[:, :m] if t == 0 else turn @ alpha[:, :m], own[:, low:high], out=alphas[:, low:high])
        scale = 1 / now.sum(axis=0)
        now *= scale
        own[:, low:high] *= scale  # what the way back needs of a token: its symbol's chances over its scale
        alpha = now
    ends = np.empty((k, len(order)), dtype=np.float32)
    for (low, high), rest in zip(ranges, [*(b - a for a, b in ranges[1:]), 0]):
        ends[:, rest : high - low] = alphas[:, low + rest : high]
    steps = np.zeros((k, k))
    beta = w.exit[order].T
    beta = (beta / (ends * beta).sum(axis=0)).astype(np.float32)
    for t in range(len(ranges) - 1, -1, -1):
        low, high = ranges[t]
        if t + 1 < len(ranges):
            a, b = ranges[t + 1]
            ahead = beta[:, : b - a] * own[:, a:b]
            steps += alphas[:, low : low + b - a] @ ahead.T
            np.matmul(step, ahead, out=beta[:, : b - a])
        alphas[:, low:high] *= beta[:, : high - low]
    opens = w.opens[order]
    over = ~opens
    if over.any():  # from the last token of the piece before
        steps += w.before[order][over].T @ (beta * own[:, : len(order)])[:, over].T
    starts = alphas[:, : len(order)][:, opens].sum(axis=1, dtype=np.float64)
    emits = np.stack([np.bincount(symbols, a, minlength=SYMBOLS) for a in alphas], axis=1)
    return starts, steps * model.step, emits


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def gathered(data: DataFrame, model: Model) -> Counts | None:
    """Expected counts over the training documents of coded rows ``data(held, sizes, symbols)``; None where there are none."""
    shipped = data.sparkSession.sparkContext.broadcast(model)
    k = len(model.start)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        sums = [np.zeros(k, dtype=np.int64), np.zeros((k, k), dtype=np.int64), np.zeros((SYMBOLS, k), dtype=np.int64)]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            for s, x in zip(sums, expected(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), m), strict=True):
                s += np.round(x * FIXED).astype(np.int64)
            held.clear()

        for batch in batches:
            for flags, sizes, row in zip(batch.column("held"), batch.column("sizes"), batch.column("symbols"), strict=True):
                sizes = sizes.values.to_numpy().astype(np.int64) + 1
                keep = ~flags.values.to_numpy(zero_copy_only=False).astype(bool)
                if keep.any():
                    held.append((spread(row.as_py(), "<u2")[np.repeat(keep, sizes)], sizes[keep]))
                if sum(len(h[0]) for h in held) >= WALK:
                    add()
        if held:
            add()
        keys = np.concatenate([np.arange(k), k + np.arange(k * k), k + k * k + np.arange(SYMBOLS * k)])
        values = np.concatenate([s.reshape(-1) for s in sums])
        some = values != 0
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(values[some])], names=["key", "value"])

    summed = data.select("held", "sizes", "symbols").mapInArrow(scan, "key long, value long").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
    if not summed.num_rows:
        return None
    flat = np.zeros(k + k * k + SYMBOLS * k)
    flat[summed.column("key").to_numpy()] = summed.column("value").to_numpy() / FIXED
    return flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(SYMBOLS, k)


def train(data: DataFrame, v: Vocabulary) -> Model:
    """Rounds by shares, then over all. A round that gathers nothing leaves the model as it is: a model of no
    counts would have equal states for good."""
    model, sums = first_model(v), None
    if not v.tokens:
        return model
    for share, (part, weight) in enumerate(zip(SHARES, WEIGHTS, strict=True)):
        found = gathered(data.where(F.col("share") == share), model)
        if found is not None:
            scaled = [x * (sum(SHARES) / part) for x in found]
            sums = scaled if sums is None else [(1 - weight) * s + weight * x for s, x in zip(sums, scaled, strict=True)]
            model = model_of(*sums, v)
    for _ in range(ROUNDS):
        found = gathered(data, model)
        if found is not None:
            model = model_of(*found, v)
    return model


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(data: DataFrame, model: Model) -> DataFrame:
    shipped = data.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = []
        symbols: list[np.ndarray] = []

        def judged() -> pa.RecordBatch:
            doc_ids, flags, sizes, known, base, inner = (pa.concat_arrays(c) for c in zip(*held, strict=True))
            sizes = sizes.to_numpy().astype(np.int64) + 1
            likely = forward(np.concatenate(symbols), sizes, shipped.value) + inner.to_numpy()
            held.clear(), symbols.clear()
            return pa.RecordBatch.from_arrays([doc_ids, flags, pa.array(sizes), known.cast(pa.int64()), base, pa.array(likely)], names=[x.split()[0] for x in SCORE_SCHEMA.split(", ")])

        for batch in batches:
            for row in range(batch.num_rows):
                held.append([batch.column(n)[row].values for n in ("doc_ids", "held", "sizes", "known", "base", "inner")])
                symbols.append(spread(batch.column("symbols")[row].as_py(), "<u2"))
                if sum(map(len, symbols)) >= WALK:
                    yield judged()
        if held:
            yield judged()

    return data.mapInArrow(scan, SCORE_SCHEMA)


def language_model_scores(docs: DataFrame, held: str = "held") -> DataFrame:
    """``docs(doc_id, text, held)``: learns from rows not held, scores all. One row a document:
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    made = common.written(blocks(docs.withColumnRenamed(held, "held")), "lm-blocks")
    counts = common.written(counted(made), "lm-counts")
    v = vocabulary(made, counts)
    path = common.new_path(docs.sparkSession, "lm-coded")
    coded(made, counts, v).write.partitionBy("share").parquet(path)
    data = docs.sparkSession.read.schema(CODED_SCHEMA).parquet(path)
    model = train(data, v)
    return scored(data, model).withColumn("train_tokens", F.lit(v.tokens).cast("long"))


def op3_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held", common.fold(F.col("doc_id"), 7) == 2)
    found = language_model_scores(docs)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
