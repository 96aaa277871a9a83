"""Token ids in a fixed-width binary format.

Every id takes the fewest bits that the vocabulary needs. A shard file holds, little-endian:

    8 bytes   magic ``PLPACK1\\0``
    u32 u32   bits per id, ids per block
    u64 u64   documents, ids
    u64       place of the indexes
    blocks    ids packed lowest bit first; each block starts on a byte
    u64[]     byte offset of each block, and of the end of the last one
    u8[]      1 where a document's id is null
    i64[]     document ids
    i64[]     ids of each document

Blocks are read and unpacked on their own (numpy, no loop over ids), so any range of ids costs only
the blocks that it touches.

Defined results
    * null text counts as empty; each document has at least its end id;
    * documents are in ascending doc_id order over all shards, null ids first; rows with one doc_id
      follow by their ids' bytes; an empty table makes no shard and no rows;
    * texts of any length are encoded whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common

MAGIC = b"PLPACK1\0"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK = 4096
#: Runs that a worker keeps with their ids; when full it starts anew. Bytes of text that it encodes at once.
CACHE, WALK_BYTES = 600_000, 12_000_000
#: Ids in a file.
SHARD_IDS = 1 << 25
END = 1


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids, lowest bit first, in ceil(n * bits / 8) bytes."""
    parts = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:  # whole bytes
        return parts[:, : bits // 8].tobytes()
    wide = np.unpackbits(parts, axis=1, bitorder="little")
    return np.packbits(wide[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of a packed block."""
    if bits % 8 == 0:
        parts = np.zeros((count, 4), dtype=np.uint8)
        parts[:, : bits // 8] = np.frombuffer(data, dtype=np.uint8, count=count * bits // 8).reshape(count, bits // 8)
        return parts.reshape(-1).view("<u4")
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little")
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, :bits] = flat.reshape(count, bits)
    return np.packbits(wide.reshape(-1), bitorder="little").view("<u4")


def shard_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """A whole shard file."""
    blocks = [pack_bits(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)]).astype("<u8") + HEAD.size
    place = int(offsets[-1])
    absent = np.array([d is None for d in doc_ids], dtype=np.uint8)
    named = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = HEAD.pack(MAGIC, bits, block, len(doc_ids), len(ids), place)
    return b"".join([head, *blocks, offsets.tobytes(), absent.tobytes(), named.tobytes(), np.asarray(counts, dtype="<i8").tobytes()])


class Shard:
    """A shard file held as bytes (or a memory map): indexes at once, ids on demand."""

    def __init__(self, data):
        self.data = data
        magic, self.bits, self.block, self.docs, self.ids, place = HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        blocks = -(-self.ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, place)
        place += 8 * (blocks + 1)
        self.absent = np.frombuffer(data, np.uint8, self.docs, place)
        self.doc_ids = np.frombuffer(data, "<i8", self.docs, place + self.docs)
        self.counts = np.frombuffer(data, "<i8", self.docs, place + 9 * self.docs)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (not included) of the shard, whichever blocks hold them."""
        if last <= first:
            return np.empty(0, dtype="<u4")
        low, high = first // self.block, (last - 1) // self.block
        parts = [
            unpack_bits(self.data[int(self.offsets[b]) : int(self.offsets[b + 1])], min(self.block, self.ids - b * self.block), self.bits)
            for b in range(low, high + 1)
        ]
        return np.concatenate(parts)[first - low * self.block : last - low * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))


# Kinds of bytes. Runs without white space ("pieces") of bytes that are all plain are cut here as the tokenizer's own
# pattern cuts them: letters, single digits, other signs. Letters are ASCII's and those of Latin-1 in two bytes.
# A piece with any other byte (the apostrophe too, for endings such as 's) goes to the library as it is.
_BLANK, _LETTER, _DIGIT, _SIGN, _OTHER = 0, 1, 2, 3, 4
_kind = np.full(256, _OTHER, dtype=np.uint8)
_kind[33:127] = _SIGN
_kind[39] = _OTHER
_kind[48:58] = _DIGIT
_kind[65:91] = _kind[97:123] = _LETTER
_kind[[9, 10, 11, 12, 13, 32]] = _BLANK
_lead = 0xC3  # of U+00C0 to U+00FF; U+00D7 and U+00F7 are no letters


def runs_of(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of texts that stand one after the other in ``data``, text i from ``cuts[i]`` to ``cuts[i + 1]``: the bytes
    of all runs (plain ones in lower case), where each starts there, whether it goes to the library as it is, and the
    number of runs before each text and in all."""
    kind = _kind[data]
    low = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    pairs = np.flatnonzero(data[:-1] == _lead)
    if len(pairs):
        second = data[pairs + 1]
        letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        kind[pairs[letter]] = kind[pairs[letter] + 1] = _LETTER
        capital = pairs[letter & (second < 0x9F)] + 1
        low[capital] += 32
    kind[np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))] = _OTHER  # the start of a special token's name
    solid = kind != _BLANK
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    inner = cuts[:-1][cuts[:-1] < len(data)]
    opens[inner] = solid[inner]  # a text never goes on in the next
    first = solid & ((kind == _DIGIT) | opens)
    first[1:] |= solid[1:] & (kind[1:] != kind[:-1])
    other = np.flatnonzero(kind == _OTHER)
    raw = np.zeros(0, dtype=np.int64)
    if len(other):  # whole pieces, as they are
        starts = np.flatnonzero(opens)
        own = np.unique(np.searchsorted(starts, other, side="right") - 1)
        piece = np.zeros(len(starts), dtype=bool)
        piece[own] = True
        inside = np.repeat(piece, np.diff(np.append(starts, len(data)))) if len(starts) else piece
        at = starts[0] + np.flatnonzero(inside)
        first[at] = opens[at]
        low[at] = data[at]
        raw = starts[own]
    at = np.flatnonzero(first)
    whole = np.zeros(len(at), dtype=bool)
    whole[np.searchsorted(at, raw)] = True
    return low[solid], np.flatnonzero(first[solid]), whole, np.searchsorted(at, cuts)


class WordEncoder:
    """Encodes with the tokenizers library, each distinct run once.

    White space parts pieces for the tokenizer's pattern, so ids of a text are those of its pieces one after the other,
    and ids of a plain piece are those of its runs. Runs of a whole batch are told apart in Arrow; only those that the
    worker has not met yet go to the library, many in a call, and are told apart again by the ids that end a word.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model without the steps that a plain run in lower case has behind it
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.table = common.IdTable(self.kind, CACHE)

    def _learn_whole(self, texts: list[str]) -> None:
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self.table.learn(part, np.array([x for ids in found for x in ids], dtype=self.kind), np.array([len(x) for x in found]))

    def _learn_plain(self, runs: list[str], line: int = 128) -> None:
        for i in range(0, len(runs), 64 * line):
            lines = [runs[j : j + line] for j in range(i, min(i + 64 * line, len(runs)), line)]
            for words, e in zip(lines, self.plain.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype=self.kind)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(words) and cuts[-1] == len(ids):
                    self.table.learn(words, ids, np.diff(cuts, prepend=0))
                else:
                    self._learn_whole(words)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; each text's end id stands after its own."""
        data, starts, raw, before = runs_of(*common.text_bytes(texts))
        sizes = np.diff(before)
        coded = common.strings(data, starts, pa.string()).dictionary_encode()
        codes, runs = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        whole = np.zeros(len(runs), dtype=bool)
        whole[codes[raw]] = True
        fresh = self.table.fresh(runs)
        self._learn_whole([runs[i] for i in fresh if whole[i]])
        self._learn_plain([runs[i] for i in fresh if not whole[i]])
        ids, counts = self.table.gathered(codes, runs, sizes)
        if end_id is not None:
            ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
        return ids, counts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _put(uri: str, name: str, data: bytes) -> None:
    """Writes under a name of its own, then renames: a lost or repeated attempt leaves no half file."""
    import pyarrow.fs as pafs

    store, path = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    store.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, f"{path}/{name}")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END, block: int = BLOCK, most: int = SHARD_IDS) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` and writes shards ``shard-N-M.plpack`` to ``folder``: file M of range N.

    Texts are encoded where they are read; only ids are shuffled, in the narrowest dtype, to their range of doc_id. A
    file is closed after ``most`` ids, so a task holds no more than that and one document, however large its range.
    Returns (and has written) one row for each file: shard long, part long, n_docs long, n_ids long.
    """
    parts = common.partitions_of(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    bounds = common.range_bounds(keyed.select("doc_id"), "doc_id", 3 * parts)
    cuts = np.array(bounds or [0], dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in common.texts_of_size(batches, WALK_BYTES):
            ids = batch.column("doc_id")
            at = np.maximum(np.searchsorted(cuts, pc.fill_null(ids, -(1 << 63)).to_numpy(zero_copy_only=False), side="right") - 1, 0)
            flat, counts = enc.encode(batch.column("text"), end_id)
            data = common.strings(flat.view(np.uint8), (np.cumsum(counts) - counts) * enc.kind.itemsize, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), ids, data], names=["shard", "doc_id", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        bits, held, size, at, number = bits_for(enc.size), [], 0, None, 0

        def close() -> pa.RecordBatch:
            doc_ids = [d for part, _ in held for d in part.to_pylist()]
            data = [common.text_bytes(part) for _, part in held]
            counts = np.concatenate([np.diff(c) for _, c in data]) // enc.kind.itemsize
            ids = np.concatenate([d for d, _ in data]).view(enc.kind)
            _put(folder, f"shard-{at:08d}-{number:06d}.plpack", shard_bytes(doc_ids, counts, ids, bits, block))
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (at, number, len(doc_ids), len(ids))], names=["shard", "part", "n_docs", "n_ids"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            lengths = pc.binary_length(batch.column("ids")).to_numpy() // enc.kind.itemsize
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for first, last in zip(edges, edges[1:]):
                for a, b in common.slices(lengths[first:last], most):
                    own = int(lengths[first + a : first + b].sum())
                    fresh = at is not None and shards[first] != at
                    if held and (fresh or size + own > most):
                        yield close()
                        held, size, number = [], 0, number + 1
                    if fresh or at is None:
                        at, number = int(shards[first]), 0
                    part = batch.slice(first + a, b - a)
                    held.append((part.column("doc_id"), part.column("ids")))
                    size += own
        if held:
            yield close()

    dealt = keyed.mapInArrow(encode, "shard long, doc_id long, ids binary").repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    return common.written(dealt.mapInArrow(store, "shard long, part long, n_docs long, n_ids long"), "packed-manifest")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids binary (unsigned 32-bit, little-endian).

    The manifest (four numbers a file) gives each file its first id's place in the whole.
    """
    sizes = sorted((r["shard"], r["part"], r["n_ids"]) for r in manifest.select("shard", "part", "n_ids").collect())
    before, total = {}, 0
    for shard, part, n in sizes:
        before[shard, part], total = total, total + n
    if not sizes:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(content.as_buffer().to_pybytes())
                base = before[tuple(map(int, re.search(r"shard-(\d+)-(\d+)\.plpack", path).groups()))]
                for first, last in common.slices(shard.counts, 2_000_000):
                    at = int(shard.starts[first])
                    data = shard.read(at, int(shard.starts[last])).tobytes()
                    cuts = ((shard.starts[first : last + 1] - at) * 4).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids[first:last], pa.int64(), mask=shard.absent[first:last].astype(bool)),
                            pa.array(shard.starts[first:last] + base, pa.int64()),
                            pa.array(shard.counts[first:last], pa.int64()),
                            pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.plpack").load(folder)
    return files.select("path", "content").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def op4_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.new_path(spark, "packed")
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text")
    manifest = write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    back = read_shards(spark, folder, manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
