"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q that no neighbouring word extends. The words of a text are read in
order. The suffix links of their automaton form a tree whose path from a prefix to the root holds all its suffixes; each
node knows where its strings ended last. *Access* of a link-cut tree makes the path of the newest prefix one preferred
path and colours it with the newest end; on the way it meets the old preferred paths, each of one colour, so no more than
logarithmically many a word. A segment with old end j and strings of (top, L] words says that the last L words before the
new end i also end at j: if the distance ``i - j`` is over ``top`` and at most L, two equal stretches of that length
stand side by side, a square that is no power itself, and L says how far to the left its period goes. Squares of one
period with the same left end are one run, which goes to the last of their ends.

A run of at least LEAST words and POWER periods is covered by stretches of ``GRAM`` words that occur again in the text, so
only stretches of such words (told by rolling hashes; more than needed never hurts) go through the automaton: exact,
and most words of prose never get there. Memory of a task: the text, and some 600 bytes for each word of the longest
stretch of repeats.

Defined results
    * null text counts as empty; a text without words has no runs, and its kept words are the empty text;
    * a null id counts as the empty text in the hash that plants repeats;
    * texts and stretches of any length are read whole; words are compared as they are, bytes without the six white spaces;
    * of the runs of greatest length by period, the smallest start counts, then the smallest period; no run: nulls;
    * repeated rows give repeated results; an empty table no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common

LEAST, POWER = 24, 3
#: A run of at least 24 words and 3 periods holds only GRAM-word stretches that occur again.
GRAM = 8
#: Bytes of text that are read at once.
RUN = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton: of each state the length of its longest string and its suffix link (the root is state 1 and links
    to 0, which is none), and the states of all prefixes."""
    length, link, step = [0, 0], [0, 0], [{}, {}]
    prefixes, last = [], 1
    for w in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(1)
        step.append({})
        p = last
        while p and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p:
            q = step[p][w]
            if length[q] != length[p] + 1:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                while p and step[p].get(w) == q:
                    step[p][w] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[new] = q
        prefixes.append(new)
        last = new
    return length, link, prefixes


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """Last end (the number of words up to there) of each run with two periods or more, by (period, first word)."""
    length, up, prefixes = automaton(words)
    left, right, colour = [0] * len(up), [0] * len(up), [0] * len(up)
    # ``up`` becomes the splay trees' parent; a root's parent is the node that its path hangs on, which has it as no child
    found: dict[tuple[int, int], int] = {}
    for end, state in enumerate(prefixes, 1):
        below, x = 0, state
        while x:
            c = colour[x]
            y = up[x]
            if left[y] == x or right[y] == x:  # x is no root of its splay tree: turn it up
                while True:
                    y = up[x]
                    on_left = left[y] == x
                    if not on_left and right[y] != x:
                        break
                    z = up[y]
                    z_left = left[z] == y
                    if z_left or right[z] == y:
                        if z_left == on_left:  # zig-zig: the parent first
                            _turn(y, z, z_left, up, left, right)
                        else:
                            _turn(x, y, on_left, up, left, right)
                        y = up[x]
                        _turn(x, y, left[y] == x, up, left, right)
                        c = colour[z]
                    else:
                        _turn(x, y, on_left, up, left, right)
                        c = colour[y]
            if right[x]:
                colour[right[x]] = c  # what hangs deeper stays with its colour
            top = up[x]
            if c:
                away = end - c
                if length[top] < away <= length[x]:
                    found[away, end - away - length[x]] = end
            right[x] = below
            below, x = x, top
        colour[below] = end
    return found


def _turn(x: int, y: int, on_left: bool, up: list[int], left: list[int], right: list[int]) -> None:
    """``x``, a child of ``y``, takes its place."""
    z = up[y]
    if on_left:
        moved = left[y] = right[x]
        right[x] = y
    else:
        moved = right[y] = left[x]
        left[x] = y
    if moved:
        up[moved] = y
    up[y], up[x] = x, z
    if left[z] == y:
        left[z] = x
    elif right[z] == y:
        right[z] = x


def repeated(codes: np.ndarray, sizes: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last) of the longest stretches of words in texts one after the other (``sizes`` words each) that
    are covered by ``gram``-word stretches of which the same text has another one; places count within all ``codes``."""
    n = len(codes) - gram + 1
    if n <= 0:
        return (np.empty(0, dtype=np.int64),) * 3
    h = np.zeros(n, dtype=np.uint64)
    for i in range(gram):
        h = h * np.uint64(_BASE) + codes[i : i + n].astype(np.uint64) + np.uint64(1)
    text = np.repeat(np.arange(len(sizes)), sizes)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + text[:n].astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_BASE)
    at = np.flatnonzero(text[:n] == text[gram - 1 :])
    order = at[np.argsort(h[at])]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n + 2, dtype=np.int8)
    twice[order[1:][same] + 1] = 1
    twice[order[:-1][same] + 1] = 1
    edge = np.diff(twice)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return text[first], first, last + gram - 1


def runs_of(words: np.ndarray, stretches: list[tuple[int, int]], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and ``power`` periods, by start, then period. Only
    ``stretches`` (first, last) of the text are searched."""
    out = []
    for first, last in stretches:
        if last - first < least:
            continue
        for (period, start), end in squares(words[first:last].tolist()).items():
            if end - start >= max(least, power * period):
                out.append((first + start, end - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(n: int, h: int) -> np.ndarray:
    """Places of the original words that a text of ``n`` words holds when the rule of hash ``h`` repeats a part of it."""
    at = np.arange(n)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string, runs array<struct<start:long,length:long,period:long>>"


def periodic(docs: DataFrame, plant: bool = False, texts: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` to the columns of ``SCHEMA``: each document's runs, the one of greatest length by period, and
    the text in which each run keeps its first period only (words joined by one blank; null without ``texts``).
    ``plant`` repeats a part of one text in ten first, by a hash of the id."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))).alias("h"))
    names = [c.split(" ")[0] for c in SCHEMA.replace("struct<start:long,length:long,period:long>", "s").split(", ")]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = [pa.int64()] * 7 + [pa.string()] * 3 + [pa.list_(run)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.texts_of_size(batches, RUN):
            rows = []
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
            codes, sizes, words = common.coded_words(batch.column("text"), lower=False)
            ends = np.cumsum(sizes)
            if plant and len(codes):
                codes = codes[np.concatenate([e - n + planted(n, h) for e, n, h in zip(ends.tolist(), sizes.tolist(), hashes, strict=True)])]
            words = words.to_pylist()
            stretches: dict[int, list[tuple[int, int]]] = {}
            for text, first, last in zip(*(x.tolist() for x in repeated(codes, sizes)), strict=True):
                stretches.setdefault(text, []).append((first, last))
            for i, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
                own, before = codes[end - n : end], end - n
                runs = runs_of(own, [(a - before, b - before) for a, b in stretches.get(i, [])])
                kept = np.ones(n, dtype=bool)
                for start, length, period in runs:
                    kept[start + period : start + length] = False
                text = " ".join(map(words.__getitem__, own[kept].tolist()))
                listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
                best = None
                for r in runs:
                    if best is None or r[1] * best[2] > best[1] * r[2]:
                        best = r
                most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                rows.append((ids[i], n, len(runs), *most, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), text if texts else None, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return plain.mapInArrow(scan, SCHEMA)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic(common.read_table(spark, sf_dir, "documents", "doc_id", "text"), plant=True, texts=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
