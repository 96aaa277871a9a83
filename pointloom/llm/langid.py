"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a bounded sample of its labelled text.
A text is parsed against it greedily into longest phrases that occur in the sample; with ``c``
phrases over ``n`` letters and samples of ``N`` letters (the longest one's size, the same for all, so
that a short sample wins nothing by being short) the cross entropy is ``c * log2(N) / n``. The
language that needs the fewest phrases, so normalised, wins.

The automaton of each language is completed to a table over the language's own most frequent letters:
from a state and a letter either the phrase goes on, or (value negative) it ends and the next one starts
with that letter. Letters beyond those (a language of thousands of signs) are looked up in one sorted list
of transitions instead, so no letter of a sample is unknown to its language. All languages and many texts
advance together, one letter a step, in numpy.

What is bounded is the sample that the classifier learns from: ``SAMPLE_CHARS`` letters a language, from windows of
``DOCUMENT_CHARS`` at a place drawn by a hash in texts drawn by a hash; the ``LANGUAGES`` most frequent languages; and
``ALL_CHARS`` over all languages (above 16 languages each has a smaller sample). Predictions parse every whole text.

Defined results
    * text null or without a letter (Unicode's letters): ``und``, score 0;
    * lang, source and doc_id are never read for a prediction;
    * letters that a language's sample never holds form phrases of their own in it;
    * ties go to the language first in order; with one learned language the score is 1; with none
      every text is ``und``; a label whose texts have no letter is not learned;
    * a line met in the samples of two languages tells none of them and is left out, unless little else
      is left of a sample, which then keeps its lines;
    * extra columns are kept by :func:`predict`; its own columns replace those of the same name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common

#: Letters of training text for each language and code points of one document, at most; languages at most; and
#: letters of all languages together.
SAMPLE_CHARS, DOCUMENT_CHARS, LANGUAGES, ALL_CHARS = 24_000, 800, 400, 400_000
#: Letters of a language that have a column of its table.
ALPHABET = 120
_CODE = 21  # bits of a code point
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(p).isalpha() for p in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def letters_of(texts: list[str], symbols: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the texts' letters, one text after the other, and how many each text has.

    Lower case; each run of signs that are no letters counts as one blank. Signs and digits are no
    evidence of a language, and junk made of them would join texts of one kind across languages.
    """
    codes, counts = [np.empty(0, dtype=symbols.dtype)], [np.empty(0, dtype=np.int64)]
    for first, last in common.slices(np.array([len(t) for t in texts], dtype=np.int64), 1_000_000):
        lowered = [t.lower() for t in texts[first:last]]
        sizes = np.array([len(t) for t in lowered], dtype=np.int64)
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        own = symbols[points]
        gap = own == blank
        kept = ~gap
        kept[1:] |= ~gap[:-1]  # the first blank of a run
        some = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[some]
        kept[starts] = ~gap[starts]  # none before a text's first letter, and none carried over from the text before
        count = np.zeros(len(sizes), dtype=np.int64)
        if len(starts):
            count[some] = np.add.reduceat(kept, starts, dtype=np.int64)
        codes.append(own[kept])
        counts.append(count)
    return np.concatenate(codes), np.concatenate(counts)


@dataclass
class Model:
    """Completed automata of all languages in one table."""

    languages: list[str]
    symbols: np.ndarray  # code point -> number of a sign: letters of the samples, then the blank, then unknown letters
    blank: int
    columns: np.ndarray  # sign x language -> column of the language's table; below 0: looked up in ``rare``
    table: np.ndarray  # place of a state + column -> next state's place, or its complement if a phrase ended
    roots: np.ndarray
    lost: np.ndarray  # the state after a letter that the language's sample doesn't hold
    rare: np.ndarray  # sorted (place of a state << bits of a sign | sign) of transitions by letters without a column
    beyond: np.ndarray  # where they lead
    size: int  # letters of the longest sample


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root."""
    step, link, longest, last = [{}], [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
        last = new
    return step


def sample(docs: DataFrame, chars: int = SAMPLE_CHARS, per_document: int = DOCUMENT_CHARS) -> dict[str, str]:
    """Bounded training text of each language of ``docs(text, lang)``.

    Texts are drawn by a hash, a text once however often it stands there, at a rate that makes the expected amount
    twice ``chars`` for each language. At most LANGUAGES languages are learned, those with most rows first.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("text"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("hash").alias("texts"), F.sum(F.least(F.length("text"), F.lit(per_document))).alias("chars"))
    sizes = sizes.orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return {}
    chars = min(chars, ALL_CHARS // len(sizes))
    rates = {r["lang"]: min(1.0, 2.0 * chars / max(1.0, r["chars"] * min(1.0, r["texts"] / r["rows"]))) for r in sizes}
    rate = F.element_at(F.create_map(*(F.lit(x) for pair in rates.items() for x in pair)), F.col("lang"))
    draw = (F.col("hash").bitwiseAND((1 << 52) - 1) / float(1 << 52)).alias("draw")
    start = 1 + F.pmod(F.xxhash64("hash"), F.greatest(F.length("text") - per_document, F.lit(0)) + 1)
    window = F.substr(F.col("text"), start.cast("int"), F.lit(per_document)).alias("text")
    drawn = known.select("lang", window, draw, rate.alias("rate")).where("draw < rate").select("lang", "draw", "text").distinct()
    found: dict[str, list[tuple]] = {}
    for r in drawn.collect():
        found.setdefault(r["lang"], []).append((r["draw"], r["text"]))
    lines: dict[str, list[str]] = {}
    for lang, rows in found.items():
        texts = dict.fromkeys(t for _, t in sorted(rows))  # in order of the draw
        lines[lang] = list(dict.fromkeys(line.strip() for t in texts for line in t.lower().splitlines()))
    homes = Counter(line for own in lines.values() for line in own)
    out = {}
    for lang, own in lines.items():
        # a line met in two languages (notices, boilerplate) tells none of them
        alone, whole = ("\n".join(x)[:chars] for x in ([x for x in own if homes[x] == 1], own))
        out[lang] = alone if 2 * len(alone) >= len(whole) else whole
    return out


def train(texts: dict[str, str], alphabet: int = ALPHABET) -> Model:
    """Automata of each language's sample; a sample without a letter gives none."""
    texts = {k: t for k, t in texts.items() if any(c.isalpha() for c in t)}
    languages = sorted(texts)
    points = np.unique(np.frombuffer("".join(texts.values()).lower().encode("utf-32-le", "surrogatepass"), np.uint32))
    points = points[letters()[points]]
    blank, unknown = len(points), len(points) + 1
    symbols = np.full(0x110000, blank, dtype=np.uint8 if unknown < 256 else np.int32)
    symbols[letters()] = unknown
    symbols[points] = np.arange(len(points))
    columns = np.zeros((unknown + 1, len(languages)), dtype=np.int32)
    tables, roots, lost, rare, beyond, size, base = [], [], [], [], [], 2, 0
    for i, lang in enumerate(languages):
        codes, _ = letters_of([texts[lang]], symbols, blank)
        counts = np.bincount(codes, minlength=unknown + 1)
        size = max(size, len(codes))
        seen = np.flatnonzero(counts[:blank])
        own = np.sort(seen[np.argsort(-counts[seen], kind="stable")[:alphabet]])
        width = len(own) + 2  # and the blank, and letters that the sample doesn't hold
        column = columns[:, i]
        column[:] = width - 1
        column[seen] = -1
        column[own] = np.arange(len(own))
        column[blank] = width - 2
        step = suffix_automaton(codes.tolist())
        place = base + width * np.arange(len(step) + 1)  # the last state stands after a letter that the sample doesn't hold
        table = np.full((len(step) + 1, width), place[-1])
        for c, to in step[0].items():
            if column[c] >= 0:
                table[:, column[c]] = place[to]
        table[1:] = ~table[1:]  # the phrase ends; nothing is open at the root
        for s, row in enumerate(step):
            for c, to in row.items():
                if column[c] >= 0:
                    table[s, column[c]] = place[to]
                else:
                    rare.append(int(place[s]) << _CODE | c)
                    beyond.append(place[to])
        tables.append(table.reshape(-1).astype(np.int32))
        roots.append(base)
        lost.append(place[-1])
        base += table.size
    order = np.argsort(np.array(rare, dtype=np.int64), kind="stable")
    return Model(
        languages, symbols, blank, columns, np.concatenate(tables) if tables else np.empty(0, np.int32), np.array(roots, np.int32), np.array(lost, np.int32),
        np.array(rare, dtype=np.int64)[order], np.array(beyond, dtype=np.int32)[order], size,
    )


def beyond_columns(model: Model, state: np.ndarray, sign: np.ndarray, language: np.ndarray) -> np.ndarray:
    """Next states of texts at letters that have no column in a language's table, or complements where a phrase ended."""

    def led(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = at.astype(np.int64) << _CODE | sign
        spot = np.minimum(np.searchsorted(model.rare, key), len(model.rare) - 1)
        return model.rare[spot] == key, model.beyond[spot]

    on, to = led(state)
    begun, first = led(model.roots[language])
    return np.where(on, to, ~np.where(begun, first, model.lost[language]))


def phrases(codes: np.ndarray, n: np.ndarray, model: Model) -> np.ndarray:
    """Phrases that each text takes in each language. ``codes``: signs of all texts, ``n``: of each."""
    count = np.zeros((len(n), len(model.languages)), dtype=np.int32)
    if not len(codes):
        return count
    order = np.argsort(-n, kind="stable")
    place = (np.cumsum(n) - n)[order]
    alive = len(n) - np.searchsorted(np.sort(n), np.arange(n.max()), side="right")  # texts longer than t
    state = np.tile(model.roots, (len(n), 1))
    ended, table, some = np.zeros_like(state), model.table, len(model.rare) > 0
    for m in alive.tolist():
        s = state[:m]
        sign = codes[place[:m]]
        column = model.columns[sign]
        if some and (away := column < 0).any():
            text, language = np.nonzero(away)
            found = beyond_columns(model, s[text, language], sign[text], language)
            s[...] = table[s + np.maximum(column, 0)]
            s[text, language] = found
        else:
            s += column
            s[...] = table[s]
        over = s >> 31
        ended[:m] -= over
        s ^= over
        place[:m] += 1
    ended += 1  # the phrase that is open at the end
    count[order] = ended
    count[n == 0] = 0
    return count


def entropies(counts: np.ndarray, chars: np.ndarray, model: Model) -> np.ndarray:
    """Bits a character."""
    return counts * np.log2(model.size) / np.maximum(chars, 1)[:, None]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred string, score double (how far the second language is behind: 1 - best/second)
    and bits double (the winner's bits a character). The model has a bounded size and goes with the task.
    """
    common.bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "bits")]

    @F.pandas_udf("lang_pred string, score double, bits double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        for texts in batches:
            out = [pd.DataFrame({"lang_pred": np.empty(0, dtype=object), "score": np.empty(0), "bits": np.empty(0)})]
            values = [t or "" for t in texts]
            for first, last in common.slices(np.array([len(v) for v in values]), 50_000_000):
                part = values[first:last]
                if not m.languages:
                    out.append(pd.DataFrame({"lang_pred": ["und"] * len(part), "score": 0.0, "bits": 0.0}))
                    continue
                codes, chars = letters_of(part, m.symbols, m.blank)
                bits = entropies(phrases(codes, chars, m), chars, m)
                best = bits.argmin(axis=1)
                two = np.partition(bits, 1, axis=1)[:, :2] if len(m.languages) > 1 else np.column_stack([bits[:, 0], np.full(len(part), np.inf)])
                score = np.where(chars > 0, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-300), 0.0)
                names = np.where(chars > 0, np.array(m.languages, dtype=object)[best], "und")
                out.append(pd.DataFrame({"lang_pred": names, "score": np.clip(score, 0, 1), "bits": np.where(chars > 0, two[:, 0], 0.0)}))
            yield pd.concat(out, ignore_index=True)
        del m
        common.released()

    judged = judged.asNondeterministic()  # else a filter on its result makes Spark judge each text twice, in a worker more a task
    made = docs.withColumn("__lang", judged(F.col(text).cast("string")))
    return made.select(*(made[c] for c in kept), "__lang.lang_pred", "__lang.score", "__lang.bits")


def learned(docs: DataFrame) -> Model:
    """A model from the labelled rows of ``docs(doc_id, text, lang)`` that are not held out."""
    return train(sample(docs.where(common.fold(F.col("doc_id"), 4) != 2)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = learned(docs)
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", (common.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "bits")
