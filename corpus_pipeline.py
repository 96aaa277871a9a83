"""A training corpus out of ``documents``: five stages, each one operator of ``pointloom.llm``.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept. All but the
last return the columns of documents. Stages are written as Parquet and read again in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common, langid, mixing, pieces, quality, simhash

#: A text of at least LEAST_CHARS that takes more bits a letter in its best language than the language's limit is in none
#: of them (prose of an alphabet takes 2 to 3, random letters 5 to 7). A limit is SPREAD times the median of the language's
#: own labelled held-out texts, MOST_BITS at least: a language of thousands of signs takes more. Shorter texts hold too few phrases
#: to tell, and stay.
MOST_BITS, SPREAD, LEAST_CHARS = 5.5, 1.6, 60


def _apart(docs: DataFrame, needed: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``work(docs)`` with the columns of ``docs``, as they are: all that it doesn't need stand aside meanwhile
    under names of their own, so none clashes with an operator's."""
    aside = {c: f"__aside_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    return work(docs.withColumnsRenamed(aside)).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def language_limits(told: DataFrame, lang: str) -> dict[str, float]:
    """Bits a letter that texts of each learned language may take: from all its labelled texts of LEAST_CHARS or more in
    ``told`` (as langid.predict leaves them) that are told as such and that the model didn't learn from (those take fewer). One
    number a language comes to the driver."""
    fresh = told.where((F.length("text") >= LEAST_CHARS) & (common.fold(F.col("doc_id"), 4) == 2) & (F.col("lang_pred") == F.col(lang)))
    middle = fresh.groupBy("lang_pred").agg(F.percentile_approx("bits", 0.5).alias("bits")).collect()
    return {r["lang_pred"]: max(MOST_BITS, SPREAD * r["bits"]) for r in middle}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier marks as good (score 0.7 or more). It learns from labelled rows of ``docs``.

    Null and empty texts are scored like any other, and stay or go by their score; texts of any length are read whole;
    equal texts fare alike, so ties and repeated rows stay or go together. Where nothing can be learned (no labels, or
    of one kind only) all rows stay. Columns of ``docs`` are kept as they are, whatever their names; no rows give none.
    """
    model = quality.learned(docs, common.read_table(spark, sf_dir, "labels", "doc_id", "quality"))
    if model.constant is not None:
        return docs
    return _apart(docs, ("text",), lambda d: quality.score(d, model).where("predicted = 1"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and are not far from all learned languages.

    Texts that are null, empty or without letters go (no language can be told). Texts of 60 characters or more go
    where even the best language takes more bits a letter than its own labelled texts let expect; shorter ones stay. Texts
    are parsed whole; equal texts fare alike. Where no language can be learned all rows stay. Columns of ``docs`` are kept
    as they are, whatever their names; no rows give none.
    """
    model = langid.learned(docs)
    if not model.languages:
        return docs

    def near(docs: DataFrame) -> DataFrame:
        told = common.written(langid.predict(docs, model).where("lang_pred <> 'und'"), "languages")
        limits = [F.lit(x) for pair in language_limits(told, "lang").items() for x in pair]
        limit = F.coalesce(F.try_element_at(F.create_map(*limits), F.col("lang_pred")), F.lit(MOST_BITS)) if limits else F.lit(MOST_BITS)
        return told.where((F.col("bits") <= limit) | (F.length("text") < LEAST_CHARS))

    return _apart(docs, ("doc_id", "text", "lang"), near)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (sets of five-word shingles, likeness 0.8): the smallest doc_id,
    of one id the row with the smallest hash of its text.

    Texts without words (null, empty) are one class. A text of fewer than five words is one shingle. Rows that repeat a
    doc_id and text count once; rows without doc_id stay. Texts of any length count whole. Columns of ``docs`` are kept as
    they are, whatever their names; no rows give none.
    """
    return simhash.deduplicated(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to their target weights and shuffled; a document drawn n times stands n times, one drawn no time goes.

    A null source is the source of the empty name; null and empty texts have size 0 and are drawn at their source's rate;
    rows with one doc_id draw alike. Columns of ``docs`` are kept as they are, whatever their names; no rows give none.
    """
    return _apart(docs, ("doc_id", "source", "text"), mixing.mixed)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row (little-endian unsigned 32-bit), their number, and whether they decode to the text.

    Null and empty texts have no ids; texts of any length are encoded whole; repeated rows give repeated results; further
    columns are left out; no rows give none.
    """
    coded = pieces.checked(docs.select("doc_id", "source", "text"), pieces.model_path())
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "ids", "decoded_ok")


STAGES = [
    ("quality_mil", keep_quality),
    ("language_id", keep_known_languages),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
