"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source of size ``s`` (code points) with target weight ``w`` gets the mean repetition rate
``total * w / s``, so that the mixture keeps the total size and meets the weights. Each document
draws a uniform number from a hash of seed and id, and inverts its source's Poisson distribution:
its count is the number of k whose cumulative probability is at or below the draw. Documents are
exploded by their counts and dealt out by a hash of (seed, id, replica), sorted by it within
partitions: a global random order that a lost task repeats exactly.

The source table (one row a source: its cumulative probabilities) is written first, so Spark knows
its size and broadcasts it only below its own threshold. A hot source costs one row a task in the
sums (partial aggregates), and its documents are never gathered.

Defined results
    * without target weights, a source's weight is the square root of its size (``temperature`` 0.5);
    * null source counts as the source ``''``; null text has size 0; a source of size 0 has rate 1;
    * a source without a target weight (or with weight 0) has rate 0 and goes;
    * repeated rows with one doc_id draw alike; null doc_id draws as the text ``null``;
    * an empty table gives no rows; extra columns are kept whatever their names, ``replica`` and
      ``shuffle_key`` replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm import common

SEED, TEMPERATURE = 42, 0.5


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(mix_source, rate, cdf array<double>) for each source of ``docs(source, text)``."""
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source")).agg(
        F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0))).cast("double").alias("size")
    )
    if weights is None:
        weight = F.pow("size", F.lit(temperature))
    else:
        pairs = [F.lit(x) for name, w in weights.items() for x in (name, float(w))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("mix_source")), F.lit(0.0)) if pairs else F.lit(0.0)
    weighed = sizes.withColumn("weight", weight)
    whole = weighed.agg(F.sum("size").alias("total"), F.sum("weight").alias("weights"))
    rate = F.when(F.col("size") > 0, F.try_divide(F.try_divide(F.col("total") * F.col("weight"), F.col("weights")), F.col("size"))).otherwise(F.lit(1.0))
    table = weighed.crossJoin(F.broadcast(whole)).select("mix_source", F.coalesce(rate, F.lit(0.0)).alias("rate"))  # the other side is one row
    # log p(k) = -rate + sum of ln(rate / j) up to k; far enough that what is left is below 2**-53
    reach = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 25).cast("int")
    steps = table.select("mix_source", "rate", F.explode(F.sequence(F.lit(0), reach)).alias("k"))
    upto = Window.partitionBy("mix_source").orderBy("k")
    step = F.when(F.col("k") > 0, F.ln(F.col("rate") / F.col("k"))).otherwise(-F.col("rate"))
    chance = F.when(F.col("rate") > 0, F.exp(F.sum(step).over(upto))).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    summed = steps.withColumn("p", chance).withColumn("cdf", F.sum("p").over(upto))
    return summed.groupBy("mix_source", "rate").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"]).alias("cdf"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, source, text, ...)`` replicated and shuffled; adds replica int and shuffle_key string."""
    return common.aside(docs, ("doc_id", "source", "text"), lambda d: _mixed(d, weights, temperature, seed))


def _mixed(docs: DataFrame, weights: dict[str, float] | None, temperature: float, seed: int) -> DataFrame:
    table = common.written(rates(docs, weights, temperature), "mix-rates")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"poisson:{seed}:"), key)), 1, 13), 16, 10).cast("bigint") / float(1 << 52)
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    drawn = docs.select("*", draw.alias("__draw"), source.alias("__source")).join(table, F.col("__source") == table["mix_source"])
    copies = drawn.withColumn("__copies", F.size(F.filter("cdf", lambda c: c <= F.col("__draw")))).where("__copies > 0")
    replicas = copies.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("replica"))
    order = F.md5(F.concat(F.lit(f"order:{seed}:"), key, F.lit(":"), F.col("replica").cast("string")))
    placed = replicas.withColumn("shuffle_key", F.substring(order, 1, 16))
    return placed.repartition(common.partitions_of(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    found = mixed(docs)
    return found.select("doc_id", "source", "replica", F.length("text").cast("long").alias("n_chars"), "shuffle_key")


OP8_SQL = """
WITH sizes AS (SELECT coalesce(source, '') AS mix_source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY 1),
weighed AS (SELECT *, pow(size, 0.5) AS weight FROM sizes),
rates AS (SELECT mix_source, CASE WHEN size > 0 THEN (SELECT sum(size) FROM weighed) * weight / (SELECT sum(weight) FROM weighed) / size ELSE 1.0 END AS rate FROM weighed),
steps AS (SELECT mix_source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 25)::BIGINT)) AS k FROM rates),
chances AS (SELECT mix_source, k, exp(sum(CASE WHEN k > 0 THEN ln(rate / k) ELSE -rate END) OVER (PARTITION BY mix_source ORDER BY k)) AS p FROM steps),
cdfs AS (SELECT mix_source, k, sum(p) OVER (PARTITION BY mix_source ORDER BY k) AS cdf FROM chances),
draws AS (SELECT doc_id, source, text, coalesce(source, '') AS mix_source,
    ('0x' || substr(md5('poisson:42:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS draw FROM documents),
counted AS (SELECT d.doc_id, d.source, length(d.text)::BIGINT AS n_chars, count(*) AS copies
    FROM draws d JOIN cdfs c ON c.mix_source = d.mix_source AND c.cdf <= d.draw GROUP BY d.doc_id, d.source, length(d.text)),
replicas AS (SELECT doc_id, source, n_chars, unnest(generate_series(1, copies))::INTEGER AS replica FROM counted)
SELECT doc_id, source, replica, n_chars, substr(md5('order:42:' || doc_id::VARCHAR || ':' || replica::VARCHAR), 1, 16) AS shuffle_key FROM replicas
"""
