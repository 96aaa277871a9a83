"""Delivery of tile changes to consumers, with a ledger of what each of them has.

A batch of a stream brings tiles' newest versions and evictions. The ledger keeps, of each consumer and tile, the version that
was handed over and confirmed and the one that is still pending. A delivery that fails stays pending and goes out again with
the next batch, in its newest form. An evicted tile is deleted only where it was handed over; where it never was, what is
pending is dropped. A deletion's version is above all that went before (the tile's *floor*), and a tile that comes back
counts from there, so versions of a tile only rise. A consumer that joins, or asks for it, gets all live tiles.

Tables of a batch are written to folders of its own, from those of the batch before: a batch that is run again overwrites
what it left and sends the same rows under the same number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.operators.tiles import TILE

TILES = "tx int, ty int, tz int, version long, floor long, live boolean"
LEDGER = "consumer string, tx int, ty int, tz int, handed long, pending long, deleted boolean, resync boolean"
SENT = "tx int, ty int, tz int, version long, deleted boolean, resync boolean"


class NotDelivered(Exception):
    """A consumer didn't take a batch; it goes out again."""


def to_folders(path: str) -> Callable[[str, DataFrame, int], None]:
    """Sends a consumer's rows to a folder of its own a batch."""

    def send(consumer: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/consumer={consumer}/batch={batch_id}")

    return send


class Ledger:
    """A foreachBatch function over updates ``(tx, ty, tz, version, deleted)``. ``consumers(batch)`` names those that are there;
    ``resyncing(batch)`` those that want all live tiles again (a new one is to be named in its first batch)."""

    def __init__(self, path: str, consumers: Callable[[int], list[str]], resyncing: Callable[[int], list[str]], send: Callable[[str, DataFrame, int], None], most: int = 0):
        self.path, self.consumers, self.resyncing, self.send, self.most = path, consumers, resyncing, send, most

    def table(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame:
        """``tiles`` or ``ledger`` as a batch left it; the tiles are the map's snapshot at that batch."""
        schema = TILES if name == "tiles" else LEDGER
        return spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={batch_id}") if batch_id >= 0 else spark.createDataFrame([], schema)

    def _put(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        at = f"{self.path}/{name}/batch={batch_id}"
        df.write.mode("overwrite").parquet(at)
        return df.sparkSession.read.schema(df.schema).parquet(at)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, there = batch.sparkSession, self.consumers(batch_id)
        again = [c for c in self.resyncing(batch_id) if c in there]
        news = batch.groupBy(*TILE).agg(F.max_by(F.struct("version", "deleted"), F.struct("version", "deleted")).alias("u")).select(*TILE, F.col("u.version").alias("__v"), F.col("u.deleted").alias("__gone"))
        met = self.table(spark, "tiles", batch_id - 1).join(news, TILE, "full")
        floor, changed = F.coalesce("floor", F.lit(0).cast("long")), F.col("__v").isNotNull()
        now = met.select(
            *TILE, F.coalesce("__v", "version").alias("version"), F.when(F.col("__gone"), floor + F.col("__v") + 1).otherwise(floor).alias("floor"),
            F.coalesce(~F.col("__gone"), "live").alias("live"), changed.alias("changed"),
        )
        now = self._put(now, "news", batch_id)
        self._put(now.drop("changed"), "tiles", batch_id)
        names = F.array(*(F.lit(c) for c in there)).cast("array<string>")
        wanted = F.col("consumer").isin(*again) if again else F.lit(False)
        shown = F.when(F.col("live"), F.col("floor") + F.col("version")).otherwise(F.col("floor"))
        due = now.select(*TILE, "live", "changed", shown.alias("__shown"), F.explode(names).alias("consumer")).where(F.col("changed") | (F.col("live") & wanted))
        due = due.select("consumer", *TILE, "__shown", "live", wanted.alias("__again"))
        old = self.table(spark, "ledger", batch_id - 1).where(F.col("consumer").isin(*there) if there else F.lit(False))
        both = old.join(due, ["consumer", *TILE], "full")
        touched, takes = F.col("__shown").isNotNull(), F.col("live") | F.col("handed").isNotNull()
        merged = both.select(
            "consumer", *TILE, "handed", F.when(touched, F.when(takes, F.col("__shown"))).otherwise(F.col("pending")).alias("pending"),
            F.when(touched, ~F.col("live")).otherwise(F.coalesce("deleted", F.lit(False))).alias("deleted"),
            (F.coalesce("resync", F.lit(False)) | F.coalesce("__again", F.lit(False))).alias("resync"),
        )
        order = Window.partitionBy("consumer").orderBy(F.desc("deleted"), "pending", *TILE)
        first = F.row_number().over(order) <= self.most if self.most else F.lit(True)
        waiting = merged.where("pending IS NOT NULL").select("consumer", *TILE, first.alias("__out"))
        draft = self._put(merged.join(waiting, ["consumer", *TILE], "left").withColumn("__out", F.coalesce("__out", F.lit(False))), "draft", batch_id)
        failed = []
        for c in there:
            rows = draft.where((F.col("consumer") == c) & F.col("__out")).select(*TILE, F.col("pending").alias("version"), "deleted", (F.col("resync") & ~F.col("deleted")).alias("resync"))
            try:
                self.send(c, rows, batch_id)
            except NotDelivered:
                failed.append(c)
        done = F.col("__out") & ~F.col("consumer").isin(*failed) if failed else F.col("__out")
        left = draft.select(
            "consumer", *TILE, F.when(done, F.when(~F.col("deleted"), F.col("pending"))).otherwise(F.col("handed")).alias("handed"), F.when(~done, F.col("pending")).alias("pending"),
            (F.col("deleted") & ~done).alias("deleted"), (F.col("resync") & ~done & F.col("pending").isNotNull()).alias("resync"),
        )
        self._put(left.where(F.col("handed").isNotNull() | F.col("pending").isNotNull()), "ledger", batch_id)
