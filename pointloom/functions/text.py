"""Keys, log tokens and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_id(*key: Column) -> Column:
    return F.concat_ws("/", F.lit("tile"), *(k.cast("string") for k in key))


def tile_key(*key: Column) -> Column:
    return F.concat_ws(",", *(k.cast("string") for k in key))


def log_token(value: Column) -> Column:
    """Letters, digits and ``._:/-``; other signs become ``_``; 255 at most; ``unknown`` where empty."""
    kept = F.regexp_replace(F.substring(value, 1, 255), r"[^A-Za-z0-9._:/-]", "_")
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, "unknown").otherwise(kept)


def log_fields(line: Column) -> Column:
    """The line's ``key=value`` pairs as a map; the last of a repeated key counts."""
    pairs = F.filter(F.split(line, " "), lambda p: F.instr(p, "=") > 1)
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def log_value(fields: Column, key: str, kind: str) -> Column:
    return F.element_at(fields, F.lit(key)).try_cast(kind)


def log_position(fields: Column, key: str = "pos") -> list[Column]:
    """x, y, z of a value like ``(a,b,c)``."""
    value = F.element_at(fields, F.lit(key))
    return [F.regexp_extract(value, r"^\(([^,()]+),([^,()]+),([^,()]+)\)$", i).try_cast("double") for i in (1, 2, 3)]


def publish_interval(base_ms: Column, last_cost_ms: Column) -> Column:
    return F.greatest(base_ms.cast("bigint"), F.ceil(2 * last_cost_ms).cast("bigint"))


def tile_bytes(points: Column, per_point: int = 256, fixed: int = 0) -> Column:
    return points * per_point + fixed


def points_for_bytes(size: Column, per_point: int = 256, fixed: int = 0) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.floor((size - fixed) / per_point).cast("bigint"))
