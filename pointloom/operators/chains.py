"""Chains in time: of each key the first row is kept, then always the first one at least ``gap`` after the last kept.

What is kept depends on what was kept before, so a serial rule walks a key's rows one by one. Here rows are cut into time
buckets, and a bucket works out its rule for every way of entering it at once: the row that is next after each row is found
by search, the last row of each row's chain by doubling these pointers. A bucket can only be entered by a time allowed before
``gap`` after its beginning (the last kept row is older), so what it does is a table of no more rows than one gap holds. Only
these tables are walked, a key after the other; then every bucket knows how it is entered and marks its own chain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.walks import walked

BUCKET_US = 3_600_000_000
_EARLY = -(1 << 62)


def steps_of(t: np.ndarray, gap: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """(upto, exit) of sorted times of a bucket that begins at ``begin``: who is allowed at ``upto`` or before, but after the
    row before, leaves at ``exit``. Times allowed are before ``begin + gap``."""
    after = np.searchsorted(t, t + gap)
    last = np.where(after < len(t), after, np.arange(len(t)))
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    leave = t[last] + gap
    ends = np.append(leave[1:] != leave[:-1], True)
    upto, leave = t[ends], leave[ends]
    few = int(np.searchsorted(upto, begin + gap)) + 1
    return upto[:few], leave[:few]


def chain_of(t: np.ndarray, start: int, gap: int) -> list[int]:
    """Places of the chain in sorted times that may begin at ``start``."""
    after = np.searchsorted(t, t + gap).tolist()
    at, out = int(np.searchsorted(t, start)), []
    while at < len(t):
        out.append(at)
        at = after[at]
    return out


def kept(rows: DataFrame, keys: list[str], time: str, order: str, gap: int, bucket: int = BUCKET_US) -> DataFrame:
    """(keys, time, order) of the rows kept, ``gap`` > 0. Of rows at one time only the one with the smallest ``order`` can be
    kept, so ties are summed up first; rows without a time take no part."""
    kinds = dict(rows.dtypes)
    own = rows.where(F.col(time).isNotNull()).groupBy(*keys, F.col(time).cast("bigint").alias(time)).agg(F.min(order).alias(order))
    dealt = own.withColumn("__bucket", F.floor(F.col(time) / bucket).cast("bigint"))
    head = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "__bucket bigint"])

    def first_row(table: pa.Table, n: int) -> list[pa.ChunkedArray]:
        at = pa.array(np.zeros(n, dtype=np.int64))
        return [table.column(c).take(at) for c in (*keys, "__bucket")]

    def steps(table: pa.Table) -> pa.Table:
        upto, leave = steps_of(np.sort(table.column(time).to_numpy()), gap, table.column("__bucket")[0].as_py() * bucket)
        return pa.table([*first_row(table, len(upto)), pa.array(upto), pa.array(leave)], names=[*keys, "__bucket", "__upto", "__exit"])

    def enter(held: dict, row: dict) -> tuple | None:
        out = None
        if held["bucket"] != row["__bucket"]:
            out = (row["__bucket"], held["start"])
            held.update(bucket=row["__bucket"], open=True)
        if held["open"] and row["__upto"] >= held["start"]:
            held.update(start=row["__exit"], open=False)
        return out

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by(time)
        return left.take(pa.array(chain_of(left.column(time).to_numpy(), right.column("__start")[0].as_py(), gap), pa.int64())).select([*keys, time, order])

    walls = dealt.groupBy(*keys, "__bucket").applyInArrow(steps, f"{head}, __upto bigint, __exit bigint")
    entries = walked(walls, keys, ["__bucket", "__upto"], lambda: {"start": _EARLY, "bucket": None, "open": False}, enter, "__bucket bigint, __start bigint")
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{time} bigint", f"{order} {kinds[order]}"])
    return dealt.groupBy(*keys, "__bucket").cogroup(entries.groupBy(*keys, "__bucket")).applyInArrow(mark, schema)
