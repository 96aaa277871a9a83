"""Running values in order that no single task has to walk: a two-level prefix scan.

Rows are dealt by ranges of (keys, order), so one busy key is as many tasks as it fills. Each range is sorted and combined
by itself, batch by batch; what a range ends with is one row, and the few range totals are combined on the driver, in
order, into what each range starts with. That is put in front of the rows of the range's first key by column functions.

``combine(a, b)`` has to be associative, not commutative: ``a`` is what comes before ``b``. It gets dicts of a state's
components, as numpy arrays in the ranges, as Python numbers on the driver and as columns at the end, so it keeps to ``+``,
``-``, ``*`` and :func:`counted` comparisons. Floating-point components are added in another order than a serial walk's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pointloom.sources import scratch

State = dict[str, Any]
#: Stand for a time that is unknown: a gap or a step back is never counted across them, and differences stay longs.
FAR = 1 << 61


def counted(test: Any) -> Any:
    """1 where a comparison holds, else 0: of numbers, arrays or columns."""
    return test.cast("long") if isinstance(test, Column) else test * 1


def added(a: State, b: State) -> State:
    """The running sum."""
    return {k: a[k] + b[k] for k in a}


def within(state: dict[str, np.ndarray], starts: np.ndarray, combine: Callable[[State, State], State]) -> dict[str, np.ndarray]:
    """Each row's own state combined with all before it since the last of ``starts``, by doubling steps."""
    n = len(starts)
    place = np.arange(n) - np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    step, longest = 1, int(place.max(initial=0)) + 1
    while step < longest:
        at = np.flatnonzero(place >= step)
        new = combine({k: v[at - step] for k, v in state.items()}, {k: v[at] for k, v in state.items()})
        state = {k: v.copy() for k, v in state.items()}
        for k, v in new.items():
            state[k][at] = v
        step *= 2
    return state


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are, nulls included."""
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def prefix(rows: DataFrame, keys: list[str], order: list[str], own: dict[str, Column], combine: Callable[[State, State], State] = added, parts: int | None = None) -> DataFrame:
    """``rows`` with the components of ``own`` (long or double, never null; new names) as they stand after each row: its own
    state combined with those of all rows of its key before it, in ``order`` (which should leave no ties).

    The rows are written once to the shared folder, so ranges stay as they are if executors are lost. A lost task repeats
    its range only.
    """
    spark = rows.sparkSession
    names = list(own)
    lifted = rows.withColumns(own)
    placed = lifted.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*lifted.schema, T.StructField("__scan_part", T.IntegerType()), T.StructField("__scan_at", T.LongType()), T.StructField("__scan_first", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, first_run, key, held = TaskContext.get().partitionId(), 0, True, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, dtype=bool)
            for k in keys:
                code = _codes(batch.column(k))
                starts[1:] |= code[1:] != code[:-1]
            begins = tuple(batch.column(k)[0].as_py() for k in keys)
            carried = key is not None and begins == key
            first = np.full(n, first_run and (key is None or carried)) & (np.cumsum(starts) == 0)
            state = within({c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}, starts, combine)
            if carried:
                run = int(np.argmax(starts)) if starts.any() else n
                opened = combine({k: np.full(run, v) for k, v in held.items()}, {k: v[:run] for k, v in state.items()})
                state = {k: np.concatenate([opened[k], v[run:]]) for k, v in state.items()}
            key, held, first_run = tuple(batch.column(k)[n - 1].as_py() for k in keys), {k: v[-1] for k, v in state.items()}, bool(first[-1])
            made = {**{c: batch.column(c) for c in batch.schema.names}, **state, "__scan_part": np.full(n, part), "__scan_at": np.arange(at, at + n), "__scan_first": first}
            at += n
            yield pa.RecordBatch.from_arrays([c if isinstance(c := made[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow)

    table = scratch.written(placed.mapInArrow(scan, schema), "scan")
    last = F.max_by(F.struct(*keys, *names, "__scan_first"), "__scan_at").alias("last")
    ends = sorted(table.groupBy("__scan_part").agg(F.min_by(F.struct(*keys), "__scan_at").alias("first"), last).collect(), key=lambda r: r["__scan_part"])  # a row a range
    carries, key, held = [], None, None
    for e in ends:
        total = {c: e["last"][c] for c in names}
        into = held if held is not None and tuple(e["first"]) == key else None
        if into is not None:
            carries.append((e["__scan_part"], *(into[c] for c in names)))
        held = combine(into, total) if into is not None and e["last"]["__scan_first"] else total
        key = tuple(e["last"][k] for k in keys)
    kinds = dict(lifted.dtypes)
    carry = spark.createDataFrame(carries, ", ".join(["__carry_part int", *(f"__carry_{c} {kinds[c]}" for c in names)]))
    met = table.join(F.broadcast(carry), (F.col("__scan_part") == F.col("__carry_part")) & F.col("__scan_first"), "left")  # at most a row a range
    whole = combine({c: F.col(f"__carry_{c}") for c in names}, {c: F.col(c) for c in names})
    return met.select(*(F.col(c) for c in rows.columns if c not in own), *(F.when(F.col("__carry_part").isNull(), F.col(c)).otherwise(whole[c]).alias(c) for c in names))


def row_numbers(rows: DataFrame, keys: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with their number from 1 in ``order`` by ``keys``."""
    return prefix(rows, keys, order, {name: F.lit(1).cast("long")}, parts=parts)


def breaks(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, gap: int | None = None, parts: int | None = None) -> DataFrame:
    """``rows`` with the number of breaks up to each of them: of ``value`` going on by more than ``gap`` from one row to the
    next, or, without a gap, going back. A null value breaks nothing."""
    known = F.col(value).cast("long")
    first, last = (-FAR, FAR) if gap is not None else (FAR, -FAR)

    def combine(a: State, b: State) -> State:
        away = b["__scan_begin"] - a["__scan_end"]
        broken = counted(away > gap) if gap is not None else counted(away < 0)
        return {name: a[name] + b[name] + broken, "__scan_begin": a["__scan_begin"], "__scan_end": b["__scan_end"]}

    own = {name: F.lit(0).cast("long"), "__scan_begin": F.coalesce(known, F.lit(first)), "__scan_end": F.coalesce(known, F.lit(last))}
    return prefix(rows, keys, order, own, combine, parts).drop("__scan_begin", "__scan_end")
