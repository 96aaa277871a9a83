"""Folds in order: what a row gives depends on a small state that the rows of its key before it left."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def walked(rows: DataFrame, keys: list[str], order: list[str | Column], start: Callable[[], Any], step: Callable[[Any, dict], tuple | list[tuple] | None], schema: str) -> DataFrame:
    """Of each row of ``rows``, in ``order`` by ``keys``, what ``step(state, row)`` gives (columns of ``schema``, after the
    keys); None leaves the row out, a list gives several. ``start()`` makes a key's state, which ``step`` changes.

    Rows are dealt by key, sorted and passed through in Arrow batches: a task holds one batch and one state, however
    many rows a key has, and repeats exactly if it is lost. A key's rows go through one task one after the other; that is
    in the nature of such a rule, so rows should be the few things it is about (frames, packets, tiles), not points.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), *T.StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if state is None or own != key:
                    key, state = own, start()
                found = step(state, row)
                made += [own + x for x in (found if isinstance(found, list) else [] if found is None else [found])]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(scan, out)
