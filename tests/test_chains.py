"""Kept chains against the serial rule."""

import random

import numpy as np
import pytest

from pointloom.operators import chains


def serial(rows, gap):
    out = []
    for key in {r[0] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: r[1:]):
            if last is None or r[1] >= last + gap:
                out.append(r)
                last = r[1]
    return sorted(out, key=str)


@pytest.mark.parametrize(("gap", "bucket"), [(7, 50), (60, 20), (1, 1000), (10, 10), (5, 100_000)])
def test_equal_to_the_serial_rule(spark, gap, bucket):
    rng = random.Random(gap)
    rows, t = [], 0
    for seq in range(800):
        t += rng.choice([0, 1, 2, 9, 300 if rng.random() < 0.02 else 0])
        rows.append(("hot" if rng.random() < 0.9 else rng.choice(["a", None]), None if rng.random() < 0.02 else t - 500, seq))
    df = spark.createDataFrame(rows, "device string, ts_us long, seq long").repartition(5)
    assert sorted((tuple(r) for r in chains.kept(df, ["device"], "ts_us", "seq", gap, bucket).collect()), key=str) == serial(rows, gap)


def test_steps_give_every_chain_and_are_few():
    rng = np.random.default_rng(1)
    for gap in (1, 5, 40):
        t = np.sort(rng.choice(3_000, 700, replace=False)) + 100
        upto, leave = chains.steps_of(t, gap, 100)
        assert len(upto) <= (t < 100 + gap).sum() + 1
        for start in range(-5, 100 + gap):
            own = chains.chain_of(t, start, gap)
            assert t[own[-1]] + gap == leave[np.searchsorted(upto, start)]
    assert chains.steps_of(np.arange(0, 10_000, 2), 20, 0)[0].tolist() == list(range(0, 21, 2))  # even times: chains never meet


def test_no_rows_and_times_alike(spark):
    none = spark.createDataFrame([], "device string, ts_us long, seq long")
    assert chains.kept(none, ["device"], "ts_us", "seq", 5).count() == 0
    same = spark.createDataFrame([("a", 3, i) for i in range(50)], none.schema)
    assert [tuple(r) for r in chains.kept(same, ["device"], "ts_us", "seq", 5).collect()] == [("a", 3, 0)]
