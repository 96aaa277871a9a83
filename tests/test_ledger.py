"""Deliveries, failures, evictions and resyncs against a walk in plain Python, and the known sequences."""

import random

import pytest

from pointloom.streaming import feeds, ledger

UPDATE = "tx int, ty int, tz int, version long, deleted boolean"


class Taker:
    """Keeps what it is sent; refuses where told to, after the rows were computed."""

    def __init__(self, refuses=()):
        self.got, self.refuses = {}, set(refuses)

    def __call__(self, consumer, rows, batch_id):
        found = sorted(tuple(r) for r in rows.collect())
        if (consumer, batch_id) in self.refuses:
            raise ledger.NotDelivered
        self.got[consumer, batch_id] = found


def run(spark, tmp_path, batches, taker, consumers=lambda k: ["a"], resyncing=lambda k: [], most=0):
    book = ledger.Ledger(str(tmp_path), consumers, resyncing, taker, most)
    for k, rows in enumerate(batches):
        book(spark.createDataFrame(rows, UPDATE), k)
    return book


def test_only_tiles_that_were_handed_over_are_deleted(spark, tmp_path):
    live, gone, other = (0, 0, 0, 1, False), (0, 0, 0, 1, True), (1, 0, 0, 1, False)
    taker = Taker(refuses=[("a", 0)])
    run(spark, tmp_path / "unconfirmed", [[live], [gone, other]], taker)
    assert taker.got == {("a", 1): [(1, 0, 0, 1, False, False)]}
    taker = Taker()
    book = run(spark, tmp_path / "confirmed", [[live], [gone, other]], taker)
    assert taker.got["a", 0] == [(0, 0, 0, 1, False, False)] and taker.got["a", 1] == [(0, 0, 0, 2, True, False), (1, 0, 0, 1, False, False)]
    book(spark.createDataFrame([live], UPDATE), 2)  # it comes back, above its deletion
    assert taker.got["a", 2] == [(0, 0, 0, 3, False, False)]


def test_failed_batches_go_out_again_in_their_newest_form(spark, tmp_path):
    taker = Taker(refuses=[("a", 0), ("a", 1)])
    run(spark, tmp_path, [[(0, 0, 0, 1, False), (1, 0, 0, 1, False)], [(0, 0, 0, 5, False)], []], taker)
    assert taker.got == {("a", 2): [(0, 0, 0, 5, False, False), (1, 0, 0, 1, False, False)]}


def test_new_consumer_gets_all_and_a_repeated_batch_the_same(spark, tmp_path):
    taker = Taker()
    batches = [[(0, 0, 0, 1, False), (1, 0, 0, 1, False)], [(1, 0, 0, 2, True)], [(2, 0, 0, 1, False)]]
    book = run(spark, tmp_path, batches, taker, lambda k: ["a", "b"] if k == 2 else ["a"], lambda k: ["b"] if k == 2 else [])
    assert taker.got["b", 2] == [(0, 0, 0, 1, False, True), (2, 0, 0, 1, False, True)] and taker.got["a", 2] == [(2, 0, 0, 1, False, False)]
    held = dict(taker.got)
    book(spark.createDataFrame(batches[2], UPDATE), 2)
    assert taker.got == held
    assert sorted(tuple(r) for r in book.table(spark, "tiles", 1).where("live").collect()) == [(0, 0, 0, 1, 0, True)]  # the snapshot at a batch


def test_bounded_batches_take_deletions_first(spark, tmp_path):
    taker = Taker()
    run(spark, tmp_path, [[(i, 0, 0, 1 + i, False) for i in range(4)], [(0, 0, 0, 1, True)], [], [], []], taker, most=2)
    assert taker.got["a", 0] == [(0, 0, 0, 1, False, False), (1, 0, 0, 2, False, False)]
    assert taker.got["a", 1] == [(0, 0, 0, 2, True, False), (2, 0, 0, 3, False, False)] and taker.got["a", 2] == [(3, 0, 0, 4, False, False)] and taker.got["a", 3] == []


def walk(batches, consumers, resyncing, refuses):
    """One tile and one consumer at a time."""
    tiles, handed, pending, got = {}, {}, {}, {}
    for k, rows in enumerate(batches):
        news = {}
        for *t, v, gone in rows:
            news[tuple(t)] = max(news.get(tuple(t), (-1, False)), (v, gone))
        for t, (v, gone) in news.items():
            floor = tiles.get(t, (0, 0, False))[1]
            tiles[t] = (v, floor + v + 1 if gone else floor, not gone)
        for c in consumers(k):
            for t, (v, floor, live) in tiles.items():
                again = c in resyncing(k)
                if t in news or (live and again):
                    mark = again or pending.get((c, t), (0, 0, False))[2]
                    if live:
                        pending[c, t] = (floor + v, False, mark)
                    elif handed.get((c, t)) is not None:
                        pending[c, t] = (floor, True, mark)
                    else:
                        pending.pop((c, t), None)
            out = sorted((*t, v, gone, mark and not gone) for (own, t), (v, gone, mark) in pending.items() if own == c)
            if (c, k) in refuses:
                continue
            got[c, k] = out
            for row in out:
                handed[c, row[:3]] = None if row[4] else row[3]
                del pending[c, row[:3]]
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_a_walk(spark, tmp_path, seed):
    rng = random.Random(seed)
    batches, version = [], {}
    for _ in range(6):
        rows = []
        for t in rng.sample(range(6), rng.randint(0, 4)):
            version[t] = version.get(t, 0) + 1
            rows += [(t, 0, 0, version[t], rng.random() < 0.4)] * rng.randint(1, 2)
        batches.append(rows)
    there = lambda k: ["a", "b"] if k < 3 else ["a", "b", "c"]
    again = lambda k: {3: ["c"], 5: ["a"]}.get(k, [])
    refuses = {(c, k) for c in "abc" for k in range(6) if rng.random() < 0.3}
    taker = Taker(refuses)
    run(spark, tmp_path, batches, taker, there, again)
    assert taker.got == walk(batches, there, again, refuses)


def test_a_failing_sink_in_a_stream(spark, tmp_path):
    """The sink breaks down once in the middle of a batch; the restarted query sends the same rows, each version once."""
    taker, broken = Taker(), []

    def send(consumer, rows, batch_id):
        if batch_id == 1 and not broken:
            broken.append(1)
            raise RuntimeError("down")
        taker(consumer, rows, batch_id)

    book = ledger.Ledger(f"{tmp_path}/book", lambda k: ["a"], lambda k: [], send)
    for k, rows in enumerate([[(0, 0, 0, 1, False)], [(0, 0, 0, 1, True), (1, 0, 0, 1, False)]]):
        spark.createDataFrame(rows, UPDATE).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):
            try:
                feeds.run_to_end(spark.readStream.schema(UPDATE).parquet(f"{tmp_path}/in"), lambda path: book, path=str(tmp_path), state=f"{tmp_path}/state")
            except Exception:
                assert k == 1 and broken
    assert taker.got == {("a", 0): [(0, 0, 0, 1, False, False)], ("a", 1): [(0, 0, 0, 2, True, False), (1, 0, 0, 1, False, False)]}
