"""Stateful stream operators. State is by device or tile, bounded by what is still open; each has a batch twin.

All run on ``applyInPandasWithState``: a group's state is one row (its parts are arrays), rows come in Arrow
batches, and the state store keeps it with the query's checkpoint, so a lost executor resumes from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pointloom.operators.sync import SampleBuffer


def _rows(parts: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable")


def interval_pairs(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Exact once-only frame and sample pairs of ``events(device, kind, id, beg_us, end_us)``, frames (kind ``frame``) and
    samples (kind ``imu``, both times the sample's).

    With ``idle_ms`` a device that sends nothing for so long has ended: its frames that were never covered come out with
    a ``reason`` (``no_final_imu``, ``no_final_imu_coverage``) and no sample, and its state goes.

    State of a device: the running end, frames not covered yet, samples not used yet. The head frame waits until
    a sample at or after the running end has come, and holds up those behind it.
    """
    out = "device long, frame_id long, seq long, ts_us long" + (", reason string" if idle_ms else "")
    names = [x.split()[0] for x in out.split(", ")]
    state_schema = "high long, frames array<long>, begins array<long>, ends array<long>, seqs array<long>, times array<long>"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, frames, begins, ends, seqs, times = state.get if state.exists else (-(1 << 62), [], [], [], [], [])
        if state.hasTimedOut:
            state.remove()
            reason = "no_final_imu_coverage" if times else "no_final_imu"
            yield pd.DataFrame([(key[0], f, None, None, reason) for f in frames], columns=names).astype({"device": "int64", "frame_id": "Int64", "seq": "Int64", "ts_us": "Int64"})
            return
        rows = pd.concat(list(parts), ignore_index=True)
        is_frame, is_sample = (rows["kind"] == "frame").to_numpy(), (rows["kind"] == "imu").to_numpy()
        both = lambda held, name, own: np.concatenate([np.array(held, dtype=np.int64), rows[name].fillna(-(1 << 62)).to_numpy(dtype=np.int64)[own]])
        frames, begins, ends = both(frames, "id", is_frame), both(begins, "beg_us", is_frame), both(ends, "end_us", is_frame)
        order = np.lexsort((ends, frames, begins))
        frames, begins, ends = frames[order], begins[order], ends[order]
        seqs, times = both(seqs, "id", is_sample), both(times, "beg_us", is_sample)
        order = np.lexsort((seqs, times))
        seqs, times = seqs[order], times[order]
        # the running end before and with each frame; frames up to the first that no sample has reached yet are covered
        highs = np.maximum.accumulate(np.concatenate([np.array([high], dtype=np.int64), ends]))
        covered = int(np.searchsorted(highs[1:], times[-1], side="right")) if len(times) else 0
        first, last = np.searchsorted(times, highs[:covered], side="right"), np.searchsorted(times, ends[:covered], side="right")
        n = np.maximum(last - first, 0)
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        found = pd.DataFrame({"device": np.full(len(at), key[0], dtype=np.int64), "frame_id": np.repeat(frames[:covered], n), "seq": seqs[at], "ts_us": times[at]})
        # the last sample stays known, since it says how far inertial data reach
        used = min(int(np.searchsorted(times, highs[covered], side="right")), max(0, len(times) - 1)) if covered else 0
        state.update((int(highs[covered]), *(x.tolist() for x in (frames[covered:], begins[covered:], ends[covered:], seqs[used:], times[used:]))))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
            found = found.assign(reason=pd.Series([None] * len(found), dtype=object))
        yield found

    timer = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("device").applyInPandasWithState(step, out, state_schema, "append", timer)


def buffered_pairs(arrivals: DataFrame) -> DataFrame:
    """As :func:`pointloom.operators.sync.buffered_pairs`, for a stream: a device's buffer is its state."""
    state_schema = "high long, last long, frames array<long>, ends array<long>, seqs array<long>, times array<long>"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, last, frames, ends, seqs, times = state.get if state.exists else (-(1 << 62), None, [], [], [], [])
        held = SampleBuffer(list(zip(seqs, times, strict=True)), list(zip(frames, ends, strict=True)), high, last)
        rows = []
        for kind, id, beg, end in _rows(parts, ["arrival"])[["kind", "id", "beg_us", "end_us"]].itertuples(index=False):
            rows += [(key[0], *x) for x in held.push(kind, int(id), int(beg), int(end))]
        state.update((held.high, held.last, [f for f, _ in held.frames], [e for _, e in held.frames], [s for s, _ in held.samples], [t for _, t in held.samples]))
        yield pd.DataFrame(rows, columns=["device", "frame_id", "seq", "ts_us", "reason"]).astype({"device": "int64", "frame_id": "Int64", "seq": "int64", "ts_us": "int64", "reason": object})

    return arrivals.groupBy("device").applyInPandasWithState(step, "device long, frame_id long, seq long, ts_us long, reason string", state_schema, "append", GroupStateTimeout.NoTimeout)


def throttle(messages: DataFrame, step_us: int) -> DataFrame:
    """Of ``messages(device, seq, ts_us)`` those at least ``step_us`` after the last one let through."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t, s in _rows(parts, ["ts_us", "seq"])[["ts_us", "seq"]].itertuples(index=False):
            if last is None or t >= last + step_us:
                kept.append((key[0], s, t))
                last = t
        state.update((last,))
        yield pd.DataFrame(kept, columns=["device", "seq", "ts_us"]).astype("int64")

    return messages.groupBy("device").applyInPandasWithState(step, "device long, seq long, ts_us long", "last long", "append", GroupStateTimeout.NoTimeout)


def count_or_time_frames(packets: DataFrame, most_s: float, most_points: int) -> DataFrame:
    """``packets(device, seq, ts_us, n_points)`` with frame and begin: a frame closes at ``most_s`` or ``most_points``."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame, begin, held = state.get if state.exists else (0, None, 0)
        out = []
        for t, s, n in _rows(parts, ["ts_us", "seq"])[["ts_us", "seq", "n_points"]].itertuples(index=False):
            if begin is None:
                begin, held = t, 0
            held += n
            out.append((key[0], s, frame, begin))
            if (t - begin) / 1e6 >= most_s or held >= most_points:
                frame, begin = frame + 1, None
        state.update((frame, begin, int(held)))
        yield pd.DataFrame(out, columns=["device", "seq", "frame", "begin_us"]).astype("int64")

    return packets.groupBy("device").applyInPandasWithState(step, "device long, seq long, frame long, begin_us long", "frame long, begin long, held long", "append", GroupStateTimeout.NoTimeout)


def clock_epochs(samples: DataFrame) -> DataFrame:
    """``samples(device, seq, ts_us)``, in order of seq, with an epoch that rises where the clock goes back."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, last = state.get if state.exists else (0, None)
        out = []
        for s, t in _rows(parts, ["seq"])[["seq", "ts_us"]].itertuples(index=False):
            epoch += last is not None and t < last
            last = t
            out.append((key[0], s, t, epoch))
        state.update((int(epoch), last))
        yield pd.DataFrame(out, columns=["device", "seq", "ts_us", "epoch"]).astype("int64")

    return samples.groupBy("device").applyInPandasWithState(step, "device long, seq long, ts_us long, epoch long", "epoch long, last long", "append", GroupStateTimeout.NoTimeout)


TILE_CHANGE = "tx int, ty int, tz int, version long, n_points long, n_voxels long, points array<struct<vx:int,vy:int,vz:int,x:double,y:double,z:double,intensity:double>>"


def tile_changes(points: DataFrame) -> DataFrame:
    """The tiled map, kept up with ``points(tx, ty, tz, vx, vy, vz, frame_id, idx, x, y, z, intensity)`` by the ``latest`` policy.

    State of a tile: its version, points seen, and each voxel's last point. A batch upserts voxels, raises the version
    by one for each frame with a point in the tile, and emits the changed tile.
    """
    state_schema = "version long, n_points long, last_frame long, voxels array<string>, cells array<array<double>>"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, n_points, last_frame, names, cells = state.get if state.exists else (0, 0, None, [], [])
        held = dict(zip(names, cells, strict=True))
        rows = _rows(parts, ["frame_id", "idx"])
        frames = set(rows["frame_id"]) - {last_frame}
        for vx, vy, vz, *cell in rows[["vx", "vy", "vz", "x", "y", "z", "intensity"]].itertuples(index=False):
            held[f"{vx},{vy},{vz}"] = [float(c) for c in cell]
        version, n_points = version + len(frames), n_points + len(rows)
        state.update((int(version), int(n_points), int(rows["frame_id"].max()), list(held), [list(c) for c in held.values()]))
        made = [dict(zip(("vx", "vy", "vz", "x", "y", "z", "intensity"), (*map(int, n.split(",")), *c), strict=True)) for n, c in held.items()]
        yield pd.DataFrame({"tx": [key[0]], "ty": [key[1]], "tz": [key[2]], "version": [version], "n_points": [n_points], "n_voxels": [len(held)], "points": [made]})

    return points.groupBy("tx", "ty", "tz").applyInPandasWithState(step, TILE_CHANGE, state_schema, "append", GroupStateTimeout.NoTimeout)
