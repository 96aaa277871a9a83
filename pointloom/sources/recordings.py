"""Recordings at fleet size: an index of frames read by tasks, and a scan of those frames that are wanted; and a writer.

The index is a table of a row a frame, so seeking is a filter on it (recording, frame, time), and what it leaves out is never
opened. Frames are dealt out evenly by their bytes' order, however many a recording has. The driver lists file names only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.sources import lvx, scratch

INDEX = "recording string, frame_index bigint, start bigint, size bigint, base_ns bigint, time_s double"
#: Frames of a file that is written, and raw points of its packets (fixed value of the format for data type 2).
FILE_FRAMES, RAW = 1_000, 96
#: Tag of points that only fill up a packet.
FILLER = 255


def index(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """Frames of all lvx files of a folder (columns of ``INDEX``; time of the frame's first packet, from the file's first).
    Each task follows the offsets of its files."""
    paths = lvx.listed(path, ".lvx")
    files = spark.createDataFrame([(p,) for p in paths], "recording string").repartition(max(1, min(len(paths), parts or spark.sparkContext.defaultParallelism)), "recording")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("recording").to_pylist():
                frames, base, _ = lvx.frame_index(p)
                rows = [(p, n, start, end - start, base, (first - base) / 1e9) for n, start, end, first in frames]
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    return files.mapInArrow(scan, INDEX)


def points(frames: DataFrame, parts: int | None = None) -> DataFrame:
    """Points (as of the ``lvx`` source) of the frames of an index that are left."""
    names = [c.split()[0] for c in lvx.SCHEMAS["points"].split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        for batch in batches:
            for path, number, start, size, base in zip(*(batch.column(c).to_pylist() for c in ("recording", "frame_index", "start", "size", "base_ns")), strict=True):
                if path != opened:
                    if f is not None:
                        f.close()
                    store, at = lvx._opened(path)
                    opened, f = path, store.open_input_file(at)
                f.seek(start)
                frame = lvx.decode_frame(f.read(size), base)
                if frame.points:
                    p = np.concatenate(frame.points)
                    n = len(p)
                    columns = [pa.array([path] * n), pa.array(np.full(n, number)), pa.array(np.full(n, frame.time_s)), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(p[:, k]) for k in range(3))]
                    columns += [pa.array(p[:, 3].astype(np.int32)), pa.array(p[:, 4].astype(np.int32)), pa.array(np.zeros(n, dtype=np.int32)), pa.array(p[:, 5].astype(np.int64)), pa.array(p[:, 6].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        if f is not None:
            f.close()

    parts = parts or int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frames.repartitionByRange(parts, "recording", "frame_index").sortWithinPartitions("recording", "frame_index").mapInArrow(scan, lvx.SCHEMAS["points"])


def frame_bytes(rows: np.ndarray, ts_ns: int) -> bytes:
    """Packets of data type 2, a millisecond apart, of rows (x_mm, y_mm, z_mm, reflectivity, tag); the last is filled up."""
    layout = lvx.LAYOUTS[2][2]
    full = np.zeros(-(-len(rows) // RAW) * RAW, dtype=layout)
    full["tag0"] = FILLER
    for i, name in enumerate(("x0", "y0", "z0", "refl0", "tag0")):
        full[name][: len(rows)] = rows[:, i]
    out = b""
    for i in range(0, len(full), RAW):
        out += bytes(10) + bytes([2]) + int(ts_ns + i // RAW * 1_000_000).to_bytes(8, "little") + full[i : i + RAW].tobytes()
    return out


def write(rows: DataFrame, path: str) -> DataFrame:
    """Writes ``rows(recording, frame, ts_ns, idx, x_mm, y_mm, z_mm, reflectivity, tag)`` as lvx files ``<recording>-<number>.lvx``
    of FILE_FRAMES frames, so a long recording is many tasks; gives (file, frames, points). A task holds a frame at a time; a
    file gets its name when it is whole, so a task that is run again leaves no half files."""
    part = F.floor(F.col("frame") / FILE_FRAMES).cast("bigint")
    dealt = rows.withColumn("__part", part).repartition("recording", "__part").sortWithinPartitions("recording", "__part", "frame", "idx")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = lvx._opened(path)
        store.create_dir(top, recursive=True)
        state = {"file": None, "frame": None, "rows": [], "out": None, "at": 0, "frames": 0, "points": 0}
        done = []

        def close_frame() -> None:
            if state["rows"]:
                data = frame_bytes(np.concatenate(state["rows"]), state["frame"][1])
                end = state["at"] + lvx.FRAME.size + len(data)
                state["out"].write(lvx.FRAME.pack(state["at"], end, state["frames"]) + data)
                state.update(at=end, frames=state["frames"] + 1, points=state["points"] + sum(map(len, state["rows"])), rows=[])

        def close_file() -> None:
            close_frame()
            if state["out"] is not None:
                state["out"].close()
                store.move(state["draft"], f"{top}/{state['name']}")
                done.append((state["name"], state["frames"], state["points"]))

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("recording", "__part", "frame", "ts_ns")), strict=True))
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x_mm", "y_mm", "z_mm", "reflectivity", "tag")])
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                recording, number, frame, ts = keys[a]
                if state["file"] != (recording, number):
                    close_file()
                    name = f"{recording}-{number:06d}.lvx"
                    draft = f"{top}/.{name}.{TaskContext.get().taskAttemptId()}"
                    out = store.open_output_stream(draft)
                    head = lvx.HEADER.pack(b"signature", bytes([1, 1, 0, 0]), lvx.MAGIC, 50, 0)
                    out.write(head)
                    state.update(file=(recording, number), name=name, draft=draft, out=out, at=len(head), frames=0, points=0, frame=None)
                if state["frame"] != (frame, ts):
                    close_frame()
                    state["frame"] = (frame, ts)
                state["rows"].append(values[a:b])
        close_file()
        columns = zip(*done, strict=True) if done else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "frames", "points"])

    return scratch.written(dealt.mapInArrow(put, "file string, frames bigint, points bigint"), "lvx-manifest")
