"""The ``lvx`` data source: recordings of packets as tables of points, samples, frames or devices.

    spark.dataSource.register(LvxSource)
    spark.read.format("lvx").option("kind", "points").load("/recordings")

The driver follows the frame offsets (43 bytes a frame) and cuts files into ranges of frames; tasks read
their range and decode it with numpy. For many files :mod:`pointloom.sources.recordings` lets tasks follow the offsets.
Files are opened through Arrow's file systems, by URI.

Decoding rules: follow the offsets until one is bad, a frame is empty or above 10 MiB; packets of an unknown type
or cut short end their frame and are counted; times are relative to the file's first packet.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from pointloom.operators.points import INTERVAL_NS, OTHER_INTERVAL_NS, U32

MAGIC, HEADER, FRAME, PACKET = 0xAC0EA767, struct.Struct("<16s4sIIB"), struct.Struct("<QQQ"), 19
DEVICE = np.dtype([("code", "S16"), ("hub", "S16"), ("index", "u1"), ("type", "u1"), ("extrinsic", "u1"), *((n, "<f4") for n in ("roll", "pitch", "yaw", "x", "y", "z"))])
MOST_FRAME = 10 * 1024 * 1024
SAMPLE = 6


def _points(*shared: tuple, returns: int, fields: list[tuple]) -> np.dtype:
    return np.dtype([*shared, *((f"{n}{i}", t) for i in range(returns) for n, t in fields)])


_XYZ, _REFL, _TAG = [(c, "<i4") for c in "xyz"], [("refl", "u1")], [("tag", "u1")]
_ANGLES = (("theta", "<u2"), ("phi", "<u2"))
#: Data type: raw points in a packet, returns of each, and their layout (fixed values of the format).
LAYOUTS = {
    0: (100, 1, _points(returns=1, fields=_XYZ + _REFL)),
    1: (100, 1, np.dtype([("depth0", "<u4"), *_ANGLES, ("refl0", "u1")])),
    2: (96, 1, _points(returns=1, fields=_XYZ + _REFL + _TAG)),
    3: (96, 1, np.dtype([("depth0", "<u4"), *_ANGLES, ("refl0", "u1"), ("tag0", "u1")])),
    4: (48, 2, _points(returns=2, fields=_XYZ + _REFL + _TAG)),
    5: (48, 2, _points(*_ANGLES, returns=2, fields=[("depth", "<u4")] + _REFL + _TAG)),
    7: (30, 3, _points(returns=3, fields=_XYZ + _REFL + _TAG)),
    8: (30, 3, _points(*_ANGLES, returns=3, fields=[("depth", "<u4")] + _REFL + _TAG)),
}

SCHEMAS = {
    "points": "recording string, frame_index bigint, frame_time_s double, idx int, x double, y double, z double, reflectivity int, tag int, line int, offset_ns bigint, data_type int",
    "imu": "recording string, frame_index bigint, ts_s double, ax double, ay double, az double, gx double, gy double, gz double",
    "frames": "recording string, frame_index bigint, n_points bigint, n_imu bigint, unsupported bigint, truncated bigint",
    "devices": "recording string, code string, hub string, device_index int, device_type int, extrinsic int, roll double, pitch double, yaw double, x double, y double, z double",
}


@dataclass
class Frame:
    points: list[np.ndarray]
    samples: list[tuple]
    time_s: float = 0.0
    unsupported: int = 0
    truncated: int = 0


def decode_points(data_type: int, payload: memoryview, packet_ns: int, frame_ns: int) -> np.ndarray:
    """Rows x, y, z, reflectivity, tag, offset_ns; returns of one raw point follow each other."""
    count, returns, layout = LAYOUTS[data_type]
    raw = np.frombuffer(payload, layout, count)
    interval = INTERVAL_NS.get(data_type, OTHER_INTERVAL_NS)
    offset = np.clip(packet_ns + np.arange(count, dtype=np.int64) * interval - frame_ns, 0, U32)
    out = np.empty((count, returns, 6))
    if "theta" in layout.names:
        theta, phi = np.radians(raw["theta"] / 100.0), np.radians(raw["phi"] / 100.0)
    for i in range(returns):
        if "theta" in layout.names:
            depth = raw[f"depth{i}"] / 1000.0
            out[:, i, 0], out[:, i, 1], out[:, i, 2] = depth * np.sin(theta) * np.cos(phi), depth * np.sin(theta) * np.sin(phi), depth * np.cos(theta)
        else:
            for k, c in enumerate("xyz"):
                out[:, i, k] = raw[f"{c}{i}"] / 1000.0
        out[:, i, 3] = raw[f"refl{i}"]
        out[:, i, 4] = raw[f"tag{i}"] if f"tag{i}" in layout.names else 0
        out[:, i, 5] = offset
    return out.reshape(-1, 6)


def decode_frame(data: bytes, base_ns: int) -> Frame:
    """All packets of a frame. A bad packet ends it."""
    frame, at, frame_ns, view = Frame([], []), 0, None, memoryview(data)
    while at + PACKET <= len(data):
        data_type, ts_ns = data[at + 10], int.from_bytes(data[at + 11 : at + 19], "little")
        if data_type == SAMPLE:
            size = 24
        elif data_type in LAYOUTS:
            size = LAYOUTS[data_type][0] * LAYOUTS[data_type][2].itemsize
        else:
            frame.unsupported += 1
            break
        if at + PACKET + size > len(data):
            frame.truncated += 1
            break
        payload = view[at + PACKET : at + PACKET + size]
        if data_type == SAMPLE:
            g, a = struct.unpack("<3f", payload[:12]), struct.unpack("<3f", payload[12:])
            frame.samples.append(((ts_ns - base_ns) / 1e9, *a, *g))
        else:
            if frame_ns is None:
                frame_ns, frame.time_s = ts_ns, (ts_ns - base_ns) / 1e9
            rows = decode_points(data_type, payload, ts_ns, frame_ns)
            frame.points.append(np.column_stack([rows, np.full(len(rows), data_type)]))
        at += PACKET + size
    return frame


def _opened(uri: str):
    """A file system and path of a URI or a plain path."""
    import pyarrow.fs as pafs

    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def listed(path: str, suffix: str) -> list[str]:
    """The file, or the folder's files with the suffix, by name."""
    import pyarrow.fs as pafs

    store, at = _opened(path)
    if store.get_file_info(at).type == pafs.FileType.File:
        return [path]
    found = store.get_file_info(pafs.FileSelector(at, recursive=True))
    head = path[: len(path) - len(at)] if path.endswith(at) else "file://"
    return sorted(head + f.path for f in found if f.is_file and f.path.endswith(suffix))


def frame_index(path: str, place: int = 0, number: int = 0) -> tuple[list[tuple[int, int, int, int]], int, bytes]:
    """Frames (number, data start, data end, time of its first packet), the file's first packet's time, and the device
    blocks. With the ``place`` where a frame begins and its ``number`` only what comes from there on."""
    store, at = _opened(path)
    with store.open_input_file(at) as f:
        size = f.size()
        head = f.read(HEADER.size)
        if len(head) < HEADER.size or HEADER.unpack(head)[2] != MAGIC:
            raise ValueError(f"{path} is no lvx recording")
        devices = f.read(DEVICE.itemsize * HEADER.unpack(head)[4])
        first = HEADER.size + len(devices)
        place, frames, base = place or first, [], 0
        if size >= first + FRAME.size + PACKET:
            f.seek(first + FRAME.size)
            base = int.from_bytes(f.read(PACKET)[11:19], "little")
        while place and place + FRAME.size <= size:
            f.seek(place)
            both = f.read(FRAME.size + PACKET)
            now, after, _ = FRAME.unpack(both[: FRAME.size])
            if now != place or after < now + FRAME.size or after > size or not 0 < after - now - FRAME.size <= MOST_FRAME:
                break
            frames.append((number + len(frames), now + FRAME.size, after, int.from_bytes(both[FRAME.size + 11 : FRAME.size + 19], "little")))
            place = after
    return frames, base, devices


@dataclass
class Range(InputPartition):
    path: str
    frames: list
    base_ns: int
    devices: bytes

    def __post_init__(self):
        super().__init__(None)


class LvxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.each = options["path"], options.get("kind", "points"), int(options.get("framesperpartition", options.get("framesPerPartition", 2000)))
        self.recordings: set | None = None
        self.low, self.high, self.from_s, self.to_s = 0, 1 << 62, float("-inf"), float("inf")

    def _wanted(self, frames: list, base: int) -> list:
        """Frames that may hold wanted rows; a frame's own time is that of its first packet of points, at or after its first."""
        return [f for i, f in enumerate(frames) if self.low <= f[0] <= self.high and (f[3] - base) / 1e9 <= self.to_s + 1e-6 and (i + 1 == len(frames) or (frames[i + 1][3] - base) / 1e9 >= self.from_s - 1e-6 or frames[i + 1][3] < f[3])]

    def partitions(self) -> list[Range]:
        out = []
        for path in listed(self.path, ".lvx"):
            if self.recordings is not None and path not in self.recordings:
                continue
            frames, base, devices = frame_index(path)
            frames = self._wanted(frames, base)
            if self.kind == "devices":
                out.append(Range(path, [], base, devices))
            else:
                out += [Range(path, frames[i : i + self.each], base, b"") for i in range(0, len(frames), self.each)]
        return out or [Range("", [], 0, b"")]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMAS[self.kind].split(", ")]
        if self.kind == "devices":
            rows = np.frombuffer(part.devices, DEVICE)
            yield from ((part.path, r["code"].decode("latin-1"), r["hub"].decode("latin-1"), *(int(r[k]) for k in ("index", "type", "extrinsic")), *(float(r[k]) for k in ("roll", "pitch", "yaw", "x", "y", "z"))) for r in rows)
            return
        if not part.frames:
            return
        store, at = _opened(part.path)
        with store.open_input_file(at) as f:
            for number, start, end, _ in part.frames:
                f.seek(start)
                frame = decode_frame(f.read(end - start), part.base_ns)
                if self.kind == "frames":
                    yield part.path, number, sum(map(len, frame.points)), len(frame.samples), frame.unsupported, frame.truncated
                elif self.kind == "imu":
                    yield from ((part.path, number, *s) for s in frame.samples)
                elif frame.points:
                    p = np.concatenate(frame.points)
                    n = len(p)
                    columns = [pa.array([part.path] * n), pa.array(np.full(n, number)), pa.array(np.full(n, frame.time_s)), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(p[:, k]) for k in range(3))]
                    columns += [pa.array(p[:, 3].astype(np.int32)), pa.array(p[:, 4].astype(np.int32)), pa.array(np.zeros(n, dtype=np.int32)), pa.array(p[:, 5].astype(np.int64)), pa.array(p[:, 6].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)


class FilteringLvxReader(LvxReader):
    """Filters on recording, frame_index and time that Spark pushes down leave out files and frames before they are read.
    Spark wants ``spark.sql.python.filterPushdown.enabled`` for that; option ``pushdown`` asks for this reader."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows what is read; all filters stay with Spark as well, since a frame's rows may differ."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name == "recording" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.recordings = wanted if self.recordings is None else self.recordings & wanted
            elif name == "frame_index" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value)
            elif name == "frame_time_s" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.from_s = max(self.from_s, f.value)
            if name == "frame_index" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value)
            elif name == "frame_time_s" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.to_s = min(self.to_s, f.value)
            yield f


class LvxStream(DataSourceStreamReader):
    """Recordings as a stream: files that come, and frames that are added to a file while it is written. An offset is, of each
    file, how many whole frames it had and where the next one begins, so a restarted query goes on with the very next frame.
    A frame that isn't whole yet waits. The folder should hold the recordings of a bounded time, since offsets name each file."""

    def __init__(self, options: dict):
        self.files, self.path, self.seen = LvxReader(options), options["path"], {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        for path in listed(self.path, ".lvx"):
            n, place = self.seen.get(path, (0, 0))
            try:
                frames = frame_index(path, place, n)[0]
            except ValueError:  # not even its header is there yet
                continue
            if frames:
                self.seen[path] = (n + len(frames), frames[-1][2])
        return {"files": {p: list(at) for p, at in sorted(self.seen.items())}}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, (n, place) in end["files"].items():
            held, begin = start["files"].get(path, (0, 0))
            if n > held:
                frames, base, _ = frame_index(path, begin, held)
                frames = [f for f in frames if f[0] < n and f[2] <= place]
                out += [Range(path, frames[i : i + self.files.each], base, b"") for i in range(0, len(frames), self.files.each)]
        return out

    def read(self, part: Range) -> Iterator:
        yield from self.files.read(part)

    def commit(self, end: dict) -> None:
        pass


class LvxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lvx"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "points")]

    def reader(self, schema) -> LvxReader:
        return (FilteringLvxReader if self.options.get("pushdown", "false") == "true" else LvxReader)(dict(self.options))

    def streamReader(self, schema) -> LvxStream:
        return LvxStream(dict(self.options))
