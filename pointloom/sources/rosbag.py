"""The ``rosbag1`` data source: bag files (version 2.0) as messages, connections or chunks; and message decoding.

The driver reads a file's index section only (connections and chunk records); each task reads one chunk. Chunks that
end before ``startNs`` or start after ``endNs`` are not read at all. ``none`` and ``bz2`` are decompressed; ``lz4`` needs the
lz4 module and says so otherwise.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pointloom.sources.lvx import _opened, listed

#: Record kinds (fixed values of the format).
MESSAGE, FILE_HEADER, INDEX, CHUNK, CHUNK_INFO, CONNECTION = 0x02, 0x03, 0x04, 0x05, 0x06, 0x07
VERSION = b"#ROSBAG V2.0"

SCHEMAS = {
    "messages": "recording string, conn_id bigint, topic string, type string, time_ns bigint, data binary",
    "connections": "recording string, conn_id bigint, topic string, type string, md5sum string",
    "chunks": "recording string, chunk_pos bigint, start_ns bigint, end_ns bigint, messages bigint, connections bigint",
}


def fields(block: bytes) -> dict[str, bytes]:
    """name=value fields of a record header; a field that runs over the end ends it."""
    out, at = {}, 0
    while at + 4 <= len(block):
        (n,) = struct.unpack_from("<I", block, at)
        part = block[at + 4 : at + 4 + n]
        name, sign, value = part.partition(b"=")
        if len(part) < n or not sign:
            break
        out[name.decode("latin-1")] = value
        at += 4 + n
    return out


def number(value: bytes, default: int = 0) -> int:
    return int.from_bytes(value, "little") if value else default


def time_ns(value: bytes) -> int:
    return struct.unpack("<I", value[:4])[0] * 1_000_000_000 + struct.unpack("<I", value[4:8])[0] if len(value) >= 8 else 0


def records(data: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """Records one after the other; a cut one ends them."""
    at = 0
    while at + 8 <= len(data):
        (n,) = struct.unpack_from("<I", data, at)
        if at + 8 + n > len(data):
            return
        head = fields(data[at + 4 : at + 4 + n])
        (size,) = struct.unpack_from("<I", data, at + 4 + n)
        start = at + 8 + n
        if start + size > len(data):
            return
        yield head, data[start : start + size]
        at = start + size


def decompressed(data: bytes, how: str, size: int) -> bytes:
    if how in ("", "none"):
        return data
    if how == "bz2":
        import bz2

        return bz2.decompress(data)
    if how == "lz4":
        try:
            import lz4.block
        except ImportError as e:
            raise RuntimeError("chunks with lz4 need the lz4 module") from e
        return lz4.block.decompress(data, uncompressed_size=size)
    raise ValueError(f"unknown chunk compression {how!r}")


def _connection(head: dict, data: bytes) -> tuple[int, tuple[str, str, str]]:
    own = fields(data)
    text = lambda k: own.get(k, head.get(k, b"")).decode("utf-8", "replace")
    return number(head.get("conn", b"")), (head.get("topic", own.get("topic", b"")).decode("utf-8", "replace"), text("type"), text("md5sum"))


@dataclass
class Chunk(InputPartition):
    path: str
    position: int
    start_ns: int
    end_ns: int
    counts: dict
    connections: dict

    def __post_init__(self):
        super().__init__(None)


def index(path: str) -> tuple[dict, list[Chunk]]:
    """Connections and chunks (by position) from a file's index section."""
    store, at = _opened(path)
    with store.open_input_file(at) as f:
        line = f.read(64).split(b"\n")[0]
        if VERSION not in line:
            raise ValueError(f"{path} is no bag of version 2.0")
        f.seek(len(line) + 1)
        (n,) = struct.unpack("<I", f.read(4))
        place = number(fields(f.read(n)).get("index_pos", b""))
        f.seek(place)
        section = f.read()
    connections, chunks = {}, []
    for head, data in records(section):
        kind = number(head.get("op", b""))
        if kind == CONNECTION:
            conn, about = _connection(head, data)
            connections[conn] = about
        elif kind == CHUNK_INFO:
            pairs = np.frombuffer(data, "<u4").reshape(-1, 2) if len(data) % 8 == 0 else np.empty((0, 2), "<u4")
            chunks.append(Chunk(path, number(head.get("chunk_pos", b"")), time_ns(head.get("start_time", b"")), time_ns(head.get("end_time", b"")), {int(c): int(k) for c, k in pairs}, {}))
    for c in chunks:
        c.connections = connections
    return connections, sorted(chunks, key=lambda c: c.position)


class BagReader(DataSourceReader):
    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.kind = low["path"], low.get("kind", "messages")
        self.start, self.end = int(low.get("startns", 0)), int(low.get("endns", 1 << 62))

    def partitions(self) -> list[Chunk]:
        out = []
        for path in listed(self.path, ".bag"):
            connections, chunks = index(path)
            if self.kind == "connections":
                out.append(Chunk(path, -1, 0, 0, {}, connections))
            else:
                out += [c for c in chunks if c.end_ns >= self.start and c.start_ns <= self.end]
        return out or [Chunk("", -1, 0, 0, {}, {})]

    def read(self, chunk: Chunk) -> Iterator[tuple]:
        if not chunk.path:
            return
        if self.kind == "connections":
            yield from ((chunk.path, c, *about) for c, about in sorted(chunk.connections.items()))
        elif self.kind == "chunks":
            yield chunk.path, chunk.position, chunk.start_ns, chunk.end_ns, sum(chunk.counts.values()), len(chunk.counts)
        else:
            store, at = _opened(chunk.path)
            with store.open_input_file(at) as f:
                f.seek(chunk.position)
                (n,) = struct.unpack("<I", f.read(4))
                head = fields(f.read(n))
                (size,) = struct.unpack("<I", f.read(4))
                data = decompressed(f.read(size), head.get("compression", b"none").decode(), number(head.get("size", b""), size))
            known = dict(chunk.connections)
            for head, body in records(data):
                kind = number(head.get("op", b""))
                if kind == CONNECTION:
                    conn, about = _connection(head, body)
                    known[conn] = about
                elif kind == MESSAGE:
                    conn, t = number(head.get("conn", b"")), time_ns(head.get("time", b""))
                    if self.start <= t <= self.end:
                        topic, message_type, _ = known.get(conn, ("", "", ""))
                        yield chunk.path, conn, topic, message_type, t, bytes(body)


class BagSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rosbag1"

    def schema(self) -> str:
        return SCHEMAS[{k.lower(): v for k, v in dict(self.options).items()}.get("kind", "messages")]

    def reader(self, schema) -> BagReader:
        return BagReader(dict(self.options))


# -- message bodies

POINT = np.dtype([("offset_ns", "<u4"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("reflectivity", "u1"), ("tag", "u1"), ("line", "u1")])
POINTS_SCHEMA = "recording string, time_ns bigint, stamp_ns bigint, idx int, offset_ns bigint, x double, y double, z double, reflectivity int, tag int, line int, error string"
IMU_SCHEMA = "recording string, time_ns bigint, stamp_ns bigint, ax double, ay double, az double, gx double, gy double, gz double, qx double, qy double, qz double, qw double, error string"


def _header(data: bytes) -> tuple[int, int]:
    """Stamp and where the body starts."""
    _, sec, nsec, n = struct.unpack_from("<IIII", data, 0)
    return sec * 1_000_000_000 + nsec, 16 + n


def decode_cloud(data: bytes) -> tuple[int, np.ndarray]:
    try:
        stamp, at = _header(data)
        _, count, _, _, _, _, n = struct.unpack_from("<QIBBBBI", data, at)
    except struct.error as e:
        raise ValueError("truncated point message") from e
    at += 20
    if n != count or n > (len(data) - at) // POINT.itemsize:
        raise ValueError("invalid point array")
    return stamp, np.frombuffer(data, POINT, n, at)


def decode_imu(data: bytes) -> tuple[int, tuple]:
    try:
        stamp, at = _header(data)
        v = struct.unpack_from("<37d", data, at)
    except struct.error as e:
        raise ValueError("truncated inertial message") from e
    return stamp, (*v[25:28], *v[13:16], *v[0:4])


def decoded_clouds(messages: DataFrame) -> DataFrame:
    """Points of messages(recording, time_ns, data); a message that can't be read is one row with ``error``."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in POINTS_SCHEMA.split(", ")]
        for pdf in parts:
            for recording, t, data in pdf[["recording", "time_ns", "data"]].itertuples(index=False):
                try:
                    stamp, points = decode_cloud(bytes(data))
                except ValueError as e:
                    yield pd.DataFrame([(recording, t, None, None, None, None, None, None, None, None, None, str(e))], columns=names)
                    continue
                out = pd.DataFrame({c: points[c].astype(k) for c, k in (("offset_ns", "int64"), ("x", "float64"), ("y", "float64"), ("z", "float64"), ("reflectivity", "int32"), ("tag", "int32"), ("line", "int32"))})
                yield out.assign(recording=recording, time_ns=t, stamp_ns=stamp, idx=np.arange(len(points), dtype=np.int32), error=None)[names]

    return messages.select("recording", "time_ns", "data").mapInPandas(scan, POINTS_SCHEMA)


def decoded_imu(messages: DataFrame) -> DataFrame:
    """Samples of messages(recording, time_ns, data); what can't be read is one row with ``error``."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in IMU_SCHEMA.split(", ")]
        for pdf in parts:
            rows = []
            for recording, t, data in pdf[["recording", "time_ns", "data"]].itertuples(index=False):
                try:
                    stamp, v = decode_imu(bytes(data))
                    rows.append((recording, t, stamp, *v, None))
                except ValueError as e:
                    rows.append((recording, t, None, *[None] * 10, str(e)))
            yield pd.DataFrame(rows, columns=names)

    return messages.select("recording", "time_ns", "data").mapInPandas(scan, IMU_SCHEMA)
