"""Recordings written byte by byte, read through the data sources."""

import bz2
import struct

import pytest

from pointloom.operators import matching
from pointloom.sources import feeds, lvx, rosbag


def packet(kind, ts_ns, payload):
    return bytes([0] * 10) + bytes([kind]) + struct.pack("<Q", ts_ns) + payload


def cartesian(kind, first, each=None):
    count, returns, layout = lvx.LAYOUTS[kind]
    rows = [first] + [each or first] * (count - 1)
    out = b""
    for row in rows:
        for x, y, z, refl, tag in row:
            out += struct.pack("<iiiB", x, y, z, refl) + (bytes([tag]) if kind else b"")
    assert len(out) == count * layout.itemsize
    return out


def recording(frames, devices=b""):
    body = lvx.HEADER.pack(b"signature", bytes([1, 1, 0, 0]), lvx.MAGIC, 50, len(devices) // 59) + devices
    for i, data in enumerate(frames):
        start = len(body)
        body += lvx.FRAME.pack(start, start + lvx.FRAME.size + len(data), i) + data
    return body


@pytest.fixture(scope="module")
def lvx_folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("lvx")
    one = packet(0, 1_000_000_000, cartesian(0, [(1000, -2000, 3000, 42, 0)])) + packet(2, 1_001_000_000, cartesian(2, [(-4000, 0, 0, 9, 7)]))
    two = packet(4, 1_002_000_000, cartesian(4, [(7000, 0, 0, 1, 0), (0, 8000, 0, 2, 1)])) + packet(7, 1_003_000_000, cartesian(7, [(0, 0, 9000, 1, 0), (10000, 0, 0, 2, 0), (0, 11000, 0, 3, 0)]))
    imu = packet(1, 5_000_000_000, b"".join(struct.pack("<IHHB", 1000, 9000, 0, 5) for _ in range(100))) + packet(6, 5_002_000_000, struct.pack("<6f", 0.1, 0.2, 0.3, 1.1, 1.2, 1.3))
    device = struct.pack("<16s16sBBB6f", b"ABC", b"", 3, 1, 1, 0.1, 0.2, 0.3, 1.0, 2.0, 3.0)
    (top / "a.lvx").write_bytes(recording([one + two], device))
    (top / "b.lvx").write_bytes(recording([imu, packet(99, 1, b""), packet(0, 6_000_000_000, b"x"), b""]))
    return str(top)


def read(spark, path, kind):
    spark.dataSource.register(lvx.LvxSource)
    return spark.read.format("lvx").option("kind", kind).option("framesPerPartition", 1).load(path)


def test_lvx_points(spark, lvx_folder):
    p = read(spark, lvx_folder, "points").where("recording LIKE '%a.lvx'").orderBy("idx").toPandas()
    assert len(p) == 100 + 96 + 96 + 90
    assert (p.x[0], p.y[0], p.z[0], p.reflectivity[0], p.tag[0]) == (1, -2, 3, 42, 0)
    assert (p.x[100], p.tag[100], p.x[196], p.y[197], p.z[292], p.x[293], p.y[294]) == (-4, 7, 7, 8, 9, 10, 11)
    assert p.offset_ns.is_monotonic_increasing and p.offset_ns[1] == 10_000 and p.offset_ns[101] == 1_000_000 + 4166 and (p.line == 0).all()


def test_lvx_samples_frames_devices(spark, lvx_folder):
    s = read(spark, lvx_folder, "imu").collect()
    assert len(s) == 1 and round(s[0].ts_s, 9) == 0.002 and [round(v, 6) for v in (s[0].gx, s[0].ax)] == [0.1, 1.1]
    f = read(spark, lvx_folder, "frames").where("recording LIKE '%b.lvx'").orderBy("frame_index").collect()
    assert [(r.n_points, r.n_imu, r.unsupported, r.truncated) for r in f] == [(100, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)]
    d = read(spark, lvx_folder, "devices").collect()
    assert len(d) == 1 and (d[0].code, d[0].device_index, round(d[0].yaw, 6)) == ("ABC", 3, 0.3)
    b = read(spark, lvx_folder, "points").where("recording LIKE '%b.lvx'").first()
    assert (round(b.x, 9), round(b.z, 9)) == (1.0, 0.0)


def test_lvx_rejects_other_files(spark, tmp_path):
    (tmp_path / "c.lvx").write_bytes(b"nothing of the kind, but long enough to hold a header")
    with pytest.raises(Exception, match="no lvx recording"):
        read(spark, str(tmp_path), "points").collect()


def field_block(**fields):
    out = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in fields.items())
    return struct.pack("<I", len(out)) + out


def record(data, **fields):
    return field_block(**fields) + struct.pack("<I", len(data)) + data


def stamp(ns):
    return struct.pack("<II", ns // 10**9, ns % 10**9)


def bag(chunks):
    """chunks: (compression, [(conn, topic, time_ns, data)])"""
    top = b"#ROSBAG V2.0\n"
    size = len(record(b"", op=b"\x03", index_pos=bytes(8), conn_count=bytes(4), chunk_count=bytes(4)))
    body, index, seen = b"", b"", {}
    for how, messages in chunks:
        inner = b""
        for conn, topic, _, _ in messages:
            about = record(b"".join(struct.pack("<I", len(x)) + x for x in (b"type=std_msgs/UInt8", b"md5sum=abc", b"topic=" + topic)), op=b"\x07", conn=struct.pack("<I", conn), topic=topic)
            inner, seen[conn] = inner + about, about
        for conn, _, t, data in messages:
            inner += record(data, op=b"\x02", conn=struct.pack("<I", conn), time=stamp(t))
        packed = bz2.compress(inner) if how == b"bz2" else inner
        at = len(top) + size + len(body)
        body += record(packed, op=b"\x05", compression=how, size=struct.pack("<I", len(inner)))
        times = [m[2] for m in messages]
        pairs = b"".join(struct.pack("<II", c, sum(m[0] == c for m in messages)) for c in {m[0] for m in messages})
        index += record(pairs, op=b"\x06", ver=struct.pack("<I", 1), chunk_pos=struct.pack("<Q", at), start_time=stamp(min(times)), end_time=stamp(max(times)), count=struct.pack("<I", len(pairs) // 8))
    head = record(b"", op=b"\x03", index_pos=struct.pack("<Q", len(top) + size + len(body)), conn_count=struct.pack("<I", len(seen)), chunk_count=struct.pack("<I", len(chunks)))
    return top + head + body + b"".join(seen.values()) + index


def ros_header(ns, frame=b"f"):
    return struct.pack("<I", 7) + stamp(ns) + struct.pack("<I", len(frame)) + frame


def test_bag(spark, tmp_path):
    point = struct.pack("<IfffBBB", 9, 1.0, 2.0, 3.0, 4, 5, 6)
    good = ros_header(3_000_000_001) + struct.pack("<QIBBBBI", 1, 1, 0, 0, 0, 0, 1) + point
    bad = ros_header(4_000_000_000) + struct.pack("<QIBBBBI", 1, 2**32 - 1, 0, 0, 0, 0, 2**32 - 1)
    imu = ros_header(5_000_000_000) + struct.pack("<37d", 0, 0, 0, 1, *[0] * 9, 0.1, 0.2, 0.3, *[0] * 9, 1.0, 2.0, 3.0, *[0] * 9)
    (tmp_path / "r.bag").write_bytes(bag([(b"none", [(0, b"/raw", 123, b"\x2a")]), (b"bz2", [(1, b"/cloud", 10**9, good), (1, b"/cloud", 2 * 10**9, bad), (2, b"/imu", 3 * 10**9, imu)])]))
    spark.dataSource.register(rosbag.BagSource)
    load = lambda **o: spark.read.format("rosbag1").options(**o).load(str(tmp_path))
    m = load().orderBy("time_ns").collect()
    assert [(r.topic, r.time_ns) for r in m] == [("/raw", 123), ("/cloud", 10**9), ("/cloud", 2 * 10**9), ("/imu", 3 * 10**9)] and bytes(m[0].data) == b"\x2a"
    assert [(r.messages, r.connections) for r in load(kind="chunks").orderBy("chunk_pos").collect()] == [(1, 1), (3, 2)]
    assert load(kind="connections").count() == 3
    assert load(startNs=10**9).count() == 3 and load(startNs=10**9).rdd.getNumPartitions() == 1
    clouds = rosbag.decoded_clouds(load().where("topic = '/cloud'")).orderBy("time_ns").collect()
    assert (clouds[0].x, clouds[0].line, clouds[0].stamp_ns, clouds[0].error) == (1.0, 6, 3_000_000_001, None)
    assert clouds[1].error == "invalid point array"
    samples = rosbag.decoded_imu(load().where("topic <> '/cloud'")).orderBy("time_ns").collect()
    assert samples[0].error == "truncated inertial message" and (samples[1].gx, samples[1].az, samples[1].qw) == (0.1, 3.0, 1.0)


def test_unknown_compression():
    with pytest.raises(ValueError):
        rosbag.decompressed(b"", "zip", 0)
    assert rosbag.decompressed(b"ab", "none", 2) == b"ab"


def test_imu_json_round_trip(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1_500_000, 1.0, 2.0, 3.0)], "t long, x double, y double, z double")
    back = df.select(feeds.parsed_imu(feeds.imu_json(F.col("t"), "imu", ("x", "y", "z"), ("x", "y", "z"))).alias("m")).first().m
    assert (back.timestamp.sec, back.timestamp.nsec, back.frame_id, back.linear_acceleration.z) == (1, 500_000_000, "imu", 3.0)


def test_planes_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows, want = [], {}

    def put(q, p):
        rows.append((q, [tuple(map(float, v)) for v in p]))
        n, *_ = np.linalg.lstsq(p, -np.ones(len(p)), rcond=None)
        size = np.linalg.norm(n)
        want[q] = (*(n / size), 1 / size)

    for q in range(20):
        put(q, rng.normal(0, 1, (5, 3)) * [1, 1, 0.02] + [0, 0, 3])
    for q in range(20, 30):  # thin: far from the origin, close together; plane nearly through the origin
        put(q, rng.normal(0, 1, (5, 3)) * [1e-3, 1e-3, 1e-6] + rng.normal(0, 40, 3))
        put(q + 10, rng.normal(0, 1, (5, 3)) * [1, 1, 1e-7] + [0, 0, 1e-6])
    kind = "query_id long, points array<struct<x: double, y: double, z: double>>"
    found = matching.planes(spark.createDataFrame(rows, kind)).collect()
    assert len(found) == 40
    for r in found:
        assert np.allclose((r.a, r.b, r.c, r.d), want[r.query_id], atol=1e-6 if r.query_id < 20 else 1e-4), r.query_id
    line = [(float(i), 2.0 * i, 0.0) for i in range(1, 6)]
    zero = [(0.0, 0.0, 0.0)] * 5
    through = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (-1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (1.0, 1.0, 0.0)]
    flat = {r.query_id: r for r in matching.planes(spark.createDataFrame([(0, line), (1, zero), (2, through), (3, None), (4, [(1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (1.0, 0.0, 1.0), (1.0, 2.0, 0.0), (1.0, 0.0, 2.0)])], kind)).collect()}
    assert not flat[0].accepted and not flat[1].accepted and not flat[2].accepted and not flat[3].accepted and flat[3].worst is None
    assert flat[4].accepted and np.allclose((flat[4].a, flat[4].b, flat[4].c, flat[4].d), (-1, 0, 0, 1))


def test_pivoted_steps_against_least_squares():
    import numpy as np

    rng = np.random.default_rng(6)
    a = np.concatenate([rng.normal(0, 1, (200, 5, 3)) * 10.0 ** rng.integers(-6, 7, (200, 1, 3)), rng.normal(0, 1, (50, 5, 3)) + 1e4])
    b = rng.normal(0, 1, (250, 5))
    x = matching.pivoted(a, b)
    for m, y, got in zip(a, b, x, strict=True):
        want, *_ = np.linalg.lstsq(m, y, rcond=None)
        assert np.linalg.norm(m @ got - y) <= np.linalg.norm(m @ want - y) * (1 + 1e-9) + 1e-12
    a[:, :, 2] = a[:, :, 0]  # dependent columns: one unknown is 0, the rest as good as can be
    x = matching.pivoted(a, b)
    assert ((x == 0).sum(axis=1) >= 1).all()
    for m, y, got in zip(a, b, x, strict=True):
        want, *_ = np.linalg.lstsq(m, y, rcond=None)
        assert np.linalg.norm(m @ got - y) <= np.linalg.norm(m @ want - y) * (1 + 1e-9) + 1e-9


def test_gauss_newton_against_numpy(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from pointloom.functions import geometry as g

    rng = np.random.default_rng(7)
    n, p, r = rng.normal(0, 1, (30, 3)), rng.normal(0, 2, (30, 3)), rng.normal(0, 0.1, 30)
    df = spark.createDataFrame([(0, *map(float, (*a, *b, c))) for a, b, c in zip(n, p, r, strict=True)], "frame_id long, a double, b double, c double, qx double, qy double, qz double, residual double")
    rows = matching.jacobian([F.col(k) for k in "abc"], [F.col(f"q{k}") for k in "xyz"], g.identity())
    got = matching.solved(matching.normal_equations(df, rows)).first()
    h = np.hstack([n, np.cross(p, n)])
    assert np.allclose([got[f"d_{i}"] for i in range(6)], np.linalg.solve(h.T @ h + 1e-6 * np.eye(6), -h.T @ r), atol=1e-8)


def test_written_recordings_come_back_and_filters_leave_out_frames(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    from pointloom.sources import recordings

    rng = random.Random(1)
    rows = [(f"r{k}", f, f * 50_000_000 + 7, i, rng.randint(-9999, 9999), rng.randint(-9999, 9999), 5, rng.randint(0, 255), rng.randint(0, 60)) for k, n in (("a", 2_500), ("b", 3)) for f in range(n) for i in range(1 + (f == 1) * 99)]
    df = spark.createDataFrame(rows, "recording string, frame long, ts_ns long, idx int, x_mm int, y_mm int, z_mm int, reflectivity int, tag int").repartition(4)
    made = recordings.write(df, f"file://{tmp_path}/out")
    assert sorted((r.file, r.frames) for r in made.collect()) == [("ra-000000.lvx", 1000), ("ra-000001.lvx", 1000), ("ra-000002.lvx", 500), ("rb-000000.lvx", 3)]
    index = recordings.index(spark, f"file://{tmp_path}/out")
    assert index.count() == 2_503
    found = recordings.points(index, 5).where(F.col("tag") != recordings.FILLER)
    name = F.regexp_extract("recording", "([^/]+)-(\\d+)[.]lvx$", 1)
    frame = F.regexp_extract("recording", "-(\\d+)[.]lvx$", 1).cast("long") * recordings.FILE_FRAMES + F.col("frame_index")
    got = sorted(tuple(r) for r in found.select(name, frame, "idx", F.round(F.col("x") * 1000).cast("int"), F.round(F.col("y") * 1000).cast("int"), "reflectivity", "tag").collect())
    assert got == sorted((r[0], r[1], r[3], r[4], r[5], r[7], r[8]) for r in rows)
    late = index.where(F.col("recording").endswith("ra-000001.lvx") & (F.col("time_s") >= 49.0) & (F.col("frame_index") < 990))
    assert late.count() == 10 and recordings.points(late, 3).where(F.col("tag") != recordings.FILLER).count() == 10
    # the data source itself: fewer ranges under a filter, same rows
    spark.dataSource.register(lvx.LvxSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    load = lambda: spark.read.format("lvx").option("framesPerPartition", 100).option("pushdown", True).load(f"file://{tmp_path}/out")
    some = load().where((F.col("frame_index") >= 100) & (F.col("frame_index") < 200) & (F.col("tag") != recordings.FILLER))
    assert some.rdd.getNumPartitions() <= 6 < load().rdd.getNumPartitions() and some.count() == 300
    timed = load().where((F.col("frame_time_s") >= 1.0) & (F.col("frame_time_s") <= 1.2) & (F.col("tag") != recordings.FILLER))
    assert timed.rdd.getNumPartitions() <= 4 and timed.count() == 3 * 5
    (one,) = {r.recording for r in load().where("recording LIKE '%rb%'").select("recording").distinct().collect()}
    assert load().where(F.col("recording") == one).rdd.getNumPartitions() == 1
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_wanted_frames_of_odd_clocks():
    reader = lvx.LvxReader({"path": "x"})
    frames = [(0, 0, 0, 10**9), (1, 0, 0, 2 * 10**9), (2, 0, 0, 10**9), (3, 0, 0, 3 * 10**9)]  # a clock that goes back
    reader.from_s = 0.9
    assert [f[0] for f in reader._wanted(frames, 10**9)] == [0, 1, 2, 3]
    reader.from_s = 1.5
    assert [f[0] for f in reader._wanted(frames, 10**9)] == [1, 2, 3]


def test_a_growing_recording_is_a_stream(spark, tmp_path):
    """Stopped and started again in the middle of a file: no frame lost, none twice."""
    import numpy as np

    from pointloom.sources import recordings
    from pointloom.streaming import feeds

    spark.dataSource.register(lvx.LvxSource)
    frames = [recordings.frame_bytes(np.array([[i, 2, 3, 4, 5]] * 3), (i + 1) * 10**9) for i in range(6)]
    whole, other = recording(frames), recording(frames[:2])
    ends = [len(recording(frames[:n])) for n in range(7)]
    (tmp_path / "in").mkdir()

    def step(size, *more):
        (tmp_path / "in" / "a.lvx").write_bytes(whole[:size])
        for name in more:
            (tmp_path / "in" / name).write_bytes(other)
        stream = spark.readStream.format("lvx").option("framesPerPartition", 2).load(f"file://{tmp_path}/in")
        feeds.run_to_end(stream, path=f"file://{tmp_path}/out", state=f"file://{tmp_path}/state")
        found = feeds.results(spark, f"file://{tmp_path}/out", stream.schema).where("tag = 5").collect()
        return sorted((r.recording.rsplit("/", 1)[1], r.frame_index, r.frame_time_s, round(r.x * 1000)) for r in found)

    want = lambda n: [("a.lvx", i, float(i), i) for i in range(n) for _ in range(3)]
    assert step(ends[2] + 40) == want(2)  # the third frame is only begun
    assert step(ends[5]) == want(5)
    assert step(len(whole), "b.lvx") == want(6) + [("b.lvx", i, float(i), i) for i in range(2) for _ in range(3)]


def test_frames_are_sought_in_the_recordings_own_clock(spark, tmp_path):
    """A recording of more than one file: the frames of its later files begin at 0 in their own file's time only."""
    import duckdb

    from pointloom.plans import catalog
    from pointloom.sources import recordings

    frames = recordings.FILE_FRAMES + 8
    rows = [(f * 64 + r, [float((f + k) % 5) for k in range(63)], 1) for f in range(frames) for r in range(4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(catalog.ORACLE_SQL["s5_frame_seek"]).fetchall()
    assert sorted(tuple(r) for r in catalog.QUERIES["s5_frame_seek"](spark, str(tmp_path)).collect()) == sorted(want) and len(want) == 9
