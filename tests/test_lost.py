"""Lost chunk tables found again by many tasks, and chunks coded side by side."""

import struct

import numpy as np
import pytest

from cloudloom.plans import formats
from cloudloom.sources.las import container as C
from cloudloom.sources.las.datasource import find_chunks, read_las
from cloudloom.sources.las.file import LasFile, Layout, write_las
from cloudloom.sources.las.formats import items_of
from cloudloom.sources.las.lost import found_starts

CHUNK, CHUNKS = 20, 150


def _points(n: int, seed: int = 1, wild: bool = False) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    of = r.integers
    cols = {"intensity": of(0, 65536, n), "return_number": of(0, 8, n), "number_of_returns": of(0, 8, n), "scan_direction_flag": of(0, 2, n), "classification": of(0, 32, n)}
    cols |= {"scan_angle_rank": of(-128, 128, n), "user_data": of(0, 256, n), "point_source_ID": of(0, 65536, n)}
    if wild:
        return cols | {a: of(-(2**31), 2**31, n) for a in "XYZ"} | {"gps_time": of(-(2**63), 2**63 - 1, n).view(np.float64)}
    # steps that are kept, multiplied, reversed, and jumps between four sequences
    step = r.choice([0, 1, 1, 1, 2, 5, 20, 100, 600, -1, -3, -11, -50, 10**6, 2**31 - 1], n) * 1000 + of(-3, 3, n)
    time = np.cumsum(step) + (of(0, 5, n) << 40) * (r.random(n) < 0.3)
    return cols | {a: np.cumsum(of(-20, 21, n)) for a in "XYZ"} | {"gps_time": time.view(np.float64), "user_data": of(0, 2, n)}


def _lose(path: str) -> None:
    with open(path, "r+b") as f:
        f.seek(96)
        start = struct.unpack("<I", f.read(4))[0]
        f.seek(start)
        end = struct.unpack("<q", f.read(8))[0]
        f.seek(start)
        f.write(struct.pack("<q", start))
        f.truncate(end)


@pytest.fixture
def lost(tmp_path):
    path = str(tmp_path / "a.laz")
    cols = _points(CHUNK * CHUNKS + 7)
    write_las(path, [cols], Layout(1, chunk_size=CHUNK))
    with LasFile(path) as f:
        starts = f.table.starts[:-1]
    _lose(path)
    return path, cols, starts


@pytest.mark.parametrize("wild", [False, True])
@pytest.mark.parametrize("size", [2, 90])
def test_side_by_side_is_one_by_one(wild, size):
    items, n = items_of(1, 28, 2), 70
    cols = _points(n * size, size, wild)
    values = C.item_values(cols, items, n * size)
    one = [C.encode_chunk([v[k * size : (k + 1) * size] for v in values], items, False) for k in range(n)]
    many = C.encode_chunks([np.array(v, np.int64).reshape(n, size, -1) for v in values], items)
    assert many == one
    ends = np.cumsum([len(b) for b in one]).tolist()
    got = C.decode_chunks(b"".join(one), [0, *ends[:-1]], ends, size, items)
    for k in (0, n - 1):
        want, _ = C.decode_chunk(one[k], 0, len(one[k]), size, items, False)
        for c, v in want.items():
            assert np.array_equal(got[c][k * size : (k + 1) * size].view(np.uint8), np.ascontiguousarray(v).view(np.uint8)), c


def test_damaged_lane_is_marked():
    items, n, size = items_of(1, 28, 2), 70, 50
    values = [np.array(v, np.int64).reshape(n, size, -1) for v in C.item_values(_points(n * size, 4), items, n * size)]
    one = C.encode_chunks(values, items)
    ends = np.cumsum([len(b) for b in one]).tolist()
    assert C.decode_chunks(b"".join(one), [0, *ends[:-1]], [e - 5 * (k == 3) for k, e in enumerate(ends)], size, items) is None
    # any bytes are decoded or marked, never an error of another kind
    noise = np.random.default_rng(5).integers(0, 256, 40_000).astype(np.uint8).tobytes() + b"\xff" * 5000
    C.chunk_ends(noise, list(range(0, 44_000, 60)), size, items, False)


def test_found_chunks_are_those_of_the_table(spark, lost):
    path, cols, starts = lost
    folder = find_chunks(spark, path, share=4000)
    assert found_starts(folder, path) == starts
    df = read_las(spark, path, ["point_index", "X", "gps_time"], chunkTables=folder, groupBytes=1, splitBytes=10_000)
    assert df.rdd.getNumPartitions() > 1
    got = df.orderBy("point_index").collect()
    assert [r.X for r in got] == cols["X"].tolist()
    # every task has some, where one had all
    assert df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() > 1


def test_found_chunks_whatever_the_header_says(spark, lost):
    path, _, starts = lost
    for bounds in ((1e9, -1e9), (0.0, 0.0), (-1e9, 1e9)):
        with open(path, "r+b") as f:
            # max and min of each axis
            f.seek(179)
            f.write(struct.pack("<6d", *bounds * 3))
        assert found_starts(find_chunks(spark, path, share=20_000), path) == starts


def test_damaged_file_is_read_in_order(spark, lost):
    path, cols, starts = lost
    cut = starts[100] + 3
    with open(path, "r+b") as f:
        f.truncate(cut)
    folder = find_chunks(spark, path)
    assert found_starts(folder, path) is None
    with LasFile(path) as f:
        assert f.columns("X", count=99 * CHUNK)["X"].tolist() == cols["X"][: 99 * CHUNK].tolist()


def test_chunks_of_a_fixed_size_from_many_tasks(spark):
    # ordinals with gaps: chunks are cut by rank
    df = spark.range(0, 3000, 3).selectExpr("id + 100000 * int(id / 1000) AS point_index", "int(id) AS X", "int(0) AS Y", "int(0) AS Z").repartition(5)
    path = formats._chunked(df, 7, pointFormat="0")
    with LasFile(f"{path}/points.laz") as f:
        assert f.header.chunk_size == 7 and f.columns("X")["X"].tolist() == list(range(0, 3000, 3))
