"""Spark data source ``las``: point files as DataFrames, batch, streaming and sink.

    register(spark)
    spark.read.format("las").option("columns", "X,Y,Z,classification").load("/data/*.laz")
    df.write.format("las").option("pointFormat", 6).mode("append").save("/data/out")

Reading: ``path`` is a file, directory, glob or URI. ``columns`` prunes columns, and with them the layers that are decoded;
``scaled`` gives x, y, z in place of X, Y, Z; ``rect`` or ``circle`` selects an area in the tasks, through a file's spatial index where it has one
(the exact test always follows); ``merge`` reads files of different formats into one schema; ``selective`` is the bit mask of layers
for those who want undecoded columns to hold the value of their chunk's first point; ``chunkTables`` is a folder of ``find_chunks``, for files whose chunk table is lost. Small files share a
partition, large ones are split by runs of chunks or records, so no task holds more than ``splitPoints`` points at once.

Writing: each task writes files of its own, or, with ``single``, the chunks of one file that the driver puts in order of
``point_index`` by copying bytes. Files appear under their names only on commit.
"""

from __future__ import annotations

import glob
import base64
import json
import os
import shutil
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from cloudloom.operators import regions, runindex
from cloudloom.operators.runindex import spans
from cloudloom.sources.las.file import LasFile, Layout, Source, Tally, assemble, chunks_of
from cloudloom.sources.las.formats import ALL_LAYERS, LAYERED_CHUNKED, NONE, POINTWISE, POINTWISE_CHUNKED, is_wide, layers_for, point_schema, union_schema
from cloudloom.sources.las.header import Vlr
from cloudloom.sources.las.lost import find_chunks, found_starts

#: Bytes of small files that share a partition.
GROUP_BYTES = 16 << 20
#: Bytes of a large file that make a partition.
SPLIT_BYTES = 8 << 20
#: Points of a chunk where chunks may have any size and no column decides.
CHUNK = 50_000
_ENDINGS = (".las", ".laz")


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def list_files(path: str) -> list[tuple[str, int, int]]:
    """(path, size, time) of the point files under a path, sorted."""
    path = _local(path)
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        info = system.get_file_info(inner)
        infos = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
        scheme = path.split("://")[0]
        return sorted((f"{scheme}://{i.path}", i.size, i.mtime_ns or 0) for i in infos if i.is_file and i.path.lower().endswith(_ENDINGS))
    if os.path.isfile(path):
        found = [path]
    elif os.path.isdir(path):
        found = [os.path.join(d, f) for d, dirs, files in os.walk(path) for f in files if f.lower().endswith(_ENDINGS) and not os.path.basename(d).startswith("_")]
    else:
        found = [f for f in glob.glob(path, recursive=True) if os.path.isfile(f)]
    return sorted((f, (s := os.stat(f)).st_size, s.st_mtime_ns) for f in found)


def _numbers(text: str | None, n: int) -> list[float] | None:
    if text is None:
        return None
    got = [float(v) for v in text.split(",")]
    if len(got) != n:
        raise ValueError(f"{text!r} should be {n} numbers")
    return got


class Options(dict):
    """Options by name in any case, as Spark hands them over."""

    def __init__(self, given):
        super().__init__({k.lower(): v for k, v in given.items()})

    def __getitem__(self, k: str) -> str:
        return super().__getitem__(k.lower())

    def __contains__(self, k: str) -> bool:
        return super().__contains__(k.lower())

    def get(self, k: str, default=None):
        return super().get(k.lower(), default)


@dataclass
class Part(InputPartition):
    """Slices (path, start, stop) of files; stop None means the whole file. ``share`` (k, n) means the k-th of n shares of the one file in it."""

    slices: tuple[tuple[str, int, int | None], ...]
    share: tuple[int, int] | None = None


class LasReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema
        self.rect, self.circle = _numbers(options.get("rect"), 4), _numbers(options.get("circle"), 3)
        if self.rect or self.circle:
            regions.area(self.rect, self.circle)
        names = [f.name for f in schema]
        self.selective = int(options["selective"], 0) if "selective" in options else layers_for(names) | (1 if "z" in names else 0)
        self.first, self.last = 0, None
        #: Bounds that pushed filters put on x and y: only used to choose what an index says may lie inside.
        self.box = [-np.inf, -np.inf, np.inf, np.inf]

    def partitions(self):
        return plan_parts(list_files(self.options["path"]), self.options)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for path, start, stop in partition.slices:
            with LasFile(path, self.selective, found_starts(self.options.get("chunkTables"), path)) as f:
                if partition.share:
                    start, stop = share_of(f, *partition.share)
                if start == stop or self._elsewhere(f):
                    continue
                for w in f.warnings:
                    warnings.warn(f"{path}: {w}", stacklevel=1)
                yield from read_slice(f, self.schema, max(start, self.first), self._stop(stop, f), self.rect, self.circle, path, self.box)

    def _elsewhere(self, f: LasFile) -> bool:
        """True if the header says that no point lies in the area. Only with option ``trustBounds``, since headers may be wrong."""
        if self.options.get("trustBounds", "false").lower() != "true" or not (self.rect or self.circle):
            return False
        h = f.header.fields
        if self.rect:
            low_x, low_y, high_x, high_y = self.rect
        else:
            cx, cy, r = self.circle
            low_x, low_y, high_x, high_y = cx - r, cy - r, cx + r, cy + r
        return h["min_x"] > high_x or h["max_x"] < low_x or h["min_y"] > high_y or h["max_y"] < low_y

    def _stop(self, stop: int | None, f: LasFile) -> int:
        stop = len(f) if stop is None else stop
        return stop if self.last is None else min(stop, self.last + 1)


class PushingReader(LasReader):
    """With filters pushed down. Spark refuses such a reader while spark.sql.python.filterPushdown.enabled is off, so the option ``push`` asks for it."""

    def pushFilters(self, filters):
        # ordinals bound the slices that are read, coordinates the candidates of an index; every filter is still applied by Spark
        for f in filters:
            at, v = getattr(f, "attribute", None), getattr(f, "value", None)
            low = v if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else None
            high = v if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else None
            if at == ("point_index",):
                if low is not None:
                    self.first = max(self.first, low)
                if high is not None:
                    self.last = high if self.last is None else min(self.last, high)
            elif at in (("x",), ("y",)):
                k = int(at == ("y",))
                if low is not None:
                    self.box[k] = max(self.box[k], low)
                if high is not None:
                    # an index takes upper bounds as outside, so step over a bound that may be inside
                    self.box[k + 2] = min(self.box[k + 2], float(np.nextafter(high, np.inf)))
            yield f


def share_of(f: LasFile, k: int, n: int) -> tuple[int, int]:
    """The ordinals of the k-th of n shares of a file: whole chunks, so that none is decoded twice. Of a file that can't be split the first share is all."""
    total = len(f)
    if not f.splittable:
        return (0, total) if k == 0 else (0, 0)
    ends = [total * k // n, total * (k + 1) // n]
    if f.table is not None:
        first = np.asarray(f.table.first[:-1] or [0], np.int64)
        starts = [int(first[i]) if (i := int(np.searchsorted(first, e))) < len(first) else total for e in ends]
        ends = [starts[0], total if k == n - 1 else starts[1]]
    return ends[0], ends[1]


def plan_parts(files: list[tuple[str, int, int]], options: Options) -> list[Part]:
    """Files by size alone: small ones are grouped, large ones come in shares of ``splitBytes``, which the tasks cut at chunks. None is opened here.

    With option ``splitPoints`` files over ``groupBytes`` are opened and cut at that many points instead.
    """
    group, share = int(options.get("groupBytes", GROUP_BYTES)), int(options.get("splitBytes", SPLIT_BYTES))
    split = int(options.get("splitPoints", 0))
    parts, held, size = [], [], 0
    for path, n, _ in files:
        if n <= group:
            if held and size + n > group:
                parts.append(Part(tuple(held)))
                held, size = [], 0
            held.append((path, 0, None))
            size += n
            continue
        if not split:
            shares = -(-n // share)
            parts += [Part(((path, 0, None),), (k, shares)) for k in range(shares)]
            continue
        with LasFile(path, starts=found_starts(options.get("chunkTables"), path)) as f:
            total = len(f)
            if not f.splittable:
                parts.append(Part(((path, 0, None),)))
                continue
            if f.table is None:
                cuts = list(range(0, total, split))
            else:
                # whole chunks, so that none is decoded twice
                cuts = [0]
                for first in f.table.first[1:-1]:
                    if first - cuts[-1] >= split:
                        cuts.append(first)
            parts += [Part(((path, a, b),)) for a, b in zip(cuts, [*cuts[1:], total])]
    if held:
        parts.append(Part(tuple(held)))
    return parts or [Part(())]


def read_slice(f: LasFile, schema: T.StructType, start: int, stop: int, rect=None, circle=None, name: str | None = None, box=None) -> Iterator[pa.RecordBatch]:
    """Batches of a slice in the columns of ``schema``; columns the file lacks are null. ``box`` only narrows what an index offers."""
    arrow = to_arrow_schema(schema)
    windows = [(start, stop)]
    boxed = box is not None and bool(np.isfinite(box).any())
    if boxed and (box[0] > box[2] or box[1] > box[3]):
        return
    if (rect or circle or boxed) and (index := f.index_bytes()) is not None:
        if rect or circle:
            windows = [(max(a, start), min(b, stop)) for a, b in spans(index, rect, circle)]
        if boxed:
            inside = spans(index, box)
            windows = [(max(a, c), min(b, d)) for a, b in windows for c, d in inside if max(a, c) < min(b, d)]
    (sx, sy, sz), (ox, oy, oz) = f.header.scales, f.header.offsets
    for a, b in windows:
        if a >= b:
            continue
        for first, cols in f.blocks(a, b):
            n = len(cols["X"])
            at = np.arange(first, first + n, dtype=np.int64)
            xyz = {"x": ("X", sx, ox), "y": ("Y", sy, oy), "z": ("Z", sz, oz)}
            cols = cols | {k: cols[c].astype(np.float64) * s + o for k, (c, s, o) in xyz.items() if k in schema.names or ((rect or circle) and k != "z")}
            if rect or circle:
                x, y = cols["x"], cols["y"]
                if rect:
                    keep = (x >= rect[0]) & (x < rect[2]) & (y >= rect[1]) & (y < rect[3])
                else:
                    dx, dy = x - circle[0], y - circle[1]
                    keep = dx * dx + dy * dy < circle[2] * circle[2]
                if not keep.any():
                    continue
                at, cols = at[keep], {c: v[keep] for c, v in cols.items()}
                n = len(at)
            out = []
            for field in arrow:
                if field.name == "file":
                    out.append(pa.array([name] * n, pa.string()))
                elif field.name == "point_index":
                    out.append(pa.array(at))
                elif field.name in cols:
                    v = cols[field.name]
                    out.append(pa.array(v.tolist() if v.dtype == object else np.ascontiguousarray(v), field.type, from_pandas=False))
                else:
                    out.append(pa.nulls(n, field.type))
            yield pa.RecordBatch.from_arrays(out, schema=arrow)


class LasStreamReader(DataSourceStreamReader):
    """Files as they arrive under a path, each once, whatever its time or name. Files must not change once they are there.

    Which files have been seen is kept in the folder of option ``log``, a list of files per offset; without it, in the offsets themselves.
    """

    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.batch = options, LasReader(options, schema)
        self.log = _local(options["log"]) if "log" in options else None

    def _logged(self, after: int, upto: int) -> list[str]:
        out: list[str] = []
        for k in range(after + 1, upto + 1):
            with open(os.path.join(self.log, str(k)), encoding="utf-8") as f:
                out += json.load(f)
        return out

    def _last(self) -> int:
        if not os.path.isdir(self.log):
            return 0
        return max((int(n) for n in os.listdir(self.log) if n.isdigit()), default=0)

    def initialOffset(self) -> dict:
        return {"log": 0} if self.log else {"files": []}

    def latestOffset(self) -> dict:
        there = {p for p, _, _ in list_files(self.options["path"])}
        if not self.log:
            return {"files": sorted(there | set(getattr(self, "_seen", ())))}
        last = self._last()
        new = sorted(there.difference(self._logged(0, last)))
        if new:
            # a list is there whole or not at all; one whose offset was lost is taken up again
            os.makedirs(self.log, exist_ok=True)
            part = os.path.join(self.log, f".{last + 1}")
            with open(part, "w", encoding="utf-8") as f:
                json.dump(new, f)
            os.replace(part, os.path.join(self.log, str(last + 1)))
            last += 1
        return {"log": last}

    def partitions(self, start: dict, end: dict):
        wanted = set(self._logged(start["log"], end["log"])) if self.log else set(end["files"]) - set(start["files"])
        self._seen = end.get("files", ())
        new = sorted(f for f in list_files(self.options["path"]) if f[0] in wanted)
        return plan_parts(new, self.options)

    def read(self, partition: Part):
        return self.batch.read(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    final: str | None
    tally: Tally
    lengths: list[int]
    counts: list[int]
    first: int


def _records(text: str) -> list[Vlr]:
    """Records from JSON: a list of {user_id, record_id, data (base64), description}."""
    return [Vlr(r["user_id"], int(r["record_id"]), base64.b64decode(r.get("data", "")), r.get("description", "")) for r in json.loads(text)]


class LasWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = _local(options["path"]), overwrite
        if "://" in self.path:
            raise ValueError("point files are written to a folder all executors share")
        flag = lambda k, d: options.get(k, d).lower() == "true"
        self.single = flag("single", "false")
        own = {
            name: read(options[option])
            for option, name, read in (
                ("pointFormat", "point_format", int), ("scales", "scales", lambda v: tuple(_numbers(v, 3))), ("offsets", "offsets", lambda v: tuple(_numbers(v, 3))),
                ("extraBytes", "extra", int), ("compressed", "compressed", lambda v: v.lower() == "true"), ("itemVersion", "item_version", int), ("chunkSize", "chunk_size", int),
                ("versionMinor", "version_minor", int), ("crs", "crs", lambda v: int(v) if v.isdigit() else v), ("compatibility", "compatibility", lambda v: v.lower() == "true"),
                ("container", "compressor", lambda v: {"pointwise": POINTWISE, "chunked": POINTWISE_CHUNKED, "layered": LAYERED_CHUNKED}[v.lower()]),
                ("systemIdentifier", "system_identifier", str), ("generatingSoftware", "generating_software", str), ("creation", "creation", lambda v: tuple(int(x) for x in _numbers(v, 2))),
                ("userData", "user_data", base64.b64decode), ("userDataAfter", "user_data_after", base64.b64decode), ("projectId", "project_id", base64.b64decode),
                ("vlrs", "vlrs", _records), ("evlrs", "evlrs", _records),
            )
            if option in options
        }
        if "like" in options:
            # everything of another file but its points
            with LasFile(options["like"]) as f:
                self.layout = f.layout(**own)
        else:
            self.layout = Layout(**{"point_format": 0} | own)
        if self.layout.compressor == POINTWISE and not self.single:
            raise ValueError("a pointwise file is one stream: write it with option single, from one partition")
        self.chunk_by = options.get("chunkBy")
        if self.chunk_by and self.layout.chunk_size:
            raise ValueError("chunkBy needs chunkSize 0")
        self.ending = ".las" if self.layout.compressor == NONE else ".laz"

    def _blocks(self, batches: Iterator[pa.RecordBatch], seen: list[int]) -> Iterator[dict | None]:
        before = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = {}
            for f, a in zip(b.schema, b.columns):
                if f.name in ("file",):
                    continue
                if pa.types.is_binary(f.type):
                    v = np.empty(b.num_rows, object)
                    v[:] = a.to_pylist()
                    cols[f.name] = v
                elif f.name == self.chunk_by or not pa.types.is_string(f.type):
                    cols[f.name] = np.array(a.to_pylist(), object) if f.name == self.chunk_by else a.fill_null(0).to_numpy(zero_copy_only=False)
            for k, c in enumerate("xyz"):
                if c.upper() not in cols and c in cols:
                    q = (cols[c] - self.layout.offsets[k]) / self.layout.scales[k]
                    q = np.trunc(np.where(q >= 0, q + 0.5, q - 0.5))
                    if (np.abs(q) >= 2**31).any():
                        raise ValueError(f"a coordinate in {c} does not fit into 32 bits")
                    cols[c.upper()] = q.astype(np.int64)
            for c in ("X", "Y", "Z"):
                cols.setdefault(c, np.zeros(b.num_rows, np.int64))
            if not seen and "point_index" in cols:
                seen.append(int(cols["point_index"][0]))
            key = cols.pop(self.chunk_by, None) if self.chunk_by else None
            if key is None:
                yield cols
                continue
            cuts = [0, *[i for i in range(1, b.num_rows) if key[i] != key[i - 1]], b.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if before is not None and (a or key[a] != before[0]):
                    yield None
                yield {c: v[a:z] for c, v in cols.items()}
                before = (key[z - 1],)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(f"{self.path}/_writing", exist_ok=True)
        lay, tally, lengths, counts, seen = self.layout, Tally(), [], [], []

        def prepared() -> Iterator[dict | None]:
            for b in self._blocks(iterator, seen):
                if b is not None:
                    tally.add(b, is_wide(lay.point_format))
                    b = lay.prepare(b)
                yield b

        name = uuid.uuid4().hex
        body = f"{self.path}/_writing/{name}.body"
        with open(body, "wb") as out:
            size = 1 << 62 if lay.compressor == POINTWISE else 1 << 16 if lay.compressor == NONE else lay.chunk_size or (0 if self.chunk_by else CHUNK)
            for raw, n in lay.encoded(chunks_of(prepared(), size)):
                out.write(raw)
                lengths.append(len(raw))
                counts.append(n)
        if not tally.count:
            os.remove(body)
            return Written(None, None, tally, [], [], 0)
        if self.single and lay.compressor == POINTWISE and seen and seen[0] > 0:
            raise ValueError("a pointwise file is one stream: write it from one partition")
        if self.single:
            return Written(body, None, tally, lengths, counts, seen[0] if seen else 0)
        whole = f"{self.path}/_writing/{name}{self.ending}"
        with open(whole, "wb") as out:
            assemble(lay, tally, _pieces(body), lengths, counts, out)
        os.remove(body)
        return Written(whole, f"{self.path}/part-{name}{self.ending}", tally, lengths, counts, 0)

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None and m.temporary]
        if self.overwrite:
            for f, _, _ in list_files(self.path):
                os.remove(f)
        if self.single:
            done.sort(key=lambda m: m.first)
            tally = Tally()
            for m in done:
                tally.merge(m.tally)
            counts = [c for m in done for c in m.counts]
            if self.layout.chunk_size and self.layout.compressor not in (NONE, POINTWISE) and any(c != self.layout.chunk_size for c in counts[:-1]):
                raise ValueError("tasks end in the middle of chunks of fixed size; write with chunkSize 0")
            whole = f"{self.path}/_writing/whole{self.ending}"
            with open(whole, "wb") as out:
                assemble(self.layout, tally, (p for m in done for p in _pieces(m.temporary)), [n for m in done for n in m.lengths], counts, out)
            os.replace(whole, f"{self.path}/points{self.ending}")
        else:
            for m in done:
                os.replace(m.temporary, m.final)
        shutil.rmtree(f"{self.path}/_writing", ignore_errors=True)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.temporary and os.path.exists(m.temporary):
                os.remove(m.temporary)
        try:
            # tasks that failed left nothing of their own, or what they left is in no file's way
            os.rmdir(f"{self.path}/_writing")
        except OSError:
            pass


def _pieces(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while b := f.read(size):
            yield b


class LasDataSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> T.StructType:
        o = Options(self.options)
        if o.get("merge", "false").lower() == "true":
            whole = union_schema()
        else:
            files = list_files(o["path"])
            if not files:
                raise FileNotFoundError(f"no point files under {o['path']}")
            with LasFile(files[0][0]) as f:
                whole = point_schema(f.header.format, f.extra)
        if o.get("scaled", "false").lower() == "true":
            # Spark takes x and X for one name, so the scaled columns stand in for the raw ones
            whole = T.StructType([T.StructField(f.name.lower(), T.DoubleType()) if f.name in ("X", "Y", "Z") else f for f in whole])
        if "columns" not in o:
            return whole
        names = [c.strip() for c in o["columns"].split(",")]
        if unknown := [c for c in names if c not in whole.names]:
            raise ValueError(f"no columns {unknown}")
        return T.StructType([whole[c] for c in names])

    def reader(self, schema: T.StructType) -> LasReader:
        kind = PushingReader if Options(self.options).get("push", "false").lower() == "true" else LasReader
        return kind(Options(self.options), schema)

    def streamReader(self, schema: T.StructType) -> LasStreamReader:
        return LasStreamReader(Options(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> LasWriter:
        return LasWriter(Options(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasDataSource)


def read_las(spark: SparkSession, path: str, columns: list[str] | None = None, **options):
    """Reads point files; ``columns`` decides what is decoded."""
    register(spark)
    r = spark.read.format("las")
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
        r = r.option("push", "true")
    if columns:
        r = r.option("columns", ",".join(columns))
    for k, v in options.items():
        r = r.option(k, str(v).lower() if isinstance(v, bool) else ",".join(map(str, v)) if isinstance(v, (tuple, list)) else v)
    return r.load(path)


def read_headers(spark: SparkSession, path: str):
    """One row per file: the facts of its header, and its warnings. Files are opened in tasks."""
    listed = list_files(path)
    files = spark.createDataFrame([(p,) for p, _, _ in listed], "file string")
    kind = (
        "file string, version string, point_format int, record_length int, points long, compressor int, chunk_size long, chunks int,"
        " x_scale double, y_scale double, z_scale double, x_offset double, y_offset double, z_offset double,"
        " min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, epsg int, wkt string, extra_bytes int,"
        " records array<string>, item_versions array<int>, warnings array<string>"
    )
    names = [c.split()[0] for c in kind.replace("\n", "").split(", ") if c]

    def run(batches):
        for b in batches:
            rows = []
            for path in b["file"].to_pylist():
                with LasFile(path) as f:
                    s = f.summary()
                rows.append(
                    [path, s["version"], s["point_format"], s["record_length"], s["points"], s["compressor"], s["chunk_size"], s["chunks"], *s["scales"], *s["offsets"], *s["bounds"], s["epsg"], s["wkt"], s["extra_bytes"],
                     [f"{u}/{n}" for u, n in s["records"]], s["item_versions"], s["warnings"]]
                )
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], names=arrow.names)

    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(kind)
    arrow = to_arrow_schema(schema)
    assert schema.names == names
    return files.repartition(max(1, min(len(listed), 1000))).mapInArrow(run, schema)


def metadata_records(spark: SparkSession, path: str):
    """One row per record of each file, before and behind the points: file, extended, position, user_id, record_id, description, size, data."""
    kind = "file string, extended boolean, position int, user_id string, record_id int, description string, size long, data binary"

    def each(path: str) -> Iterator[tuple]:
        with LasFile(path) as f:
            for extended, records in ((False, f.header.vlrs), (True, f.header.evlrs)):
                for k, v in enumerate(records):
                    data = f.payload(v)
                    yield path, extended, k, v.user_id, v.record_id, v.description, len(data), data

    return _per_file(spark, path, each, kind)


def chunk_table(spark: SparkSession, path: str):
    """One row per chunk of each compressed file: file, chunk, first_index, points, byte_offset, byte_size."""

    def each(path: str) -> Iterator[tuple]:
        with LasFile(path) as f:
            if f.table is not None:
                t = f.table
                for k in range(len(t.starts) - 1):
                    yield path, k, t.first[k], t.first[k + 1] - t.first[k], t.starts[k], t.starts[k + 1] - t.starts[k]

    return _per_file(spark, path, each, "file string, chunk int, first_index long, points long, byte_offset long, byte_size long")


def _per_file(spark: SparkSession, path: str, each, kind: str):
    """Rows that a function makes of every file under a path; files are opened in tasks."""
    files = list_files(path)
    arrow = to_arrow_schema(T.StructType.fromDDL(kind))

    def run(batches):
        for b in batches:
            for path in b["file"].to_pylist():
                if rows := list(each(path)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], names=arrow.names)

    listed = spark.createDataFrame([(p,) for p, _, _ in files], "file string")
    return listed.repartition(max(1, min(len(files), 1000))).mapInArrow(run, kind)


def copy_las(df, like: str, target: str, **options) -> None:
    """Writes points under ``target`` with everything else of the file ``like``: scales, offsets, records, coordinate system, names of extra bytes. Options override."""
    register(df.sparkSession)
    w = df.write.format("las").mode("append").option("like", like)
    for k, v in options.items():
        w = w.option(k, str(v).lower() if isinstance(v, bool) else v)
    w.save(target)


def write_index(spark: SparkSession, path: str, **how) -> None:
    """Builds a spatial index for every file under a path and writes it beside the file, on whatever file system Spark can write to. ``how`` goes to ``runindex.build``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for file, _, _ in list_files(path):
        index = runindex.build(read_las(spark, file, ["point_index", "x", "y"], scaled=True), **how).serialize()
        target = jvm.org.apache.hadoop.fs.Path(os.path.splitext(file)[0] + ".lax")
        out = target.getFileSystem(conf).create(target, True)
        try:
            out.write(bytearray(index))
        finally:
            out.close()


def take_points(wanted, schema: T.StructType, near: int = 50_000):
    """Random access: the points of a frame (file, point_index), in the columns of ``schema``. Only chunks that hold wanted points are decoded.

    Ordinals outside a file raise IndexError; a point asked for twice comes twice.
    """
    arrow = to_arrow_schema(schema)

    def pick(f: LasFile, path: str, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        if at[0] < 0 or at[-1] >= len(f):
            raise IndexError(f"{path} has no point {at[0] if at[0] < 0 else at[-1]}")
        k = 0
        while k < len(at):
            # up to the end of the chunk, or of a block of records, that holds the next point
            stop = f.table.first[f.table.chunk_of(int(at[k])) + 1] if f.table else int(at[k]) // near * near + near
            z = int(np.searchsorted(at, stop))
            start = int(at[k])
            for b in read_slice(f, schema, start, int(at[z - 1]) + 1, name=path):
                first = start
                inside = at[(at >= first) & (at < first + b.num_rows)]
                yield b.take(pa.array(inside - first))
                start = first + b.num_rows
            k = z

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        for b in batches:
            for path, at in zip(b["file"].to_pylist(), b["point_index"].to_numpy()):
                held.setdefault(path, []).append(at)
        for path, at in held.items():
            with LasFile(path, layers_for(arrow.names)) as f:
                yield from pick(f, path, np.sort(np.array(at, np.int64)))

    cut = wanted.select("file", wanted["point_index"].cast("long").alias("point_index"))
    from pyspark.sql import functions as F

    # neighbouring chunks go to one task in the same amount, and each is decoded once, up to the last point wanted of it
    parts = 2 * int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartitionByRange(parts, "file", F.floor(F.col("point_index") / near)).mapInArrow(run, schema)


def decode_binary(files, schema: T.StructType):
    """Points of files held in a ``binaryFile`` frame (columns path, content): for stores only Spark can read."""

    def run(batches):
        for b in batches:
            for path, raw in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                with LasFile(raw, layers_for([f.name for f in schema])) as f:
                    yield from read_slice(f, schema, 0, len(f), name=path)

    return files.select("path", "content").mapInArrow(run, schema)


__all__ = ["ALL_LAYERS", "LasDataSource", "Source", "chunk_table", "copy_las", "decode_binary", "find_chunks", "list_files", "metadata_records", "read_headers", "read_las", "register", "spans", "take_points", "write_index"]
