"""Lost chunk tables: where chunks of a fixed size start is found again, by all cores.

Only decoding a chunk tells where it ends and the next one starts. So tasks decode shares of a file before that is known, from every
position where a first point within the header's bounds may stand, and note where such a chunk ends. Then the chunks are followed from the first one: what was
noted at a start gives the next. A start where nothing was noted, since bounds are wrong or wide, is decoded when its turn comes. So the positions are
those a reader in order finds, whatever the header says.
"""

from __future__ import annotations

import hashlib
import io
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from cloudloom.runtime import scratch
from cloudloom.sources.las import container as C
from cloudloom.sources.las.entropy import LasDataError
from cloudloom.sources.las.file import LasFile
from cloudloom.sources.las.formats import ADAPTIVE, LAYERED_CHUNKED, POINTWISE_CHUNKED

#: Bytes of a file that a task looks through.
SHARE_BYTES = 4 << 20
#: Chunks decoded one after the other where nothing was noted, at first; four times as many each time after.
REACH = 16
#: Possible starts a share may have, as a multiple of those it would have if its points took three bytes. More mean that the bounds tell nothing.
_TOO_MANY = 2


def is_lost(f: LasFile) -> bool:
    h = f.header
    return f.table is None and h.compressor in (POINTWISE_CHUNKED, LAYERED_CHUNKED) and h.chunk_size not in (0, ADAPTIVE) and h.count > 0


def chunks_at(f: LasFile) -> int:
    return f.data_start + 8


def _record(f: LasFile) -> int:
    return sum(i.size for i in f.data_items)


def _bound(f: LasFile) -> int:
    """Bytes that no chunk exceeds: no symbol takes more than 15 bits, so no field more than some five times its size."""
    return f.header.chunk_size * (5 * _record(f) + 64) + 4096


def possible_starts(f: LasFile, raw: bytes, n: int) -> np.ndarray:
    """Positions below ``n`` in ``raw`` where a point within the bounds of the header may stand."""
    h, last = f.header, min(n, len(raw) - _record(f) + 1)
    bounds = []
    for k, a in enumerate("xyz"):
        s, o = h.scales[k], h.offsets[k]
        with np.errstate(all="ignore"):
            ends = sorted((np.float64(h.fields[f"{m}_{a}"]) - o) / s for m in ("min", "max"))
        if not np.isfinite(ends).all():
            return np.empty(0, np.int64)
        bounds.append((np.floor(ends[0]) - 1, np.ceil(ends[1]) + 1))
    found = []
    for phase in range(4):
        count = (len(raw) - phase) // 4
        v = np.frombuffer(raw, "<i4", count, phase)
        # Y and Z are the two numbers after X
        ok = np.ones(max(count - 2, 0), bool)
        for k, (low, high) in enumerate(bounds):
            part = v[k : count - 2 + k]
            ok &= (part >= low) & (part <= high)
        found.append(np.flatnonzero(ok) * 4 + phase)
    at = np.sort(np.concatenate(found))
    return at[at < last]


def noted(f: LasFile, start: int, stop: int) -> tuple[list[int], list[int]]:
    """Starts from ``start`` up to ``stop`` where a whole chunk may stand, and where it would end."""
    h = f.header
    raw = f.source.read(start, min(f.source.size, stop + _bound(f)) - start)
    at = possible_starts(f, raw, stop - start)
    if len(at) > _TOO_MANY * ((stop - start) / (3 * h.chunk_size) + 8):
        return [], []
    starts, ends = [], []
    for a, e in zip(at.tolist(), C.chunk_ends(raw, at.tolist(), h.chunk_size, f.data_items, h.compressor == LAYERED_CHUNKED)):
        if e is not None:
            starts.append(start + a)
            ends.append(start + e)
    return starts, ends


def followed(f: LasFile, start: int, chunks: int) -> tuple[list[int], list[int]]:
    """Starts and ends of chunks one after the other from ``start``; fewer than asked for if one can't be decoded."""
    h, starts, ends = f.header, [], []
    for _ in range(chunks):
        raw = f.source.read(start, min(f.source.size, start + _bound(f)) - start)
        try:
            _, e = C.decode_chunk(raw, 0, len(raw), h.chunk_size, f.data_items, h.compressor == LAYERED_CHUNKED)
        except (LasDataError, IndexError):
            break
        starts.append(start)
        ends.append(start + e)
        start += e
    return starts, ends


_KIND = "file string, first long, chunks long, starts binary, ends binary"


def _positions(spark: SparkSession, rows: list[tuple[str, int, int]], kind: str, work) -> list:
    """What ``work`` gives for (file, two numbers), a task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, a, z in zip(*(c.to_pylist() for c in b.columns)):
                with LasFile(path) as f:
                    if not is_lost(f):
                        continue
                    starts, ends = work(f, a, z)
                    chunks = -(-f.header.count // f.header.chunk_size)
                    got = [[path], [chunks_at(f)], [chunks], *([np.array(v, np.int64).tobytes()] for v in (starts, ends))]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["file", "first", "chunks", "starts", "ends"])

    frames = spark.sparkContext.parallelize(rows, max(1, min(len(rows), 10_000))).toDF(kind)
    return frames.mapInArrow(run, _KIND).collect()


def _share(f: LasFile, k: int, n: int) -> tuple[list[int], list[int]]:
    first, size = chunks_at(f), f.source.size
    cut = [first + (size - first) * i // n for i in (k, k + 1)]
    return noted(f, *cut)


def find_chunks(spark: SparkSession, path: str, share: int = SHARE_BYTES) -> str:
    """Finds the chunks of files that lost their chunk table, and returns a folder for option ``chunkTables`` of the source.

    A file with a chunk that can't be decoded gets no table, nor do those that have one or can't have one: they are read as ever. What comes to the driver is the size of a chunk table.
    """
    from cloudloom.sources.las.datasource import list_files

    rows = [(p, k, n) for p, size, _ in list_files(path) for n in [max(1, -(-size // share))] for k in range(n)]
    folder = scratch(spark)
    files: dict[str, tuple[int, int, dict[int, int]]] = {}
    for r in _positions(spark, rows, "file string, k long, n long", _share):
        known = files.setdefault(r.file, (r.first, r.chunks, {}))[2]
        known.update(zip(np.frombuffer(r.starts, np.int64).tolist(), np.frombuffer(r.ends, np.int64).tolist()))
    for file, (first, chunks, known) in files.items():
        starts, reach = [first], REACH
        while len(starts) < chunks:
            end = known.get(starts[-1])
            if end is not None:
                starts.append(end)
                continue
            more = _positions(spark, [(file, starts[-1], min(reach, chunks - len(starts)))], "file string, start long, chunks long", followed)[0]
            if not more.starts:
                break
            known.update(zip(np.frombuffer(more.starts, np.int64).tolist(), np.frombuffer(more.ends, np.int64).tolist()))
            reach *= 4
        if len(starts) == chunks:
            _save(f"{folder}/{_name(file)}", starts)
    return folder


def _name(file: str) -> str:
    return hashlib.sha1(file.encode()).hexdigest() + ".npy"


def _system(path: str):
    from pyarrow import fs

    if "://" in path.removeprefix("file://"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")


def _save(path: str, starts: list[int]) -> None:
    system, inner = _system(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    out = io.BytesIO()
    np.save(out, np.array(starts, np.int64))
    with system.open_output_stream(inner) as f:
        f.write(out.getvalue())


def found_starts(folder: str | None, file: str) -> list[int] | None:
    """The starts that ``find_chunks`` found for a file, None if it has none there."""
    if folder is None:
        return None
    from pyarrow import fs

    system, inner = _system(f"{folder}/{_name(file)}")
    if system.get_file_info(inner).type != fs.FileType.File:
        return None
    with system.open_input_file(inner) as f:
        return np.load(io.BytesIO(f.read())).tolist()
