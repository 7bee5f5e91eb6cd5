"""A point file: opening, reading slices as columns, its spatial index; and writing one."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from cloudloom.operators import regions, runindex
from cloudloom.sources.las import container as C
from cloudloom.sources.las import header as H
from cloudloom.sources.las import lanes
from cloudloom.sources.las import metadata as M
from cloudloom.sources.las.entropy import LasDataError
from cloudloom.sources.las.formats import (
    ADAPTIVE, ALL_LAYERS, LAYERED_CHUNKED, NONE, POINTWISE, POINTWISE_CHUNKED, Item, columns_of, is_wide, items_of, least_minor,
)


class Source:
    """Bytes at positions, of a local path, a URI a file system of Arrow can open, an open binary file, or bytes."""

    def __init__(self, what):
        self.own = isinstance(what, (str, os.PathLike))
        self.path = str(what) if self.own else None
        if self.own:
            path = self.path.removeprefix("file://").removeprefix("file:")
            if "://" in path:
                from pyarrow import fs

                system, inner = fs.FileSystem.from_uri(path)
                self.fp = system.open_input_file(inner)
                self.size = self.fp.size()
            else:
                self.fp = open(path, "rb")  # noqa: SIM115
                self.size = os.fstat(self.fp.fileno()).st_size
        elif isinstance(what, (bytes, bytearray, memoryview)):
            import io

            self.fp, self.size = io.BytesIO(what), len(what)
        else:
            self.fp = what
            self.size = what.seek(0, 2)

    def read(self, at: int, n: int) -> bytes:
        self.fp.seek(at)
        got = self.fp.read(n)
        if len(got) < n:
            raise LasDataError("the file ends too early")
        return got

    def close(self) -> None:
        if self.own:
            self.fp.close()


class LasFile:
    """An open point file. ``columns`` reads any slice; a failed or missing chunk table falls back on reading in order, with a warning.

    ``starts`` are the chunks' positions where they are known from elsewhere (``lost.find_chunks``); a table in the file comes first.
    """

    def __init__(self, what, selective: int = ALL_LAYERS, starts: list[int] | None = None):
        self.source = Source(what)
        self.path = self.source.path
        try:
            self._open()
        except struct.error as e:
            self.close()
            raise LasDataError(f"the file is damaged: {e}") from None
        except Exception:
            self.close()
            raise
        self.selective = selective
        if starts is not None and self.table is None:
            self.table = C.fixed_table(starts, self.source.size, self.header.chunk_size, len(self))

    def _open(self) -> None:
        s = self.source
        head = s.read(0, min(s.size, 375))
        if head[:4] != b"LASF":
            raise LasDataError("no LAS signature")
        if len(head) < 100:
            raise LasDataError("the file ends inside its header")
        start = struct.unpack_from("<I", head, 96)[0]
        if start > s.size:
            raise LasDataError("the file ends before its points")
        self.header = h = H.parse_header(s.read(0, start))
        self.data_start, self.data_items = start, h.items
        at = h.fields.get("start_of_first_extended_variable_length_record", 0)
        if h.fields.get("number_of_extended_variable_length_records", 0):
            if 0 < at <= s.size:
                H.parse_evlrs(h, s.read, s.size)
            else:
                h.warnings.append("the extended records lie outside the file")
        M.upgrade(h)
        self.table: C.ChunkTable | None = None
        if h.compressor in (POINTWISE_CHUNKED, LAYERED_CHUNKED):
            self.table, problem = C.read_table(s.read, start, s.size, h.chunk_size, h.count)
            if problem:
                h.warnings.insert(0, problem)

    def close(self) -> None:
        self.source.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def __len__(self) -> int:
        return self.header.count

    @property
    def warnings(self) -> list[str]:
        return self.header.warnings

    @property
    def extra(self) -> int:
        return self.header.fields["point_data_record_length"] - sum(i.size for i in items_of(self.header.format, 1 << 15)[:-1])

    @property
    def names(self) -> list[str]:
        return [n for n, _ in columns_of(self.header.format, self.extra)]

    @property
    def splittable(self) -> bool:
        return self.header.compressor == NONE or self.table is not None

    def _finish(self, cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        c = self.header.compat
        return M.unfold(cols, c["layout"], c["own"]) if c else cols

    def blocks(self, start: int = 0, stop: int | None = None, rows: int = 1 << 16) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        """(first ordinal, columns) of the slice, in order, at most a chunk or ``rows`` raw records at a time."""
        h, n = self.header, len(self)
        stop = n if stop is None else min(stop, n)
        if start < 0 or start > n:
            raise IndexError(f"no point {start}")
        if start >= stop:
            return
        if h.compressor == NONE:
            size = sum(i.size for i in self.data_items)
            for a in range(start, stop, rows):
                b = min(stop, a + rows)
                yield a, self._finish(C.raw_columns(self.source.read(self.data_start + a * size, (b - a) * size), self.data_items))
            return
        if self.table is not None:
            t, layered = self.table, h.compressor == LAYERED_CHUNKED
            k = t.chunk_of(start) - 1
            while (k := k + 1) < len(t.starts) - 1:
                first, held = t.first[k], min(t.first[k + 1], n) - t.first[k]
                if first >= stop:
                    return
                if held <= 0:
                    continue
                if first >= start and (many := self._beside(k, stop)) and (cols := self._many(k, many)) is not None:
                    yield first, self._finish(cols)
                    k += many - 1
                    continue
                raw = self.source.read(t.starts[k], t.starts[k + 1] - t.starts[k])
                # an older chunk need not be decoded beyond the slice
                want = held if layered else min(held, stop - first)
                cols, _ = C.decode_chunk(raw, 0, len(raw), want, self.data_items, layered, self.selective)
                a, b = max(start - first, 0), min(stop - first, want)
                yield first + a, self._finish({c: v[a:b] for c, v in cols.items()})
            return
        raw = self.source.read(self.data_start, self.source.size - self.data_start)
        for first, cols in C.decode_sequential(raw, 0, len(raw), n, self.data_items, h.compressor, h.chunk_size, self.selective):
            held = len(cols["X"])
            if first >= stop:
                return
            a, b = max(start - first, 0), min(stop - first, held)
            if a < b:
                yield first + a, self._finish({c: v[a:b] for c, v in cols.items()})

    def _beside(self, k: int, stop: int) -> int:
        """How many chunks from the k-th on are decoded side by side, 0 if it is decoded by itself."""
        h = self.header
        if h.compressor != POINTWISE_CHUNKED or h.chunk_size == ADAPTIVE:
            return 0
        whole = (stop - self.table.first[k]) // h.chunk_size
        n = lanes.lanes_for(self.data_items, h.chunk_size, whole)
        # batches of the same size, rather than a short one at the end
        return n and -(-whole // -(-whole // n))

    def _many(self, k: int, many: int) -> dict[str, np.ndarray] | None:
        """Columns of chunks decoded side by side; None if one is damaged, which decoding them one by one will tell."""
        at = self.table.starts[k : k + many + 1]
        raw = self.source.read(at[0], at[-1] - at[0])
        starts = [a - at[0] for a in at]
        if any(z - a < sum(i.size for i in self.data_items) for a, z in zip(starts, starts[1:])):
            return None
        return C.decode_chunks(raw, starts[:-1], starts[1:], self.header.chunk_size, self.data_items)

    def columns(self, *names: str, start: int = 0, count: int | None = None) -> dict[str, np.ndarray]:
        """Columns of a slice (all columns if none are named); a count beyond the end is cut."""
        unknown = [c for c in names if c not in self.names]
        if unknown:
            raise ValueError(f"no columns {unknown}")
        want = names or self.names
        parts = [b for _, b in self.blocks(start, None if count is None else start + count)]
        if not parts:
            return {c: np.empty(0, object if c in ("wave_packet", "extra_bytes") else np.int64) for c in want}
        return {c: np.concatenate([p[c] for p in parts]) for c in want}

    def xyz(self, start: int = 0, count: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled coordinates of a slice."""
        c = self.columns("X", "Y", "Z", start=start, count=count)
        return tuple(c[a].astype(np.float64) * s + o for a, s, o in zip("XYZ", self.header.scales, self.header.offsets))

    def within(self, *names: str, rect=None, circle=None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Ordinals of the points in an area, in file order, and their columns; only candidates of the spatial index are read if there is one."""
        kind, a = regions.area(rect, circle)
        if unknown := [c for c in names if c not in self.names]:
            raise ValueError(f"no columns {unknown}")
        index = self.index_bytes()
        windows = [(0, len(self))] if index is None else runindex.spans(index, rect, circle)
        at, parts = [np.empty(0, np.int64)], []
        (sx, sy, _), (ox, oy, _) = self.header.scales, self.header.offsets
        for w in windows:
            for first, cols in self.blocks(max(0, w[0]), w[1]):
                x, y = cols["X"].astype(np.float64) * sx + ox, cols["Y"].astype(np.float64) * sy + oy
                if kind == "rect":
                    hit = (x >= a[0]) & (x < a[2]) & (y >= a[1]) & (y < a[3])
                else:
                    hit = (x - a[0]) * (x - a[0]) + (y - a[1]) * (y - a[1]) < a[2] * a[2]
                if hit.any():
                    at.append(first + np.flatnonzero(hit))
                    parts.append({c: cols[c][hit] for c in names})
        return np.concatenate(at), {c: np.concatenate([p[c] for p in parts]) if parts else np.empty(0) for c in names}

    def index_bytes(self) -> bytes | None:
        """Bytes of the spatial index: the one inside the file, else the sidecar's; None if there is none."""
        v = self.header.record(H.SPATIAL_INDEX, True) or self.header.record(H.SPATIAL_INDEX)
        if v is not None:
            return self.payload(v)
        n, at = self.header.special
        if n > 0 and 0 < at and at + H.LONG_RECORD.size <= self.source.size:
            _, user, number, length, _ = H.LONG_RECORD.unpack(self.source.read(at, H.LONG_RECORD.size))
            if (H.text(user), number) == H.SPATIAL_INDEX:
                return self.source.read(at + H.LONG_RECORD.size, length)
        if self.path:
            side = os.path.splitext(self.path.removeprefix("file://").removeprefix("file:"))[0] + ".lax"
            if "://" in side:
                from pyarrow import fs

                system, inner = fs.FileSystem.from_uri(side)
                if system.get_file_info(inner).is_file:
                    with system.open_input_file(inner) as f:
                        return f.read()
            elif os.path.exists(side):
                with open(side, "rb") as f:
                    return f.read()
        return None

    def payload(self, record: H.Vlr) -> bytes:
        """The bytes of a record, read now if they were left in the file."""
        return self.source.read(record.at, record.length) if isinstance(record, H.FarVlr) else record.data

    def layout(self, **other) -> Layout:
        """How this file is written: scales, offsets, records, coordinate system and all else of its header. ``other`` overrides."""
        h, f = self.header, self.header.fields
        made = (H.COMPRESSION, H.SPATIAL_INDEX, *((H.EXTRA_BYTES,) if h.compat else ()))
        fmt = other.get("point_format", h.format)
        kept = {
            "point_format": fmt, "scales": h.scales, "offsets": h.offsets, "extra": self.extra, "compressed": h.compressor != NONE, "system_identifier": f["system_identifier"],
            "generating_software": f["generating_software"], "creation": (f["file_creation_day"], f["file_creation_year"]), "project_id": f.get("project_id", b""),
            "user_data": h.user_data, "user_data_after": h.user_data_after, "vlrs": [v for v in h.vlrs if v.key not in made],
            "evlrs": [H.Vlr(v.user_id, v.record_id, self.payload(v), v.description) for v in h.evlrs if v.key != H.SPATIAL_INDEX],
        }
        if not h.compat and fmt == h.format:
            kept["version_minor"] = f["version_minor"]
        if any(v.key == H.EXTRA_BYTES for v in kept["vlrs"]):
            kept.pop("extra")
        return Layout(**kept | other)

    def summary(self) -> dict:
        """Facts of the file for a report."""
        h = self.header
        epsg, wkt = M.read_crs(h.vlrs, h.evlrs)
        f = h.fields
        return {
            "path": self.path, "version": f"{f['version_major']}.{f['version_minor']}", "point_format": h.format, "record_length": f["point_data_record_length"],
            "points": len(self), "compressor": h.compressor, "chunk_size": h.chunk_size, "chunks": len(self.table.starts) - 1 if self.table else None,
            "item_versions": sorted({i.version for i in self.data_items}), "scales": h.scales, "offsets": h.offsets,
            "bounds": [f[f"{k}_{a}"] for k in ("min", "max") for a in "xyz"], "records": [v.key for v in h.vlrs],
            "extended_users": sorted({v.user_id for v in h.evlrs}), "epsg": epsg, "wkt": wkt, "extra_bytes": self.extra, "warnings": list(h.warnings),
        }


# -- writing


@dataclass
class Tally:
    """What a header says of its points."""

    count: int = 0
    by_return: list[int] = field(default_factory=lambda: [0] * 16)
    low: list[int] | None = None
    high: list[int] | None = None

    def add(self, cols: dict[str, np.ndarray], wide: bool) -> None:
        n = len(cols["X"])
        if not n:
            return
        r = cols.get("extended_return_number" if wide else "return_number")
        counts = np.bincount((np.zeros(n, np.int64) if r is None else np.asarray(r).astype(np.int64)) & 15, minlength=16).tolist()
        axes = [np.asarray(cols[a]) if cols.get(a) is not None else np.zeros(n, np.int64) for a in "XYZ"]
        self.merge(Tally(n, counts, [int(a.min()) for a in axes], [int(a.max()) for a in axes]))

    def merge(self, o: Tally) -> None:
        if not o.count:
            return
        self.count += o.count
        self.by_return = [a + b for a, b in zip(self.by_return, o.by_return)]
        self.low = o.low if self.low is None else list(map(min, self.low, o.low))
        self.high = o.high if self.high is None else list(map(max, self.high, o.high))


@dataclass
class Layout:
    """How a file is written. ``chunk_size`` 0 means chunks of any size; ``compressor`` None picks the format's usual one."""

    point_format: int
    scales: tuple[float, float, float] = (0.01, 0.01, 0.01)
    offsets: tuple[float, float, float] = (0.0, 0.0, 0.0)
    extra: int = 0
    compressed: bool = True
    compressor: int | None = None
    item_version: int | None = None
    chunk_size: int = 50_000
    version_minor: int | None = None
    vlrs: list[H.Vlr] = field(default_factory=list)
    evlrs: list[H.Vlr] = field(default_factory=list)
    crs: int | str | None = None
    system_identifier: str = ""
    generating_software: str = "cloudloom"
    creation: tuple[int, int] = (0, 0)
    project_id: bytes = b""
    user_data: bytes = b""
    user_data_after: bytes = b""
    compatibility: bool = False

    def __post_init__(self):
        fmt = self.point_format
        wide = is_wide(fmt)
        extra = next((v for v in self.vlrs if v.key == H.EXTRA_BYTES), None)
        if extra is not None:
            size = sum(a.size for a in M.attributes(extra.data))
            if self.extra and self.extra != size:
                raise ValueError(f"the extra-bytes record describes {size} bytes, not {self.extra}")
            self.extra = size
        if self.compatibility and not wide:
            raise ValueError("only wide formats are written in compatibility mode")
        self.stored = M.DOWN[fmt] if self.compatibility else fmt
        least = least_minor(self.stored)
        minor = self.version_minor if self.version_minor is not None else max(2, least)
        if not 0 <= minor <= 4 or minor < least:
            raise ValueError(f"version 1.{minor} can't hold format {self.stored}")
        if self.compatibility and minor > 3:
            raise ValueError("compatibility mode writes version 1.2 or 1.3")
        self.version_minor = minor
        if self.evlrs and minor < 4:
            raise ValueError("extended records need version 1.4")
        if any(s == 0 for s in self.scales):
            raise ValueError("a scale factor is not 0")
        self.version_minor = minor
        self.extra_vlr = None
        total = self.extra
        if self.compatibility:
            self.extra_vlr, total = M.disguise(fmt, self.extra, extra.data if extra else None)
        layered_ok = is_wide(self.stored)
        if not self.compressed:
            self.compressor, version = NONE, 0
        else:
            if self.compressor is None:
                self.compressor = LAYERED_CHUNKED if layered_ok else POINTWISE_CHUNKED
            if (self.compressor == LAYERED_CHUNKED) != layered_ok:
                raise ValueError(f"format {self.stored} is not written in container {self.compressor}")
            version = self.item_version if self.item_version is not None else (3 if layered_ok else 2)
            if version not in ((3, 4) if layered_ok else (1, 2)):
                raise ValueError(f"format {self.stored} has no item version {version}")
        self.items: list[Item] = items_of(self.stored, sum(i.size for i in items_of(self.stored, 1 << 15)[:-1]) + total, version)
        self.total_extra = total
        records = H.unique([v for v in self.vlrs if v.key != H.EXTRA_BYTES or not self.compatibility])
        H.unique(self.evlrs)
        if self.crs is not None:
            records.append(M.crs_record(self.crs))
        if self.compatibility:
            records += [M.compat_record(), self.extra_vlr]
        if self.compressor != NONE:
            records.append(H.compression_record(self.compressor, self.items, ADAPTIVE if self.chunk_size == 0 else self.chunk_size))
        self.records = H.unique(records) + [v for v in records if v.key == H.COMPRESSION]

    @property
    def layered(self) -> bool:
        return self.compressor == LAYERED_CHUNKED

    def head(self, tally: Tally, end: int) -> bytes:
        """Header and records; ``end`` is where the extended records start."""
        wide = is_wide(self.point_format)
        records = [M.compat_record(tally.count, tally.by_return[1:16]) if v.key == H.COMPATIBLE else v for v in self.records]
        packed = b"".join(map(H.pack_vlr, records))
        size = H.size_of(self.version_minor) + len(self.user_data)
        counts = tally.by_return
        legacy_ok = not is_wide(self.stored) and tally.count <= 0xFFFFFFFF
        f = {
            "file_signature": b"LASF", "version_major": 1, "version_minor": self.version_minor, "system_identifier": self.system_identifier,
            "generating_software": self.generating_software, "file_creation_day": self.creation[0], "file_creation_year": self.creation[1],
            "project_id": self.project_id,
            "header_size": size, "offset_to_point_data": size + len(packed) + len(self.user_data_after), "number_of_variable_length_records": len(records),
            "point_data_format_id": self.stored | (0x80 if self.compressor != NONE else 0), "point_data_record_length": sum(i.size for i in self.items),
            "number_of_point_records": tally.count if legacy_ok else 0, "number_of_points_by_return": counts[1:6] if legacy_ok else [0] * 5,
            "extended_number_of_point_records": tally.count, "extended_number_of_points_by_return": counts[1:16],
            "global_encoding": 16 if wide and any(v.key == H.WKT for v in records) and self.version_minor >= 4 else 0,
            "start_of_first_extended_variable_length_record": end if self.evlrs else 0, "number_of_extended_variable_length_records": len(self.evlrs),
        }
        for k, a in enumerate("xyz"):
            f[f"{a}_scale_factor"], f[f"{a}_offset"] = self.scales[k], self.offsets[k]
            for name, box in (("min", tally.low), ("max", tally.high)):
                f[f"{name}_{a}"] = box[k] * self.scales[k] + self.offsets[k] if box else 0.0
        return H.pack_fields(H.fields_of(self.version_minor), f) + self.user_data + packed + self.user_data_after

    def prepare(self, cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return M.fold(cols, self.point_format in (8, 10), self.extra) if self.compatibility else cols

    def chunk(self, cols: dict[str, np.ndarray]) -> bytes:
        """A chunk (or raw records) of points already prepared."""
        n = len(cols["X"])
        if self.compressor == NONE:
            return C.raw_bytes(cols, self.items, n)
        values = C.item_values(cols, self.items, n)
        if self.items[0].kind == "POINT14":
            # the first point is stored raw, by the raw record's rule; the codecs must start from what a reader will see
            first = C.item_values(C.raw_rule({c: v[:1] for c, v in cols.items()}), self.items, 1)
            for all_, one in zip(values, first):
                all_[0] = one[0]
        return C.encode_chunk(values, self.items, self.layered)

    def encoded(self, chunks: Iterable[dict[str, np.ndarray]]) -> Iterator[tuple[bytes, int]]:
        """Chunks (or raw records) of points already prepared, and how many points they hold. Where many of one fixed size follow each other they are coded side by side."""
        size = self.chunk_size if self.compressor == POINTWISE_CHUNKED else 0
        most = lanes.lanes_for(self.items, size, lanes.MOST_LANES) if size else 0
        held: list[dict] = []
        for cols in chunks:
            held.append(cols)
            if len(held) >= most:
                yield from self._encoded(held, size)
                held = []
        yield from self._encoded(held, size)

    def _encoded(self, held: list[dict], size: int) -> Iterator[tuple[bytes, int]]:
        whole = [c for c in held if len(c["X"]) == size]
        if size and lanes.lanes_for(self.items, size, len(whole)):
            values = C.item_arrays({c: np.concatenate([w[c] for w in whole]) for c in whole[0]}, self.items, len(whole) * size)
            yield from ((b, size) for b in C.encode_chunks([v.reshape(len(whole), size, -1) for v in values], self.items))
            held = held[len(whole) :]
        for cols in held:
            yield self.chunk(cols), len(cols["X"])


def _rows(cols: dict, a: int, b: int) -> dict:
    return {c: v[a:b] for c, v in cols.items()}


def chunks_of(blocks: Iterable[dict[str, np.ndarray] | None], size: int) -> Iterator[dict[str, np.ndarray]]:
    """Column blocks cut and joined into chunks of ``size`` points; with size 0 each None ends a chunk."""
    held: list[dict] = []
    n = 0

    def join() -> dict:
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0]

    for b in blocks:
        if b is None:
            if size:
                raise ValueError("chunks of fixed size can't be ended early")
            if n:
                yield join()
            held, n = [], 0
            continue
        held.append(b)
        n += len(b["X"])
        if size and n >= size:
            whole = join()
            for a in range(0, n - size + 1, size):
                yield _rows(whole, a, a + size)
            done = n - n % size
            held, n = ([_rows(whole, done, n)] if n % size else []), n % size
    if n:
        yield join()


def assemble(layout: Layout, tally: Tally, parts: Iterable[bytes], lengths: list[int], counts: list[int], out) -> None:
    """Writes a whole file from encoded chunks to a seekable binary file."""
    out.write(layout.head(tally, 0))
    start = out.tell()
    chunked = layout.compressor in (POINTWISE_CHUNKED, LAYERED_CHUNKED)
    if chunked:
        out.write(struct.pack("<q", start + 8 + sum(lengths)))
    for p in parts:
        out.write(p)
    if chunked:
        out.write(C.table_bytes(lengths, counts if layout.chunk_size == 0 else None))
    end = out.tell()
    for v in layout.evlrs:
        out.write(H.pack_evlr(v))
    out.seek(0)
    out.write(layout.head(tally, end))


def write_las(path, blocks: Iterable[dict[str, np.ndarray] | None], layout: Layout) -> Tally:
    """Writes column blocks (missing columns are 0) as one file; a None between blocks ends an adaptive chunk."""
    tally, lengths, counts, parts = Tally(), [], [], []
    size = layout.chunk_size if layout.compressor in (POINTWISE_CHUNKED, LAYERED_CHUNKED) else (1 << 62)

    def seen() -> Iterator:
        for b in blocks:
            if b is not None:
                tally.add(b, is_wide(layout.point_format))
                b = layout.prepare(b)
            yield b

    for raw, n in layout.encoded(chunks_of(seen(), size)):
        parts.append(raw)
        lengths.append(len(raw))
        counts.append(n)
    if hasattr(path, "write"):
        assemble(layout, tally, parts, lengths, counts, path)
    else:
        with open(path, "wb") as f:
            assemble(layout, tally, parts, lengths, counts, f)
    return tally


def append_index(path: str, data: bytes) -> None:
    """Puts a spatial index into a compressed file: behind everything else, and its place into the compression record."""
    with LasFile(path) as f:
        if f.header.compressor == NONE:
            raise ValueError("only compressed files can hold an index")
        raw = f.source.read(0, f.data_start)
    at = H.parse_header(raw).fields["header_size"]
    with open(path, "r+b") as out:
        end = out.seek(0, 2)
        out.write(H.pack_evlr(H.Vlr(*H.SPATIAL_INDEX, data, "spatial index")))
        while True:
            _, user, number, length, _ = H.RECORD.unpack_from(raw, at)
            if (H.text(user), number) == H.COMPRESSION:
                break
            at += H.RECORD.size + length
        # behind compressor, coder, versions, options and chunk size
        out.seek(at + H.RECORD.size + 16)
        out.write(struct.pack("<qq", 1, end))


__all__ = ["LasFile", "Layout", "POINTWISE", "Tally", "append_index", "assemble", "chunks_of", "write_las"]
