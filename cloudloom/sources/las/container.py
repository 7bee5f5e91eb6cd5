"""Point data of a file: raw records, chunks, chunk tables; bytes to columns and back."""

from __future__ import annotations

import struct
from bisect import bisect_right

import numpy as np

from cloudloom.sources.las import lanes
from cloudloom.sources.las.entropy import Ints, LasDataError, Reader, Writer
from cloudloom.sources.las.formats import ADAPTIVE, ALL_LAYERS, LAYERED_CHUNKED, POINTWISE, SELECTIVE, Item, UnsupportedFormat
from cloudloom.sources.las.items import LAYERED, PLAIN, Layer

_STRUCTS = {
    "POINT10": struct.Struct("<iiiHBBBBH"),
    "GPSTIME11": struct.Struct("<q"),
    "RGB12": struct.Struct("<3H"),
    "RGB14": struct.Struct("<3H"),
    "RGBNIR14": struct.Struct("<4H"),
    "WAVEPACKET13": struct.Struct("<BQIiiii"),
    "WAVEPACKET14": struct.Struct("<BQIiiii"),
}
_WIDE = struct.Struct("<iiiHBBBBhHq")
_POINT10 = np.dtype([("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("b14", "u1"), ("b15", "u1"), ("rank", "i1"), ("user", "u1"), ("source", "<u2")])
_POINT14 = np.dtype([("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("b14", "u1"), ("b15", "u1"), ("cls", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("gps", "<f8")])


def raw_values(item: Item, raw: bytes) -> list[int]:
    """The values an item codec works on, from raw bytes."""
    if item.kind == "POINT14":
        x, y, z, inten, b14, b15, cls, user, angle, source, gps = _WIDE.unpack(raw)
        return [x, y, z, inten, b14 & 15, b14 >> 4, b15 & 15, b15 >> 4 & 3, b15 >> 6 & 1, b15 >> 7, cls, user, angle, source, gps]
    if item.kind in ("BYTE", "BYTE14"):
        return list(raw)
    return list(_STRUCTS[item.kind].unpack(raw))


def values_raw(item: Item, v: list[int]) -> bytes:
    if item.kind == "POINT14":
        return _WIDE.pack(*v[:4], v[4] | v[5] << 4, v[6] | v[7] << 4 | v[8] << 6 | v[9] << 7, v[10], v[11], v[12], v[13], v[14])
    if item.kind in ("BYTE", "BYTE14"):
        return bytes(v)
    return _STRUCTS[item.kind].pack(*v)


def raw_dtype(items: list[Item]) -> np.dtype:
    parts = {
        "POINT10": _POINT10, "GPSTIME11": "<f8", "RGB12": ("<u2", (3,)), "RGB14": ("<u2", (3,)), "RGBNIR14": ("<u2", (4,)), "POINT14": _POINT14,
    }
    return np.dtype([(i.kind, parts.get(i.kind, f"V{i.size}")) for i in items])


def _legacy(cols: dict[str, np.ndarray]) -> None:
    """The old fields of wide points, as told by the new ones."""
    r, n = cols["extended_return_number"], cols["extended_number_of_returns"]
    cols["return_number"] = np.where((n > 7) & (r > 6), np.where(r >= n, 7, 6), r).astype(np.int16)
    cols["number_of_returns"] = np.minimum(n, 7).astype(np.int16)
    c, flags = cols["extended_classification"], cols["extended_classification_flags"]
    cols["classification"] = np.where(c < 32, c, 0).astype(np.int16)
    for s, f in enumerate(("synthetic_flag", "keypoint_flag", "withheld_flag")):
        cols[f] = (flags >> s & 1).astype(np.int16)
    cols["scan_angle_rank"] = rank_of(cols["extended_scan_angle"])
    cols["extended_point_type"] = np.ones(len(r), np.int16)


def _away(v: np.ndarray) -> np.ndarray:
    return np.trunc(np.where(v >= 0, v + 0.5, v - 0.5))


def rank_of(angle: np.ndarray) -> np.ndarray:
    return np.clip(_away((np.float32(0.006) * angle.astype(np.float32)).astype(np.float64)), -128, 127).astype(np.int8)


def angle_of(rank: np.ndarray) -> np.ndarray:
    return _away((rank.astype(np.float32) / np.float32(0.006)).astype(np.float64)).astype(np.int16)


def raw_columns(raw: bytes, items: list[Item]) -> dict[str, np.ndarray]:
    """Columns of raw records."""
    a = np.frombuffer(raw, raw_dtype(items))
    cols: dict[str, np.ndarray] = {}
    for i in items:
        p = a[i.kind]
        if i.kind in ("POINT10", "POINT14"):
            for f in ("X", "Y", "Z"):
                cols[f] = p[f]
            cols["intensity"] = p["intensity"].astype(np.int32)
            b14, b15 = p["b14"].astype(np.int16), p["b15"].astype(np.int16)
            cols["user_data"], cols["point_source_ID"] = p["user"].astype(np.int16), p["source"].astype(np.int32)
            if i.kind == "POINT10":
                _split(cols, b14, b15)
                cols["scan_angle_rank"] = p["rank"]
            else:
                cols["extended_return_number"], cols["extended_number_of_returns"] = b14 & 15, b14 >> 4
                cols["extended_classification_flags"], cols["extended_scanner_channel"] = b15 & 15, b15 >> 4 & 3
                cols["scan_direction_flag"], cols["edge_of_flight_line"] = b15 >> 6 & 1, b15 >> 7 & 1
                cols["extended_classification"], cols["extended_scan_angle"] = p["cls"].astype(np.int16), p["angle"]
                cols["gps_time"] = p["gps"]
                _legacy(cols)
        elif i.kind == "GPSTIME11":
            cols["gps_time"] = p
        elif i.kind.startswith("RGB"):
            for k, f in enumerate(("red", "green", "blue", "nir")[: p.shape[1]]):
                cols[f] = p[:, k].astype(np.int32)
        else:
            cols["wave_packet" if i.kind.startswith("WAVE") else "extra_bytes"] = _blobs(p.tobytes(), i.size)
    return cols


def _blobs(raw: bytes, size: int) -> np.ndarray:
    out = np.empty(len(raw) // size, object)
    out[:] = [raw[k : k + size] for k in range(0, len(raw), size)]
    return out


def _split(cols: dict[str, np.ndarray], b14: np.ndarray, b15: np.ndarray) -> None:
    cols["return_number"], cols["number_of_returns"] = b14 & 7, b14 >> 3 & 7
    cols["scan_direction_flag"], cols["edge_of_flight_line"] = b14 >> 6 & 1, b14 >> 7 & 1
    cols["classification"] = b15 & 31
    for s, f in enumerate(("synthetic_flag", "keypoint_flag", "withheld_flag")):
        cols[f] = b15 >> 5 + s & 1


def _value_columns(items: list[Item], rows: list[list[list[int]]]) -> dict[str, np.ndarray]:
    """Columns from the values of decoded points."""
    cols: dict[str, np.ndarray] = {}
    for i, vs in zip(items, rows):
        if i.kind == "POINT10":
            a = np.array(vs, np.int64)
            for k, f in enumerate(("X", "Y", "Z", "intensity")):
                cols[f] = a[:, k].astype(np.int32)
            _split(cols, a[:, 4].astype(np.int16), a[:, 5].astype(np.int16))
            cols["scan_angle_rank"] = a[:, 6].astype(np.uint8).view(np.int8)
            cols["user_data"], cols["point_source_ID"] = a[:, 7].astype(np.int16), a[:, 8].astype(np.int32)
        elif i.kind == "POINT14":
            a = np.array(vs, np.int64)
            for k, f in enumerate(("X", "Y", "Z", "intensity")):
                cols[f] = a[:, k].astype(np.int32)
            names = ("extended_return_number", "extended_number_of_returns", "extended_classification_flags", "extended_scanner_channel",
                     "scan_direction_flag", "edge_of_flight_line", "extended_classification", "user_data", "extended_scan_angle")
            for k, f in enumerate(names):
                cols[f] = a[:, 4 + k].astype(np.int16)
            cols["point_source_ID"], cols["gps_time"] = a[:, 13].astype(np.int32), np.ascontiguousarray(a[:, 14]).view(np.float64)
            _legacy(cols)
        elif i.kind == "GPSTIME11":
            cols["gps_time"] = np.array(vs, np.int64)[:, 0].copy().view(np.float64)
        elif i.kind.startswith("RGB"):
            a = np.array(vs, np.int32)
            for k, f in enumerate(("red", "green", "blue", "nir")[: a.shape[1]]):
                cols[f] = a[:, k]
        else:
            raw = b"".join(values_raw(i, v) for v in vs)
            cols["wave_packet" if i.kind.startswith("WAVE") else "extra_bytes"] = _blobs(raw, i.size)
    return cols


def _layer_names(item: Item) -> tuple[str, ...]:
    return ("bytes",) * item.size if item.kind == "BYTE14" else LAYERED[item.kind].LAYERS


def _wanted(name: str, k: int, selective: int) -> bool:
    if name == "xy":
        return True
    if name == "bytes":
        # only the first sixteen bytes can be left out
        return k >= 16 or bool(selective >> 16 + k & 1)
    return bool(selective & SELECTIVE[name])


def decode_chunk(data, start: int, end: int, count: int, items: list[Item], layered: bool, selective: int = ALL_LAYERS) -> tuple[dict[str, np.ndarray], int]:
    """Columns of a chunk's ``count`` points and the position behind it; ``end`` bounds what may be read."""
    if count <= 0:
        return {}, start
    at, first = start, []
    for i in items:
        if at + i.size > end:
            raise LasDataError("a chunk ends inside its first point")
        first.append(raw_values(i, bytes(data[at : at + i.size])))
        at += i.size
    rows: list[list[list[int]]] = [[v] for v in first]
    if not layered:
        codecs = []
        for i, v in zip(items, first):
            if (i.kind, i.version) not in PLAIN:
                raise UnsupportedFormat(f"no codec for {i.kind} version {i.version}")
            codecs.append(PLAIN[i.kind, i.version](v))
        io = Reader(data, at, end)
        for _ in range(count - 1):
            for codec, out in zip(codecs, rows):
                out.append(codec.code(io, None))
        return _value_columns(items, rows), io.pos
    if at + 4 > end:
        raise LasDataError("a chunk ends before its layers")
    if (held := struct.unpack_from("<I", data, at)[0]) < count:
        raise LasDataError(f"a chunk of {held} points should hold {count}")
    at += 4
    sizes = []
    for i in items:
        n = len(_layer_names(i))
        if at + 4 * n > end:
            raise LasDataError("a chunk ends inside its layer sizes")
        sizes.append(struct.unpack_from(f"<{n}I", data, at))
        at += 4 * n
    if at + sum(map(sum, sizes)) > end:
        raise LasDataError("the layers of a chunk are larger than the chunk")
    codecs = []
    for i, lens in zip(items, sizes):
        layers = []
        for k, (name, size) in enumerate(zip(_layer_names(i), lens)):
            used = size and _wanted(name, k, selective)
            layers.append(Layer(Reader(data, at, at + size) if used else None))
            at += size
        # a version 2 of these items is another name of version 3
        codecs.append(LAYERED[i.kind](layers, 3 if i.version == 2 and i.kind != "WAVEPACKET14" else i.version))
    if count > 1 and not codecs[0].layers[0].on:
        raise LasDataError("a chunk has no coordinate layer")
    channel = 0
    for codec, v in zip(codecs, first):
        channel = codec.start(v, channel)
    for _ in range(count - 1):
        channel = 0
        for codec, out in zip(codecs, rows):
            v, channel = codec.code(None, channel)
            out.append(v)
    return _value_columns(items, rows), at


def encode_chunk(values: list[list[list[int]]], items: list[Item], layered: bool) -> bytes:
    """A chunk from the values of each item's points. The first point is stored raw and seeds the codecs."""
    first = [v[0] for v in values]
    out = [values_raw(i, v) for i, v in zip(items, first)]
    count = len(values[0])
    if not layered:
        io = Writer()
        codecs = [PLAIN[i.kind, i.version](v) for i, v in zip(items, first)]
        for k in range(1, count):
            for codec, vs in zip(codecs, values):
                codec.code(io, vs[k])
        return b"".join(out) + io.finish()
    codecs, channel = [], 0
    for i, v in zip(items, first):
        codec = LAYERED[i.kind]([Layer(Writer()) for _ in _layer_names(i)], i.version)
        channel = codec.start(v, channel)
        codecs.append(codec)
    for k in range(1, count):
        channel = 0
        for codec, vs in zip(codecs, values):
            _, channel = codec.code(vs[k], channel)
    bodies = [[layer.io.finish() if layer.changed or name == "xy" or name == "z" else b"" for name, layer in zip(_layer_names(i), c.layers)] for i, c in zip(items, codecs)]
    out.append(struct.pack("<I", count))
    out += [struct.pack(f"<{len(b)}I", *map(len, b)) for b in bodies]
    return b"".join(out) + b"".join(b for body in bodies for b in body)


class ChunkTable:
    """Where chunks lie: file positions ``starts`` (one more than chunks) and ordinals ``first`` likewise."""

    def __init__(self, starts: list[int], first: list[int]):
        self.starts, self.first = starts, first

    def chunk_of(self, point: int) -> int:
        return bisect_right(self.first, point) - 1


def read_table(read, start: int, size: int, chunk_size: int, count: int) -> tuple[ChunkTable | None, str | None]:
    """The chunk table of point data at ``start``; ``read(at, n)`` gives bytes of the file of ``size`` bytes.

    None with a warning if the table was never written or is damaged and chunks are of fixed size, so that
    they can be read one after the other. Adaptive chunks can't be found without it: that raises.
    """
    adaptive = chunk_size == ADAPTIVE
    chunks_at = start + 8
    try:
        at = struct.unpack("<q", read(start, 8))[0]
        if at == start:
            raise LasDataError("the chunk table was never written")
        if at == -1:
            at = struct.unpack("<q", read(size - 8, 8))[0]
        if not chunks_at <= at <= size - 8:
            raise LasDataError("the chunk table lies outside the file")
        raw = read(at, size - at)
        version, n = struct.unpack_from("<II", raw)
        if version != 0:
            raise LasDataError(f"unknown chunk table version {version}")
        if n > at - chunks_at:
            raise LasDataError("the chunk table lists more chunks than fit")
        starts, first = [chunks_at], [0]
        if n:
            io, ints = Reader(raw, 8), Ints(32, 2)
            points = length = 0
            for _ in range(n):
                if adaptive:
                    points = ints.code(io, points, None, 0)
                    if points < 0:
                        raise LasDataError("a chunk holds fewer than no points")
                length = ints.code(io, length, None, 1)
                if length <= 0:
                    raise LasDataError("a chunk has no bytes")
                starts.append(starts[-1] + length)
                first.append(first[-1] + points if adaptive else min(count, len(first) * chunk_size))
        if starts[-1] > at:
            raise LasDataError("chunks reach into the chunk table")
        if first[-1] < count:
            raise LasDataError("the chunks hold fewer points than the header says")
        return ChunkTable(starts, first), None
    except (LasDataError, struct.error) as e:
        if adaptive:
            raise LasDataError(f"adaptive chunks can't be found: {e}") from None
        return None, f"the chunk table is unusable ({e}); chunks are read in order"


def table_bytes(lengths: list[int], counts: list[int] | None) -> bytes:
    """A chunk table from chunk lengths, and counts if chunks are adaptive."""
    out = struct.pack("<II", 0, len(lengths))
    if lengths:
        io, ints = Writer(), Ints(32, 2)
        for k, n in enumerate(lengths):
            if counts is not None:
                ints.code(io, counts[k - 1] if k else 0, counts[k], 0)
            ints.code(io, lengths[k - 1] if k else 0, n, 1)
        out += io.finish()
    return out


def decode_sequential(data, start: int, end: int, count: int, items: list[Item], compressor: int, chunk_size: int, selective: int = ALL_LAYERS):
    """Yields (first ordinal, columns) chunk by chunk without a chunk table."""
    if compressor == POINTWISE:
        yield 0, decode_chunk(data, start, end, count, items, False, selective)[0]
        return
    at, done = start + 8, 0
    while done < count:
        n = min(chunk_size, count - done)
        cols, at = decode_chunk(data, at, end, n, items, compressor == LAYERED_CHUNKED, selective)
        yield done, cols
        done += n


def fixed_table(starts: list[int], end: int, chunk_size: int, count: int) -> ChunkTable:
    """The table of chunks of a fixed size whose starts are known; ``end`` is where the last one may reach."""
    return ChunkTable([*starts, end], [*range(0, count, chunk_size), count])


def _side_by_side(data, starts: list[int], ends: list[int], count: int, items: list[Item], keep: bool):
    firsts: list[list[list[int]]] = [[] for _ in items]
    for a in starts:
        for i, f in zip(items, firsts):
            f.append(raw_values(i, bytes(data[a : a + i.size])))
            a += i.size
    record = sum(i.size for i in items)
    at = np.array(starts, np.int64) + record
    return lanes.decode(np.frombuffer(data, np.uint8), [np.array(f, np.int64) for f in firsts], at, np.array(ends, np.int64), count, items, keep)


def decode_chunks(data, starts: list[int], ends: list[int], count: int, items: list[Item]) -> dict[str, np.ndarray] | None:
    """Columns of chunks of ``count`` points, decoded side by side, one after the other; None if one is damaged."""
    values, _, bad = _side_by_side(data, starts, ends, count, items, True)
    return None if bad.any() else _value_columns(items, [v.reshape(-1, v.shape[2]) for v in values])


def chunk_ends(data, starts: list[int], count: int, items: list[Item], layered: bool) -> list[int | None]:
    """Where chunks of ``count`` points would end that start at ``starts``; None where no chunk can be decoded."""
    out: list[int | None] = []
    while len(out) < len(starts):
        n = 0 if layered else lanes.lanes_for(items, count, len(starts) - len(out))
        if n:
            part = starts[len(out) : len(out) + n]
            _, pos, bad = _side_by_side(data, part, [len(data)] * n, count, items, False)
            out += [None if b else p for p, b in zip(pos.tolist(), bad.tolist())]
            continue
        try:
            out.append(decode_chunk(data, starts[len(out)], len(data), count, items, layered)[1])
        except (LasDataError, IndexError):
            out.append(None)
    return out


def encode_chunks(values: list[np.ndarray], items: list[Item]) -> list[bytes]:
    """Chunks of one size, coded side by side, from the values of each item (chunks, points, values)."""
    heads = [b"".join(values_raw(i, v[k, 0].tolist()) for i, v in zip(items, values)) for k in range(len(values[0]))]
    return [h + b for h, b in zip(heads, lanes.encode(values, items))]


def item_arrays(cols: dict[str, np.ndarray], items: list[Item], n: int) -> list:
    """Values of points for the codecs, from columns; missing columns are 0. Arrays (points, values), of bytes lists."""
    zero = np.zeros(n, np.int64)
    g = lambda c: np.asarray(cols[c]).astype(np.int64) if cols.get(c) is not None else zero
    out = []
    for i in items:
        if i.kind == "POINT10":
            b14 = g("return_number") & 7 | (g("number_of_returns") & 7) << 3 | (g("scan_direction_flag") & 1) << 6 | (g("edge_of_flight_line") & 1) << 7
            b15 = g("classification") & 31 | (g("synthetic_flag") & 1) << 5 | (g("keypoint_flag") & 1) << 6 | (g("withheld_flag") & 1) << 7
            parts = [g("X"), g("Y"), g("Z"), g("intensity") & 0xFFFF, b14, b15, g("scan_angle_rank") & 255, g("user_data") & 255, g("point_source_ID") & 0xFFFF]
            out.append(np.stack(parts, 1))
        elif i.kind == "POINT14":
            time = np.asarray(cols["gps_time"], np.float64) if cols.get("gps_time") is not None else np.zeros(n)
            parts = [
                g("X"), g("Y"), g("Z"), g("intensity") & 0xFFFF, g("extended_return_number") & 15, g("extended_number_of_returns") & 15,
                g("extended_classification_flags") & 15, g("extended_scanner_channel") & 3, g("scan_direction_flag") & 1, g("edge_of_flight_line") & 1,
                g("extended_classification") & 255, g("user_data") & 255, g("extended_scan_angle"), g("point_source_ID") & 0xFFFF,
                np.ascontiguousarray(time).view(np.int64),
            ]
            out.append(np.stack(parts, 1))
        elif i.kind == "GPSTIME11":
            time = np.asarray(cols["gps_time"], np.float64) if cols.get("gps_time") is not None else np.zeros(n)
            out.append(np.ascontiguousarray(time).view(np.int64)[:, None])
        elif i.kind.startswith("RGB"):
            out.append(np.stack([g(c) & 0xFFFF for c in ("red", "green", "blue", "nir")[: i.size // 2]], 1))
        else:
            blobs = cols.get("wave_packet" if i.kind.startswith("WAVE") else "extra_bytes")
            blank = bytes(i.size)
            got = [blank if blobs is None or b is None else bytes(b).ljust(i.size, b"\0")[: i.size] for b in (blobs if blobs is not None else [None] * n)]
            out.append([raw_values(i, b) for b in got])
    return out


def item_values(cols: dict[str, np.ndarray], items: list[Item], n: int) -> list[list[list[int]]]:
    return [v.tolist() if isinstance(v, np.ndarray) else v for v in item_arrays(cols, items, n)]


def raw_rule(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What a raw wide record keeps: the old class unless it is 0, the old three flags, and overlap from the new ones."""
    if "classification" not in cols:
        return cols
    zero = np.zeros(len(cols["X"]), np.int16)
    g = lambda c: np.asarray(cols[c]) if cols.get(c) is not None else zero
    cls, flags = g("classification"), g("extended_classification_flags")
    low = g("synthetic_flag") & 1 | (g("keypoint_flag") & 1) << 1 | (g("withheld_flag") & 1) << 2
    return cols | {"extended_classification": np.where(cls == 0, g("extended_classification"), cls), "extended_classification_flags": flags & 8 | low}


def raw_bytes(cols: dict[str, np.ndarray], items: list[Item], n: int) -> bytes:
    """Raw records of points."""
    a = np.zeros(n, raw_dtype(items))
    for i, vs in zip(items, item_values(raw_rule(cols) if items[0].kind == "POINT14" else cols, items, n)):
        a[i.kind] = np.frombuffer(b"".join(values_raw(i, v) for v in vs), a.dtype[i.kind]) if n else a[i.kind]
    return a.tobytes()
