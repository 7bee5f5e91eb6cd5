"""Extra-byte attributes, coordinate systems, and wide points kept in old records (compatibility mode)."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.sources.las import header as H
from cloudloom.sources.las.container import angle_of, rank_of
from cloudloom.sources.las.formats import UnsupportedFormat, base_size, items_of

#: Descriptor of an attribute: reserved, type, options, name, unused, no data, min, max, scale, offset, description.
_ATTRIBUTE = struct.Struct("<HBB32s4s24s24s24s3d3d32s")
#: Widths and numpy types of attribute types 1 .. 10 (fixed values); 11 .. 30 are pairs and triples of them.
_TYPES = ("u1", "i1", "<u2", "<i2", "<u4", "<i4", "<u8", "<i8", "<f4", "<f8")
_HAS_SCALE, _HAS_OFFSET = 0x08, 0x10


@dataclass(frozen=True)
class Attribute:
    """An attribute in a point's extra bytes. ``start`` is where it begins; type 0 is opaque, ``size`` bytes wide."""

    name: str
    data_type: int
    start: int = 0
    size: int = 0
    description: str = ""
    scale: tuple[float, ...] | None = None
    offset: tuple[float, ...] | None = None

    @property
    def parts(self) -> int:
        return 1 + max(0, self.data_type - 1) // 10


def width_of(data_type: int, options: int = 0) -> int:
    if data_type == 0:
        return options
    if data_type > 30:
        raise UnsupportedFormat(f"unknown extra-bytes type {data_type}")
    return np.dtype(_TYPES[(data_type - 1) % 10]).itemsize * (1 + (data_type - 1) // 10)


def attributes(raw: bytes) -> list[Attribute]:
    """Attributes of an extra-bytes record, one behind the other."""
    out, start = [], 0
    for at in range(0, len(raw) - _ATTRIBUTE.size + 1, _ATTRIBUTE.size):
        _, kind, options, name, _, _, _, _, *nums, about = _ATTRIBUTE.unpack_from(raw, at)
        size = width_of(kind, options)
        n = 1 + max(0, kind - 1) // 10
        scale = tuple(nums[:n]) if kind and options & _HAS_SCALE else None
        offset = tuple(nums[3 : 3 + n]) if kind and options & _HAS_OFFSET else None
        out.append(Attribute(H.text(name), kind, start, size, H.text(about), scale, offset))
        start += size
    return out


def pack_attribute(a: Attribute) -> bytes:
    if a.data_type == 0:
        raise ValueError("an opaque attribute can't be described")
    width_of(a.data_type)
    options = (_HAS_SCALE if a.scale else 0) | (_HAS_OFFSET if a.offset else 0)
    three = lambda v: (*(v or ()), 0.0, 0.0, 0.0)[:3]
    blank = bytes(24)
    return _ATTRIBUTE.pack(0, a.data_type, options, H.padded(a.name, 32), bytes(4), blank, blank, blank, *three(a.scale), *three(a.offset), H.padded(a.description, 32))


def extra_bytes_record(attrs: list[Attribute], description: str = "") -> H.Vlr:
    """The record that describes extra bytes."""
    return H.Vlr(*H.EXTRA_BYTES, b"".join(map(pack_attribute, attrs)), description)


def decode_extra(points: DataFrame, attrs: list[Attribute], column: str = "extra_bytes") -> DataFrame:
    """Adds a typed column per attribute, scaled where the attribute says so; pairs and triples become arrays. Opaque ones are left."""
    typed = [a for a in attrs if a.data_type]
    if not typed:
        return points

    return points.withColumns({a.name: _typed(a)(F.col(column)) for a in typed})


def _typed(a: Attribute):
    dtype = np.dtype(_TYPES[(a.data_type - 1) % 10])
    moved = bool(a.scale or a.offset)
    # unsigned 64-bit values don't fit a long
    big = dtype == np.dtype("<u8") and not moved
    base = "decimal(20,0)" if big else "double" if moved or dtype.kind == "f" else "long"

    @F.pandas_udf(f"array<{base}>" if a.parts > 1 else base)
    def values(raw: pd.Series) -> pd.Series:
        out = []
        for b in raw:
            if b is None or len(b) < a.start + a.size:
                out.append(None)
                continue
            v = np.frombuffer(bytes(b), dtype, a.parts, a.start)
            if moved:
                v = v * np.array(a.scale or (1.0,) * a.parts) + np.array(a.offset or (0.0,) * a.parts)
            v = [Decimal(int(x)) for x in v] if big else v.tolist()
            out.append(v if a.parts > 1 else v[0])
        return pd.Series(out, dtype=object)

    return values


# -- coordinate systems

#: Keys of projected and geographic systems, and the codes they may have (fixed values).
_CRS_KEYS, _CODES = (3072, 2048), range(1024, 32767)


def read_crs(vlrs: list[H.Vlr], evlrs: list[H.Vlr] = ()) -> tuple[int | None, str | None]:
    """(EPSG code, WKT text) of the records: WKT first, then geokeys; what is damaged or unknown is None."""
    for records in (vlrs, evlrs):
        for v in records:
            if v.key == H.WKT:
                text = v.data.split(b"\0", 1)[0].decode("utf-8", "replace")
                if text.strip():
                    return None, text
    for records in (vlrs, evlrs):
        for v in records:
            if v.key == H.GEOKEYS and len(v.data) >= 8:
                n = struct.unpack_from("<4H", v.data)[3]
                if len(v.data) < 8 + 8 * n:
                    continue
                keys = {k: value for k, where, _, value in (struct.unpack_from("<4H", v.data, 8 + 8 * i) for i in range(n)) if where == 0}
                for k in _CRS_KEYS:
                    if keys.get(k) in _CODES:
                        return keys[k], None
    return None, None


def crs_record(crs: int | str, geographic: bool = False, description: str = "") -> H.Vlr:
    """A record for an EPSG code (geokeys) or a WKT text."""
    if isinstance(crs, str):
        return H.Vlr(*H.WKT, crs.encode() + b"\0", description)
    if crs not in _CODES:
        raise ValueError(f"{crs} is no EPSG code of a coordinate system")
    entries = [(1024, 0, 1, 2 if geographic else 1), (_CRS_KEYS[geographic], 0, 1, crs)]
    return H.Vlr(*H.GEOKEYS, struct.pack("<4H", 1, 1, 0, len(entries)) + b"".join(struct.pack("<4H", *e) for e in entries), description)


# -- compatibility mode

#: Names of the hidden fields (fixed values) with their attribute types.
_HIDDEN = (("LAS 1.4 scan angle", 4), ("LAS 1.4 extended returns", 1), ("LAS 1.4 classification", 1), ("LAS 1.4 flags and channel", 1))
_HIDDEN_NIR = ("LAS 1.4 NIR band", 3)
_RECORD_FIELDS = (("laszip_version", "H"), ("compatible_version", "H"), ("unused", "I")) + H.MORE_13 + H.MORE_14
_RECORD_SIZE = struct.calcsize("<" + "".join(c for _, c in _RECORD_FIELDS))
_STANDS_FOR_14 = 3
#: Old format -> the wide one it stands for, without and with a near-infrared band; and back.
_UP = {1: (6, 6), 3: (7, 8), 4: (9, 10), 5: (9, 10)}
DOWN = {6: 1, 7: 3, 8: 3, 9: 4, 10: 5}


def compat_layout(h: H.Header) -> dict[str, int] | None:
    """Where the hidden fields lie in the extra bytes, or None if the file is what it says it is."""
    f = h.fields
    if f["version_major"] != 1 or f["version_minor"] >= 4 or h.format not in _UP:
        return None
    rec, extra = h.record(H.COMPATIBLE), h.record(H.EXTRA_BYTES)
    if rec is None or extra is None or len(rec.data) < _RECORD_SIZE:
        return None
    if H.unpack_fields(_RECORD_FIELDS, rec.data)["compatible_version"] != _STANDS_FOR_14:
        return None
    starts = {a.name: a.start for a in attributes(extra.data)}
    if any(n not in starts for n, _ in _HIDDEN):
        return None
    out = {k: starts[n] for k, (n, _) in zip(("angle", "returns", "class", "flags"), _HIDDEN)}
    out["nir"] = starts.get(_HIDDEN_NIR[0], -1)
    return out


def upgrade(h: H.Header) -> None:
    """Turns the header of a file in compatibility mode into the one it stands for; ``h.compat`` then tells how to read its points."""
    layout = compat_layout(h)
    if layout is None:
        return
    f = h.fields
    extra = f["point_data_record_length"] - base_size(h.format)
    hidden = {n for n, _ in (*_HIDDEN, _HIDDEN_NIR)}
    raw = h.record(H.EXTRA_BYTES).data
    kept = b"".join(raw[k * 192 : k * 192 + 192] for k, a in enumerate(attributes(raw)) if a.name not in hidden)
    own = extra - 5 - 2 * (layout["nir"] >= 0)
    held = H.unpack_fields(_RECORD_FIELDS, h.record(H.COMPATIBLE).data)
    f |= {n: held[n] for n, _ in H.MORE_14} | {"start_of_waveform_data_packet_record": 0}
    f["start_of_first_extended_variable_length_record"] = f["number_of_extended_variable_length_records"] = 0
    vlrs = [v for v in h.vlrs if v.key not in (H.COMPATIBLE, H.EXTRA_BYTES)]
    if kept:
        vlrs.append(H.Vlr(*H.EXTRA_BYTES, kept, h.record(H.EXTRA_BYTES).description))
    f["number_of_variable_length_records"] -= len(h.vlrs) - len(vlrs)
    h.compat = {"layout": layout, "own": own, "items": h.items, "offset": f["offset_to_point_data"]}
    h.vlrs = vlrs
    grew = H.size_of(4) - H.size_of(f["version_minor"])
    f["header_size"] += grew
    f["offset_to_point_data"] += grew
    f["version_minor"] = 4
    if h.record(H.WKT):
        f["global_encoding"] |= 16
    f["point_data_format_id"] = _UP[h.format][layout["nir"] >= 0]
    f["point_data_record_length"] = base_size(f["point_data_format_id"]) + own
    h.items = items_of(f["point_data_format_id"], f["point_data_record_length"])


def unfold(cols: dict[str, np.ndarray], layout: dict[str, int], own: int) -> dict[str, np.ndarray]:
    """Columns of the wide points hidden in old ones: narrow values plus what the extra bytes add."""
    n = len(cols["X"])
    raw = np.frombuffer(b"".join(cols["extra_bytes"]), np.uint8).reshape(n, -1) if n else np.zeros((0, 64), np.uint8)
    two = lambda at: np.ascontiguousarray(raw[:, at : at + 2])
    more, flags = raw[:, layout["returns"]].astype(np.int16), raw[:, layout["flags"]].astype(np.int16)
    out = dict(cols)
    out["extended_scan_angle"] = (two(layout["angle"]).view("<i2")[:, 0].astype(np.int32) + angle_of(cols["scan_angle_rank"])).astype(np.int16)
    out["extended_return_number"] = (more >> 4) + cols["return_number"] & 15
    out["extended_number_of_returns"] = (more & 15) + cols["number_of_returns"] & 15
    out["extended_classification"] = raw[:, layout["class"]].astype(np.int16) + cols["classification"] & 255
    out["extended_scanner_channel"] = flags >> 1 & 3
    out["extended_classification_flags"] = (flags & 1) << 3 | cols["withheld_flag"] << 2 | cols["keypoint_flag"] << 1 | cols["synthetic_flag"]
    out["extended_point_type"] = np.ones(n, np.int16)
    if layout["nir"] >= 0:
        out["nir"] = two(layout["nir"]).view("<u2")[:, 0].astype(np.int32)
    if own:
        blobs = np.empty(n, object)
        blobs[:] = [b[:own] for b in cols["extra_bytes"]]
        out["extra_bytes"] = blobs
    else:
        out.pop("extra_bytes", None)
    return out


def fold(cols: dict[str, np.ndarray], nir: bool, own: int) -> dict[str, np.ndarray]:
    """The opposite: old columns and extra bytes (``own`` bytes of the caller's first) from wide ones."""
    n = len(cols["X"])
    zero = np.zeros(n, np.int64)
    g = lambda c: np.asarray(cols[c]).astype(np.int64) if cols.get(c) is not None else zero
    out = dict(cols)
    angle, r, cnt, cls = g("extended_scan_angle"), g("extended_return_number"), g("extended_number_of_returns"), g("extended_classification")
    rank = np.clip(np.trunc(np.where(angle >= 0, (np.float32(0.006) * angle.astype(np.float32)).astype(np.float64) + 0.5, (np.float32(0.006) * angle.astype(np.float32)).astype(np.float64) - 0.5)), -128, 127).astype(np.int8)
    out["scan_angle_rank"] = rank
    # beyond seven returns the last four keep their distance from the end, those between count as the fourth
    many = np.where(r <= 4, r, np.where(r >= cnt - 3, r - (cnt - 7), 4))
    number = np.where(cnt <= 7, r, many)
    count = np.minimum(cnt, 7)
    out["return_number"], out["number_of_returns"] = number, count
    narrow = np.where(cls <= 31, cls, 0)
    out["classification"] = narrow
    # the old record keeps three of the four class flags
    flags = g("extended_classification_flags")
    for k, f in enumerate(("synthetic_flag", "keypoint_flag", "withheld_flag")):
        out[f] = flags >> k & 1
    hidden = [
        (angle - angle_of(rank)).astype("<i2").view(np.uint8).reshape(n, 2),
        ((r - number) << 4 | (cnt - count)).astype(np.uint8)[:, None],
        (cls - narrow).astype(np.uint8)[:, None],
        (flags >> 3 & 1 | (g("extended_scanner_channel") & 3) << 1).astype(np.uint8)[:, None],
    ]
    if nir:
        hidden.append(g("nir").astype("<u2").view(np.uint8).reshape(n, 2))
    tail = np.concatenate(hidden, 1).tobytes()
    size = len(tail) // n if n else 0
    mine = cols.get("extra_bytes")
    blobs = np.empty(n, object)
    blobs[:] = [(b"" if mine is None or mine[k] is None else bytes(mine[k])).ljust(own, b"\0")[:own] + tail[k * size : k * size + size] for k in range(n)]
    out["extra_bytes"] = blobs
    return out


def disguise(fmt: int, own: int, described: bytes | None) -> tuple[H.Vlr, int]:
    """The extra-bytes record of a file in compatibility mode, and how many extra bytes its points have."""
    first = described if described is not None else b"".join(pack_attribute(Attribute(f"unknown {i}", 1, description=f"unknown {i}")) for i in range(own))
    hidden = [Attribute(n, k, description="additional attributes", scale=(0.006,) if k == 4 else None) for n, k in _HIDDEN]
    if fmt in (8, 10):
        hidden.append(Attribute(*_HIDDEN_NIR, description="additional attributes"))
    raw = first + b"".join(map(pack_attribute, hidden))
    return H.Vlr(*H.EXTRA_BYTES, raw), sum(a.size for a in attributes(raw))


def compat_record(count: int = 0, by_return: list[int] | None = None) -> H.Vlr:
    """The record with the header fields an old header has no room for."""
    values = {"laszip_version": 0, "compatible_version": _STANDS_FOR_14, "extended_number_of_point_records": count, "extended_number_of_points_by_return": by_return or []}
    return H.Vlr(*H.COMPATIBLE, H.pack_fields(_RECORD_FIELDS, values))


__all__ = ["Attribute", "attributes", "compat_layout", "crs_record", "decode_extra", "disguise", "extra_bytes_record", "fold", "rank_of", "read_crs", "unfold", "upgrade"]
