"""File headers, records behind them and behind the points, and the compression record."""

from __future__ import annotations

import struct
import warnings
from dataclasses import dataclass, field

from cloudloom.sources.las.entropy import LasDataError
from cloudloom.sources.las.formats import ITEM_CODES, NONE, POINTWISE_CHUNKED, Item, UnsupportedFormat, items_of

#: Header fields in file order (fixed by the format): name, struct code.
BASE = (
    ("file_signature", "4s"), ("file_source_id", "H"), ("global_encoding", "H"), ("project_id", "16s"), ("version_major", "B"), ("version_minor", "B"),
    ("system_identifier", "32s"), ("generating_software", "32s"), ("file_creation_day", "H"), ("file_creation_year", "H"), ("header_size", "H"),
    ("offset_to_point_data", "I"), ("number_of_variable_length_records", "I"), ("point_data_format_id", "B"), ("point_data_record_length", "H"),
    ("number_of_point_records", "I"), ("number_of_points_by_return", "5I"),
    *[(f"{a}_{k}", "d") for k in ("scale_factor", "offset") for a in "xyz"],
    *[(f"{k}_{a}", "d") for a in "xyz" for k in ("max", "min")],
)
MORE_13 = (("start_of_waveform_data_packet_record", "Q"),)
MORE_14 = (
    ("start_of_first_extended_variable_length_record", "Q"), ("number_of_extended_variable_length_records", "I"),
    ("extended_number_of_point_records", "Q"), ("extended_number_of_points_by_return", "15Q"),
)
RECORD = struct.Struct("<H16sHH32s")
LONG_RECORD = struct.Struct("<H16sHQ32s")
LASZIP = struct.Struct("<HHBBHIIqqH")
LASZIP_ITEM = struct.Struct("<HHH")
#: Keys (user, number) of records with a meaning here (fixed values).
COMPRESSION, EXTRA_BYTES, COMPATIBLE = ("laszip encoded", 22204), ("LASF_Spec", 4), ("lascompatible", 22204)
GEOKEYS, WKT, SPATIAL_INDEX = ("LASF_Projection", 34735), ("LASF_Projection", 2112), ("LAStools", 30)


def fields_of(minor: int) -> tuple[tuple[str, str], ...]:
    return BASE + (MORE_13 if minor >= 3 else ()) + (MORE_14 if minor >= 4 else ())


def size_of(minor: int) -> int:
    return struct.calcsize("<" + "".join(c for _, c in fields_of(minor)))


def text(raw: bytes) -> str:
    return raw.rstrip(b"\0").decode("latin-1")


def padded(value: str | bytes, size: int) -> bytes:
    raw = value.encode("latin-1") if isinstance(value, str) else value
    if len(raw) > size:
        raise ValueError(f"{value!r} is longer than {size} bytes")
    return raw.ljust(size, b"\0")


def unpack_fields(fields, raw: bytes, at: int = 0) -> dict:
    out = {}
    for name, code in fields:
        got = struct.unpack_from("<" + code, raw, at)
        at += struct.calcsize("<" + code)
        if code.endswith("s"):
            out[name] = got[0] if name in ("file_signature", "project_id") else text(got[0])
        else:
            out[name] = list(got) if len(code) > 1 else got[0]
    return out


def pack_fields(fields, values: dict) -> bytes:
    out = []
    for name, code in fields:
        v = values.get(name, 0)
        if code.endswith("s"):
            out.append(padded(v or b"", int(code[:-1])))
        elif len(code) > 1:
            n = int(code[:-1])
            out.append(struct.pack("<" + code, *([*(v or ()), *[0] * n][:n])))
        else:
            out.append(struct.pack("<" + code, v))
    return b"".join(out)


@dataclass(frozen=True)
class Vlr:
    user_id: str
    record_id: int
    data: bytes = b""
    description: str = ""

    @property
    def key(self) -> tuple[str, int]:
        return self.user_id, self.record_id


@dataclass
class Header:
    """A parsed header. ``fields`` has the values by name; counts and format are those of the points themselves."""

    fields: dict
    vlrs: list[Vlr] = field(default_factory=list)
    evlrs: list[Vlr] = field(default_factory=list)
    compressor: int = NONE
    chunk_size: int = 0
    items: list[Item] = field(default_factory=list)
    special: tuple[int, int] = (0, -1)
    user_data: bytes = b""
    user_data_after: bytes = b""
    warnings: list[str] = field(default_factory=list)
    compat: dict | None = None

    def __getattr__(self, name: str):
        try:
            return self.__dict__["fields"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def format(self) -> int:
        return self.fields["point_data_format_id"]

    @property
    def count(self) -> int:
        f = self.fields
        if f["version_minor"] >= 4 and not f["number_of_point_records"]:
            return f["extended_number_of_point_records"]
        return f["number_of_point_records"]

    @property
    def scales(self) -> tuple[float, float, float]:
        return tuple(self.fields[f"{a}_scale_factor"] for a in "xyz")

    @property
    def offsets(self) -> tuple[float, float, float]:
        return tuple(self.fields[f"{a}_offset"] for a in "xyz")

    def record(self, key: tuple[str, int], extended: bool = False) -> Vlr | None:
        return next((v for v in (self.evlrs if extended else self.vlrs) if v.key == key), None)


def parse_header(raw: bytes) -> Header:
    """Parses the bytes in front of the points (more may follow)."""
    if raw[:4] != b"LASF":
        raise LasDataError("no LAS signature")
    if len(raw) < size_of(2):
        raise LasDataError("the file ends inside its header")
    f = unpack_fields(BASE, raw)
    minor = f["version_minor"] if f["version_major"] == 1 else 0
    known = size_of(minor)
    if f["header_size"] < known or len(raw) < f["header_size"]:
        raise LasDataError(f"a header of {f['header_size']} bytes is too short")
    f = unpack_fields(fields_of(minor), raw)
    h = Header(f, user_data=raw[known : f["header_size"]])
    at = f["header_size"]
    start = f["offset_to_point_data"]
    if start < at or len(raw) < start:
        raise LasDataError("the file ends before its points")
    for _ in range(f["number_of_variable_length_records"]):
        if at + RECORD.size > start:
            raise LasDataError("records reach into the points")
        _, user, number, length, about = RECORD.unpack_from(raw, at)
        at += RECORD.size
        if at + length > start:
            raise LasDataError("a record reaches into the points")
        h.vlrs.append(Vlr(text(user), number, bytes(raw[at : at + length]), text(about)))
        at += length
    h.user_data_after = bytes(raw[at:start])
    packed = h.record(COMPRESSION)
    f["point_data_format_id"] &= 0x3F if packed else 0xFF
    if packed is None:
        h.items = items_of(h.format, f["point_data_record_length"])
    else:
        _compression(h, packed.data)
    return h


def _compression(h: Header, raw: bytes) -> None:
    if len(raw) < LASZIP.size:
        raise LasDataError("the compression record is too short")
    h.compressor, coder, _, _, _, _, h.chunk_size, specials, special_at, n = LASZIP.unpack_from(raw)
    h.special = (specials, special_at)
    if h.compressor == NONE or h.compressor > 3:
        raise UnsupportedFormat(f"unknown compressor {h.compressor}")
    if coder != 0:
        raise UnsupportedFormat(f"unknown coder {coder}")
    if n > 32 or len(raw) < LASZIP.size + n * LASZIP_ITEM.size:
        raise LasDataError("the compression record lists more items than it holds")
    names = {v: k for k, v in ITEM_CODES.items()}
    for i in range(n):
        code, size, version = LASZIP_ITEM.unpack_from(raw, LASZIP.size + i * LASZIP_ITEM.size)
        if code not in names:
            raise UnsupportedFormat(f"unknown item type {code}")
        h.items.append(Item(names[code], size, version))
    want = items_of(h.format, h.fields["point_data_record_length"])
    if [(i.kind, i.size) for i in h.items] != [(i.kind, i.size) for i in want]:
        raise LasDataError("the compressed items do not make up the point format")
    layered = h.compressor == 3
    if any((i.version in (3, 4)) != layered for i in h.items if i.kind != "WAVEPACKET13") and not all(i.version == 2 and layered for i in h.items):
        raise LasDataError("the item versions do not fit the container")


#: Bytes of a record behind the points that are read at once; longer payloads stay in the file until they are asked for.
EAGER = 1 << 20


@dataclass(frozen=True)
class FarVlr(Vlr):
    """A record behind the points whose payload is still in the file, ``length`` bytes at ``at``. ``LasFile.payload`` reads it."""

    at: int = 0
    length: int = 0


def parse_evlrs(h: Header, read, size: int) -> None:
    """Adds the records behind the points of a file of ``size`` bytes, header by header; ``read(at, n)`` gives bytes. A cut block keeps what is whole."""
    at = h.fields.get("start_of_first_extended_variable_length_record", 0)
    for _ in range(h.fields.get("number_of_extended_variable_length_records", 0)):
        if at + LONG_RECORD.size > size:
            h.warnings.append("the extended records are cut short")
            return
        _, user, number, length, about = LONG_RECORD.unpack(read(at, LONG_RECORD.size))
        at += LONG_RECORD.size
        if at + length > size:
            h.warnings.append("an extended record is cut short")
            return
        if length <= EAGER:
            h.evlrs.append(Vlr(text(user), number, read(at, length), text(about)))
        else:
            h.evlrs.append(FarVlr(text(user), number, b"", text(about), at, length))
        at += length


def pack_vlr(v: Vlr) -> bytes:
    if len(v.data) > 0xFFFF:
        raise ValueError(f"record {v.key} is longer than 65535 bytes")
    return RECORD.pack(0, padded(v.user_id, 16), v.record_id, len(v.data), padded(v.description, 32)) + v.data


def pack_evlr(v: Vlr) -> bytes:
    return LONG_RECORD.pack(0, padded(v.user_id, 16), v.record_id, len(v.data), padded(v.description, 32)) + v.data


def compression_record(compressor: int, items: list[Item], chunk_size: int, special: tuple[int, int] = (-1, -1)) -> Vlr:
    raw = LASZIP.pack(compressor, 0, 3, 4, 4, 0, chunk_size if compressor > 1 else ADAPTIVE_NONE, *special, len(items))
    raw += b"".join(LASZIP_ITEM.pack(ITEM_CODES[i.kind], i.size, i.version) for i in items)
    return Vlr(*COMPRESSION, raw, "compressed points")


ADAPTIVE_NONE = 0


def unique(records: list[Vlr]) -> list[Vlr]:
    """Records in order, without a compression record of their own; two of one key are refused."""
    kept = [v for v in records if v.key != COMPRESSION]
    if len({v.key for v in kept}) != len(kept):
        raise ValueError("two records have the same key")
    return kept


def warn(h: Header) -> None:
    for w in h.warnings:
        warnings.warn(w, stacklevel=3)


assert POINTWISE_CHUNKED == 2
