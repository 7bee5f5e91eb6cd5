"""The points of the checksum fixtures: 500 deterministic points per format."""

from __future__ import annotations

import struct

import numpy as np

from cloudloom.sources.las import container

N, CHUNK, EXTRA = 500, 137, 6


def _random():
    s = 2463534242
    while True:
        s ^= s << 13 & 0xFFFFFFFF
        s ^= s >> 17
        s ^= s << 5 & 0xFFFFFFFF
        yield s


def points(fmt: int, compat: bool = False, extra: int = EXTRA) -> dict[str, np.ndarray]:
    """Columns of the fixture of a format, as handed to a writer."""
    rnd = _random()
    x, y, z, gps, inten = 100000, 200000, 3000, 123456.789, 1000
    rows: dict[str, list] = {}

    def put(**kv):
        for k, v in kv.items():
            rows.setdefault(k, []).append(v)

    for i in range(N):
        x += next(rnd) % 41 - 20
        y += next(rnd) % 41 - 20
        z += next(rnd) % 11 - 5
        if i % 977 == 0:
            x, y, z = x + 50000, y - 30000, z + 400
        nret = 1 + i % 7
        inten = next(rnd) % 65536 if i % 13 == 0 else inten + 7 & 0xFFFF
        step = (i // 101) % 4
        if step == 1:
            gps += 0.0004
        elif step == 2:
            gps += 0.0004 * (1 + i % 23)
        elif step == 3:
            gps += 100000 + next(rnd) % 1000 if i % 307 == 0 else 0.0004
        put(X=x, Y=y, Z=z, intensity=inten, return_number=1 + i % nret, number_of_returns=nret, scan_direction_flag=i & 1, edge_of_flight_line=i >> 1 & 1)
        put(classification=i % 32, synthetic_flag=0, keypoint_flag=0, withheld_flag=0, scan_angle_rank=i % 61 - 30, user_data=i % 251, point_source_ID=i % 1009)
        put(gps_time=gps, red=i * 37 % 65536, green=(i * 37 % 65536) ^ (0 if i % 5 else 0x1234), blue=i * 91 % 65536, nir=i * 13 % 65536)
        r = 1 + i % 15
        put(extended_return_number=r, extended_number_of_returns=min(15, r + i % 3), extended_classification=i % 256, extended_classification_flags=i // 3 % 16)
        put(extended_scanner_channel=i // 7 % 4, extended_scan_angle=(i * 271) % 60001 - 30000 if compat else i % 8001 - 4000, extended_point_type=1)
        put(wave_packet=struct.pack("<BQIIIII", i % 5, i * 128, 128, i % 97, i % 31, i % 29, i % 23))
        put(extra_bytes=bytes(i * (b + 3) % 256 for b in range(extra)))
    out = {}
    for k, v in rows.items():
        if isinstance(v[0], bytes):
            out[k] = np.empty(N, object)
            out[k][:] = v
        else:
            out[k] = np.array(v, np.float64 if k == "gps_time" else np.int64)
    return out
