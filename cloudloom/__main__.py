"""python -m cloudloom FILE [N]: what a point file holds, and its first N points (10)."""

from __future__ import annotations

import sys

from cloudloom.sources.las.entropy import LasDataError
from cloudloom.sources.las.file import LasFile


def report(path: str, n: int = 10) -> str:
    with LasFile(path) as f:
        facts = f.summary()
        rows = f.columns(count=n) if n else {}
        lines = [f"{k}: {v}" for k, v in facts.items()]
        scales, offsets = facts["scales"], facts["offsets"]
    for k in range(len(rows.get("X", ()))):
        at = [rows[a][k] * s + o for a, s, o in zip("XYZ", scales, offsets)]
        rest = {c: (v[k].hex() if isinstance(v[k], bytes) else v[k].item()) for c, v in rows.items() if c not in "XYZ"}
        lines.append(f"{k}: {' '.join(f'{v:.6g}' for v in at)} {rest}")
    return "\n".join(lines)


def main(args: list[str]) -> int:
    if not 1 <= len(args) <= 2:
        print(__doc__, file=sys.stderr)
        return 2
    try:
        print(report(args[0], int(args[1]) if len(args) > 1 else 10))
    except (LasDataError, OSError, ValueError) as e:
        print(f"{args[0]}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
