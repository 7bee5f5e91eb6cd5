"""The scalar functions as SQL functions of the session. They are plain SQL, so Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cloudloom.functions.bits import PACKED

_BODIES = {
    "scale_coordinate(raw INT, factor DOUBLE, offset_ DOUBLE)": ("DOUBLE", "CAST(raw AS DOUBLE) * factor + offset_"),
    "quantize_coordinate(value DOUBLE, factor DOUBLE, offset_ DOUBLE)": (
        "INT",
        "CAST(CASE WHEN (value - offset_) / factor >= 0 THEN (value - offset_) / factor + 0.5D ELSE (value - offset_) / factor - 0.5D END AS INT)",
    ),
    "in_rect(x DOUBLE, y DOUBLE, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE)": ("BOOLEAN", "x >= min_x AND x < max_x AND y >= min_y AND y < max_y"),
    "in_circle(x DOUBLE, y DOUBLE, cx DOUBLE, cy DOUBLE, r DOUBLE)": ("BOOLEAN", "r > 0 AND (x - cx) * (x - cx) + (y - cy) * (y - cy) < r * r"),
    "chunk_of(i BIGINT, size BIGINT)": ("BIGINT", "i DIV size"),
    "legacy_return_number(r INT, n INT)": ("INT", "CASE WHEN n > 7 AND r > 6 THEN CASE WHEN r >= n THEN 7 ELSE 6 END ELSE r END"),
    "legacy_number_of_returns(n INT)": ("INT", "least(n, 7)"),
    "legacy_class_byte(flags INT, class INT)": ("INT", "(shiftleft(flags, 5) & 224) | CASE WHEN class < 32 THEN class ELSE 0 END"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Registers the functions in the session and gives their names; ``unpack_<field>`` takes a packed byte apart."""
    bodies = dict(_BODIES)
    for f, (_, shift, mask) in PACKED.items():
        bodies[f"unpack_{f}(b INT)"] = ("INT", f"shiftright(b, {shift}) & {mask}")
    for head, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head in bodies]
