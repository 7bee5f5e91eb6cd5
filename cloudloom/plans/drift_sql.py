"""SQL equivalents of the schema drift queries."""

from __future__ import annotations

#: The header table (fixed by the file format): column and DuckDB type.
COLUMNS = {
    "file_signature": "VARCHAR", "file_source_id": "INTEGER", "global_encoding": "INTEGER", "version_major": "SMALLINT", "version_minor": "SMALLINT", "system_identifier": "VARCHAR",
    "generating_software": "VARCHAR", "file_creation_day": "INTEGER", "file_creation_year": "INTEGER", "header_size": "INTEGER", "offset_to_point_data": "BIGINT",
    "number_of_variable_length_records": "BIGINT", "point_data_format_id": "SMALLINT", "point_data_record_length": "INTEGER", "number_of_point_records": "BIGINT",
    "number_of_points_by_return": "BIGINT[]", "x_scale_factor": "DOUBLE", "y_scale_factor": "DOUBLE", "z_scale_factor": "DOUBLE", "x_offset": "DOUBLE", "y_offset": "DOUBLE",
    "z_offset": "DOUBLE", "max_x": "DOUBLE", "min_x": "DOUBLE", "max_y": "DOUBLE", "min_y": "DOUBLE", "max_z": "DOUBLE", "min_z": "DOUBLE",
}
_FIELDS = ", ".join(f"'{c}'" for c in COLUMNS)
_FACTS = " UNION ALL ".join(
    f"SELECT file_id, '{c}' AS field, {f"trim({c})" if k == "VARCHAR" else f"replace(CAST({c} AS VARCHAR), ' ', '')"} AS htext, TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) AS hnum FROM h" for c, k in COLUMNS.items()
)

#: Leaves of every readable dump under the names they stand for: field(dump_id, feed_id, seq_no, file_id, rn, field, path, kind, value, val, num).
HELD = f"""WITH once AS (SELECT DISTINCT ON (dump_id) dump_id, feed_id, CAST(seq_no AS BIGINT) AS seq_no, file_id, payload FROM header_dumps
  WHERE dump_id IS NOT NULL AND feed_id IS NOT NULL AND seq_no IS NOT NULL AND CASE WHEN json_valid(payload) THEN json_type(payload) END = 'OBJECT'),
dump AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY seq_no) AS rn FROM once),
leaf AS (SELECT d.dump_id, feed_id, seq_no, file_id, rn, replace(substr(t.fullkey, 3), '"', '') AS path, t.type, t.value FROM dump d, json_tree(d.payload) t
  WHERE t.type <> 'OBJECT' AND NOT regexp_matches(t.fullkey, '\\[[0-9]+\\]')),
typed AS (SELECT *, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'integer' WHEN type = 'DOUBLE' THEN 'number' WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'ARRAY' THEN 'array' END AS kind,
  CASE WHEN type IN ('BOOLEAN', 'NULL') THEN NULL WHEN type = 'ARRAY' AND json_array_length(value) = 1 THEN trim(value->>'$[0]') ELSE trim(value->>'$') END AS val FROM leaf),
spelt AS (SELECT *, CASE WHEN regexp_matches(val, '^0[xX][0-9a-fA-F]+$') THEN CAST(TRY_CAST(val AS BIGINT) AS DOUBLE) ELSE TRY_CAST(val AS DOUBLE) END AS num FROM typed),
h AS (SELECT DISTINCT ON (file_id) * FROM las_headers WHERE file_id IS NOT NULL),
facts AS (SELECT * FROM ({_FACTS}) WHERE htext IS NOT NULL),
met AS (SELECT path, field, count(*) AS seen, count(*) FILTER (WHERE CASE WHEN num IS NULL THEN val = htext
    WHEN field = 'point_data_format_id' AND num = floor(num) THEN CAST(CAST(num AS BIGINT) & ~128 AS DOUBLE) = hnum ELSE num = hnum END) AS hits
  FROM spelt JOIN facts USING (file_id) WHERE val IS NOT NULL AND path NOT IN ({_FIELDS}) GROUP BY ALL),
holders AS (SELECT path, count(*) AS holders FROM spelt GROUP BY path),
beside AS (SELECT a.path, b.path AS field, count(*) AS beside FROM spelt a JOIN spelt b USING (dump_id) WHERE a.path NOT IN ({_FIELDS}) AND b.path IN ({_FIELDS}) GROUP BY ALL),
names AS (SELECT path, field AS name FROM met JOIN holders USING (path) LEFT JOIN beside USING (path, field)
  WHERE hits >= 0.9 * seen AND hits > 0 AND coalesce(beside, 0) <= 0.1 * holders
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY hits / seen DESC, hits DESC, levenshtein(path, field), field DESC) = 1),
field AS (SELECT s.*, CASE WHEN s.path IN ({_FIELDS}) OR name IS NULL
    OR EXISTS (SELECT 1 FROM spelt o WHERE o.dump_id = s.dump_id AND o.path = name)
    OR EXISTS (SELECT 1 FROM spelt o JOIN names m ON o.path = m.path WHERE o.dump_id = s.dump_id AND m.name = n.name AND o.path < s.path) THEN s.path ELSE name END AS field
  FROM spelt s LEFT JOIN names n ON s.path = n.path),
state AS (SELECT *, coalesce(kind, last_value(kind IGNORE NULLS) OVER (PARTITION BY feed_id, field, island ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS full_kind FROM
  (SELECT *, rn - row_number() OVER (PARTITION BY feed_id, field ORDER BY rn) AS island FROM field)),
"""

FOUND = HELD + """step AS (SELECT *, lag(rn) OVER w AS was_rn, lag(path) OVER w AS was_path, lag(full_kind) OVER w AS was_kind, lead(rn) OVER w AS next_rn FROM state WINDOW w AS (PARTITION BY feed_id, field ORDER BY rn))
SELECT feed_id, dump_id, field AS field_name, 'added' AS change FROM step WHERE rn > 1 AND was_rn IS DISTINCT FROM rn - 1
UNION ALL SELECT feed_id, dump_id, field, 'renamed' FROM step WHERE was_rn = rn - 1 AND was_path <> path
UNION ALL SELECT feed_id, dump_id, field, 'retyped' FROM step WHERE was_rn = rn - 1 AND kind IS NOT NULL AND was_kind IS NOT NULL AND kind <> was_kind
UNION ALL SELECT s.feed_id, d.dump_id, s.field, 'removed' FROM step s JOIN dump d ON d.feed_id = s.feed_id AND d.rn = s.rn + 1 WHERE s.next_rn IS DISTINCT FROM s.rn + 1"""

_SHAPE = """shape AS (SELECT d.dump_id, any_value(d.feed_id) AS feed_id, any_value(d.seq_no) AS seq_no,
    '[' || coalesce(string_agg('["' || f.field || '","' || f.path || '",' || coalesce('"' || f.kind || '"', 'null') || ']', ',' ORDER BY f.field), '') || ']' AS shape
  FROM dump d LEFT JOIN field f USING (dump_id) GROUP BY d.dump_id)"""

VERSIONS = HELD + _SHAPE + """
SELECT feed_id, md5(shape) AS fingerprint, min(seq_no) AS first_seq_no, arg_min(dump_id, seq_no) AS first_dump_id, count(*) AS dumps, min(shape) AS shape FROM shape GROUP BY feed_id, shape"""

#: Shapes with types kept under nulls, and the steps between those that follow each other.
MIGRATIONS = HELD + """resolved AS (SELECT d.dump_id, any_value(d.feed_id) AS feed_id, any_value(d.rn) AS rn,
    '[' || coalesce(string_agg('["' || f.field || '","' || f.path || '",' || coalesce('"' || f.full_kind || '"', 'null') || ']', ',' ORDER BY f.field), '') || ']' AS shape
  FROM dump d LEFT JOIN state f USING (dump_id) GROUP BY d.dump_id),
move AS (SELECT a.dump_id AS a, b.dump_id AS b, md5(a.shape) AS from_version, md5(b.shape) AS to_version FROM resolved a JOIN resolved b ON a.feed_id = b.feed_id AND b.rn = a.rn + 1 WHERE a.shape <> b.shape),
pair AS (SELECT from_version, to_version, count(*) AS moves, min(a) AS a, arg_min(b, a) AS b FROM move GROUP BY ALL),
old AS (SELECT p.from_version, p.to_version, s.field, s.path, s.full_kind FROM pair p JOIN state s ON s.dump_id = p.a),
new AS (SELECT p.from_version, p.to_version, s.field, s.path, s.full_kind FROM pair p JOIN state s ON s.dump_id = p.b),
both_ AS (SELECT from_version, to_version, field, old.field IS NOT NULL AS was, new.field IS NOT NULL AS now, old.path AS from_path, new.path AS to_path, old.full_kind AS from_type, new.full_kind AS to_type
  FROM old FULL JOIN new USING (from_version, to_version, field)),
steps AS (SELECT *, unnest([CASE WHEN was AND NOT now THEN 'removed' END, CASE WHEN now AND NOT was THEN 'added' END, CASE WHEN was AND now AND from_path <> to_path THEN 'renamed' END,
  CASE WHEN was AND now AND from_type <> to_type THEN 'retyped' END]) AS change FROM both_)
SELECT from_version, to_version, moves, CAST(row_number() OVER (PARTITION BY from_version, to_version ORDER BY field, change) AS INTEGER) AS step, field AS field_name, change, from_path, to_path, from_type, to_type
FROM steps JOIN pair USING (from_version, to_version) WHERE change IS NOT NULL"""

_DEFAULTS = {"file_signature": "'LASF'", "version_major": "1"}


def _value(column: str, kind: str) -> str:
    if kind == "VARCHAR":
        got = "CASE WHEN kind IS NULL THEN NULL ELSE value->>'$' END"
    elif kind.endswith("[]"):
        got = f"CASE WHEN kind = 'array' THEN TRY_CAST(value AS {kind}) END"
    elif kind == "DOUBLE":
        got = "num"
    else:
        masked = "CAST(num AS BIGINT) & ~128" if column == "point_data_format_id" else "CAST(num AS BIGINT)"
        got = f"CASE WHEN num = floor(num) THEN TRY_CAST({masked} AS {kind}) END"
    held = f"any_value({got}) FILTER (WHERE field = '{column}')"
    return f"CASE WHEN bool_or(field = '{column}') THEN {held} ELSE {_DEFAULTS[column]} END AS {column}" if column in _DEFAULTS else f"{held} AS {column}"


_FAILED = "list_filter([" + ", ".join(f"CASE WHEN any_value(kind) FILTER (WHERE field = '{c}') IS NOT NULL AND {c} IS NULL THEN '{c}' END" for c in COLUMNS) + "], lambda x: x IS NOT NULL)"
HEADERS = HELD + _SHAPE + f""",
arrival AS (SELECT dump_id, min(received_at) AS first_at FROM header_dumps GROUP BY dump_id),
wide AS (SELECT d.dump_id, any_value(d.feed_id) AS feed_id, any_value(d.seq_no) AS seq_no, any_value(d.file_id) AS file_id, {", ".join(_value(c, k) for c, k in COLUMNS.items())},
  {_FAILED} AS failed_casts FROM dump d LEFT JOIN field f USING (dump_id) GROUP BY d.dump_id)
SELECT wide.*, h.file_name, md5(shape) AS fingerprint, epoch_us(first_at) AS received_us FROM wide JOIN arrival USING (dump_id) JOIN shape USING (dump_id) LEFT JOIN h ON h.file_id = wide.file_id"""

RULES = HELD + _SHAPE + f""",
version AS (SELECT md5(shape) AS fingerprint, min(dump_id) AS dump_id FROM shape GROUP BY shape),
wanted AS (SELECT unnest([{_FIELDS}]) AS field, unnest([{", ".join(str(k) for k in range(len(COLUMNS)))}]) AS place,
  unnest([{", ".join(repr({"VARCHAR": "string", "INTEGER": "int", "SMALLINT": "smallint", "BIGINT": "bigint", "DOUBLE": "double", "BIGINT[]": "array<bigint>"}[k]) for k in COLUMNS.values())}]) AS kind),
rule AS (SELECT v.fingerprint, w.place, w.field, w.kind AS target, f.path, f.kind, f.dump_id IS NOT NULL AS held FROM version v, wanted w LEFT JOIN field f ON f.dump_id = v.dump_id AND f.field = w.field),
every AS (SELECT fingerprint, 1 AS part, place, 'rename' AS rule, field, path AS was, field AS becomes FROM rule WHERE held AND path <> field
  UNION ALL SELECT fingerprint, 2, place, 'default', field, NULL, CASE field WHEN 'file_signature' THEN 'LASF' WHEN 'version_major' THEN '1' END FROM rule WHERE NOT held
  UNION ALL SELECT fingerprint, 3, place, 'cast', field, kind, target FROM rule WHERE held)
SELECT fingerprint, CAST(row_number() OVER (PARTITION BY fingerprint ORDER BY part, place) AS INTEGER) AS step, rule, field, was, becomes FROM every"""

SQL = {"p5_found": FOUND, "p5_headers": HEADERS, "p5_versions": VERSIONS, "p5_migrations": MIGRATIONS, "p5_rules": RULES}
