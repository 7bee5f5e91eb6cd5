"""Schemas that drift between records: a registry of versions, migrations between them, one table, and a report of every change.

Every readable dump (a JSON object) is parsed once into leaves (path, JSON type, value). Its layout, the paths with their types, is the same
for most dumps of a feed, so all that follows is worked out per layout and per pair of versions, and looked up by fingerprint:

- names: the header column a foreign path stands for is learned from all dumps. Its values must agree with that column of the
  file's header in at least ``MATCH`` of the cases, and at most a share of ``1 - MATCH`` of the dumps that hold it may hold the column too.
- registry (``registry``): per layout the shape, its leaves as (field, path, type), and the rules that lead to the header table: rename, default, cast.
  The fingerprint of the shape is the schema version.
- migrations (``migrations``): per pair of versions met one after the other in a feed the steps added, removed, renamed, retyped, stored once.
- ``changes`` follows every feed from version to version and takes the steps from there; ``conform`` routes every dump through the
  rules of its version, and says which values could not be cast.

How it scales: parsing is one pass; names are counted in the JVM, combined on the map side; feeds are folded after one shuffle by (feed, block of
sequence numbers) that carries shapes, not payloads. A feed longer than ``BLOCK`` dumps is folded in blocks; the states at their ends, one
small row a block, are chained so that every block starts from the state before it.

Defined cases: null, blank, cut and non-object payloads are unreadable and skipped; a dump sent again counts once per
dump_id; null feed, sequence number or dump_id leaves a dump out; a null value holds the field and keeps its
type; an empty object has no leaf; of two names for one field in a dump the column's own, else the first by name, is taken, and the
other stays a field of its own path; an empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.runtime import BROADCAST_ROWS, is_small, materialize

#: Share of comparable values that must agree for a name to stand for a column.
MATCH = 0.9
#: Sequence numbers of a feed that one task folds.
BLOCK = 4096
#: Columns of a header table that are not header fields, and those that say which dump a row is of.
NOT_FIELDS = ("file_id", "file_name", "received_at")
_LEAD = ("feed_id", "seq_no", "dump_id", "file_id")
#: The compressed flag in a format id.
FORMAT_FIELD, COMPRESSED_BIT = "point_data_format_id", 128
#: Header fields that are the same in every file, for dumps that leave them out (fixed values of the format).
DEFAULTS = {"file_signature": "LASF", "version_major": 1}

_WHOLE = re.compile(r"[+-]?[0-9]{1,400}")
_HEX = re.compile(r"0[xX][0-9a-fA-F]{1,300}")
_FRACTION = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,4})?")


def _small(df: DataFrame) -> DataFrame:
    """Marks a table for broadcast if it is small."""
    return F.broadcast(df) if is_small(df, BROADCAST_ROWS) else df


def _refuse(token: str):
    raise ValueError(token)


def parse(payload: str | None) -> dict | None:
    """The JSON object in ``payload``, or None if there is none."""
    if not payload:
        return None
    try:
        got = json.loads(payload, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def leaves(node: dict) -> dict[str, object]:
    """Values by dotted path; an array is one leaf."""
    out: dict[str, object] = {}
    stack = [("", node)]
    while stack:
        at, held = stack.pop()
        for k, v in held.items():
            path = at + k
            if isinstance(v, dict):
                stack.append((path + ".", v))
            else:
                out[path if path.isascii() else path.encode("utf-8", "replace").decode()] = v
    return out


def plain(value: object) -> str | None:
    """The value behind its spelling, as text: 4.0, "0004", "0x04" and [4] are 4."""
    if isinstance(value, str):
        text = value.strip()
        if _WHOLE.fullmatch(text):
            return str(int(text))
        if _HEX.fullmatch(text):
            return str(int(text, 16))
        return plain(float(text)) if _FRACTION.fullmatch(text) else text.encode("utf-8", "replace").decode()
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else repr(value)
    return plain(value[0]) if len(value) == 1 else _listed(value)


def _listed(value: list) -> str:
    """An array as JSON, its elements as the numbers they spell if all do."""
    each = [plain(v) if not isinstance(v, (list, dict)) else None for v in value]
    if all(p is not None and _WHOLE.fullmatch(p) for p in each):
        return "[" + ",".join(each) + "]"
    return json.dumps(value)


def _leaf(value: object) -> tuple[str | None, str | None, str | None]:
    """JSON type, plain value, and the value as text where that is something else."""
    if value is None:
        return None, None, None
    if isinstance(value, bool):
        return "boolean", None, json.dumps(value)
    if isinstance(value, int):
        return "integer", str(value), None
    if isinstance(value, float):
        return "number", plain(value), json.dumps(value)
    if isinstance(value, str):
        return "string", plain(value), value.encode("utf-8", "replace").decode()
    return "array", plain(value), _listed(value)


def fingerprint(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def _as_text(rows: object) -> str:
    return json.dumps(rows, ensure_ascii=False, separators=(",", ":"))


_STRINGS = pa.list_(pa.string())
_PARSED = pa.schema([("layout", pa.string()), ("paths", _STRINGS), ("kinds", _STRINGS), ("plains", _STRINGS), ("texts", _STRINGS)])


def parsed(dumps: DataFrame) -> DataFrame:
    """Readable dumps, once each, with their leaves: feed_id, seq_no, dump_id, file_id, layout (fingerprint of paths and types), paths, kinds, plains, texts."""
    lead = [F.col(c).cast("long") for c in _LEAD]
    once = dumps.select(*lead, F.col("payload").cast("string")).where("dump_id is not null and feed_id is not null and seq_no is not null and payload is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, str] = {}
        for b in batches:
            rows, readable = [], []
            for k, text in enumerate(b["payload"].to_pylist()):
                if (got := parse(text)) is None:
                    continue
                held = sorted(leaves(got).items())
                paths = tuple(p for p, _ in held)
                kinds, plains, texts = zip(*[_leaf(v) for _, v in held]) if held else ((), (), ())
                layout = known.get((paths, kinds))
                if layout is None:
                    if len(known) > 10_000:
                        known.clear()
                    layout = known[paths, kinds] = fingerprint(_as_text([paths, kinds]))
                readable.append(k)
                rows.append((layout, paths, kinds, plains, texts))
            if rows:
                own = [b[c].take(pa.array(readable)) for c in _LEAD]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, t) for c, t in zip(zip(*rows), _PARSED.types)]], names=[*_LEAD, *_PARSED.names])

    kinds = "feed_id long, seq_no long, dump_id long, file_id long, layout string, paths array<string>, kinds array<string>, plains array<string>, texts array<string>"
    return materialize(once.dropDuplicates(["dump_id"]).mapInArrow(run, kinds))


def header_fields(headers: DataFrame) -> list[str]:
    return [c for c in headers.columns if c not in (*NOT_FIELDS, *_LEAD)]


def _fact(column: Column, kind: T.DataType) -> tuple[Column, Column]:
    """A header value as the plain text and the number it may be compared as."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return column.cast("string"), column.cast("double")
    if isinstance(kind, T.ArrayType):
        listed = F.when(F.size(column) == 1, column[0].cast("string")).otherwise(F.concat(F.lit("["), F.array_join(column.cast("array<string>"), ","), F.lit("]")))
        return listed, F.lit(None).cast("double")
    if isinstance(kind, T.StringType):
        text = F.trim(column)
        return F.when(text.rlike("^[+-]?[0-9]{1,18}$"), text.try_cast("long").cast("string")).otherwise(text), F.lit(None).cast("double")
    return column.cast("string"), F.lit(None).cast("double")


def learn_names(read: DataFrame, layouts: DataFrame, headers: DataFrame) -> DataFrame:
    """Foreign paths and the header columns they stand for: path, field."""
    wanted = [f for f in headers.schema if f.name in header_fields(headers)]
    fields = [f.name for f in wanted]
    # under names of their own, whatever a header table may call its columns
    own = [f"__header_{k}" for k in range(len(wanted))]
    known = headers.where("file_id is not null").dropDuplicates(["file_id"]).select(F.col("file_id").cast("long"), *[F.col(f"`{f}`").alias(o) for f, o in zip(fields, own)])
    if is_small(known, BROADCAST_ROWS // 10):
        known = F.broadcast(known)
    foreign = read.select("file_id", F.explode(F.arrays_zip("paths", "plains")).alias("leaf")).select("file_id", F.col("leaf.paths").alias("path"), F.col("leaf.plains").alias("plain"))
    foreign = foreign.where(F.col("plain").isNotNull() & ~F.col("path").isin(fields))
    masked = F.when(F.col("plain").rlike("^[0-9]{1,9}$"), (F.col("plain").cast("int").bitwiseAND(F.lit(~COMPRESSED_BIT))).cast("string")).otherwise(F.col("plain"))
    facts = F.array(*[F.struct(F.lit(f.name).alias("field"), text.alias("text"), number.alias("number")) for f, o in zip(wanted, own) for text, number in [_fact(F.col(o), f.dataType)]])
    met = foreign.join(known, "file_id").select("path", "plain", masked.alias("masked"), F.expr("try_cast(plain as double)").alias("number"), F.explode(facts).alias("fact"))
    agrees = F.coalesce(
        F.when(F.col("fact.number").isNotNull(), F.col("number") == F.col("fact.number")).otherwise(F.col("fact.text") == F.when(F.col("fact.field") == FORMAT_FIELD, F.col("masked")).otherwise(F.col("plain"))), F.lit(False)
    )
    counted = met.where("fact.text is not null").groupBy("path", F.col("fact.field").alias("field")).agg(F.count(F.lit(1)).alias("seen"), F.count_if(agrees).alias("hits"))
    # which names stand side by side, from the layouts alone
    beside_ = F.filter("paths", lambda p: p.isin(fields))
    each = layouts.select("dumps", beside_.alias("own"), F.explode("paths").alias("path")).where(~F.col("path").isin(fields))
    holders = each.groupBy("path").agg(F.sum("dumps").alias("holders"))
    beside = each.select("dumps", "path", F.explode("own").alias("field")).groupBy("path", "field").agg(F.sum("dumps").alias("beside"))
    found = counted.where((F.col("hits") >= MATCH * F.col("seen")) & (F.col("hits") > 0)).join(holders, "path").join(beside, ["path", "field"], "left")
    # of several columns that fit, the one with most hits, then the one most like the name
    return found.where(F.coalesce("beside", F.lit(0)) <= (1 - MATCH) * F.col("holders")).groupBy("path").agg(
        F.max_by("field", F.struct(F.col("hits") / F.col("seen"), "hits", -F.levenshtein("path", "field"), "field")).alias("field")
    )


def settle(fields: frozenset[str], held: list[tuple[str, str | None, str | None]]) -> dict[str, tuple[int, str, str | None]]:
    """Which leaf of a layout (path, type, learned name) is which field: field -> (place, path, type)."""
    out: dict[str, tuple[int, str, str | None]] = {}
    for k, (path, kind, _) in enumerate(held):
        if path in fields:
            out[path] = (k, path, kind)
    for k, (path, kind, name) in enumerate(held):
        if path not in fields:
            out[name if name is not None and name not in out else path] = (k, path, kind)
    return out


_RULES = pa.schema(
    [("layout", pa.string()), ("fingerprint", pa.string()), ("shape", pa.string()), ("places", pa.list_(pa.int32())),
     ("rules", pa.list_(pa.struct([("rule", pa.string()), ("field", pa.string()), ("was", pa.string()), ("becomes", pa.string())])))]
)


def registry(read: DataFrame, headers: DataFrame) -> DataFrame:
    """Per layout: fingerprint, shape (JSON list of field, path, type), places of the header fields among the leaves, and the rules to the header table."""
    layouts = materialize(read.groupBy("layout").agg(F.count(F.lit(1)).alias("dumps"), F.any_value("paths").alias("paths"), F.any_value("kinds").alias("kinds")))
    names = materialize(learn_names(read, layouts, headers))
    wanted = [(f.name, f.dataType.simpleString()) for f in headers.schema if f.name in header_fields(headers)]
    fields = frozenset(f for f, _ in wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for layout, held in zip(b["layout"].to_pylist(), b["held"].to_pylist()):
                got = settle(fields, [(h["path"], h["kind"], h["field"]) for h in held if h["path"] is not None])
                shape = _as_text(sorted([f, path, kind] for f, (_, path, kind) in got.items()))
                rules = [("rename", f, got[f][1], f) for f, _ in wanted if f in got and got[f][1] != f]
                rules += [("default", f, None, None if f not in DEFAULTS else str(DEFAULTS[f])) for f, _ in wanted if f not in got]
                rules += [("cast", f, got[f][2], kind) for f, kind in wanted if f in got]
                rows.append((layout, fingerprint(shape), shape, [got[f][0] if f in got else -1 for f, _ in wanted], [dict(zip(("rule", "field", "was", "becomes"), r)) for r in rules]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _RULES.types)], schema=_RULES)

    leaf = layouts.select("layout", F.posexplode_outer(F.arrays_zip("paths", "kinds"))).select("layout", "pos", F.col("col.paths").alias("path"), F.col("col.kinds").alias("kind"))
    named = leaf.join(_small(names), "path", "left")
    # a layout has as many leaves as one dump
    held = named.groupBy("layout").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "kind", "field"))).alias("held"))
    return materialize(held.mapInArrow(run, "layout string, fingerprint string, shape string, places array<int>, rules array<struct<rule: string, field: string, was: string, becomes: string>>"))


State = dict[str, list]


def _load(shape: str) -> State:
    return {f: [p, t] for f, p, t in json.loads(shape)}


def _shape(state: State) -> str:
    return _as_text(sorted([f, p, t] for f, (p, t) in state.items()))


def _keep_types(state: State, new: State) -> State:
    """The new state, where a field without a type keeps the one it had."""
    return {f: [p, state[f][1] if t is None and f in state else t] for f, (p, t) in new.items()}


def migration(state: State, new: State) -> list[tuple[str, str]]:
    """Steps from one version to another: (field, change)."""
    steps = [(f, "removed") for f in state if f not in new]
    for f, (path, kind) in new.items():
        if f not in state:
            steps.append((f, "added"))
            continue
        was_path, was_kind = state[f]
        if path != was_path:
            steps.append((f, "renamed"))
        if kind is not None and was_kind is not None and kind != was_kind:
            steps.append((f, "retyped"))
    return sorted(steps)


_MOVES = pa.schema([("feed_id", pa.int64()), ("dump_id", pa.int64()), ("from_version", pa.string()), ("to_version", pa.string()), ("from_shape", pa.string()), ("to_shape", pa.string())])
_ENDS = pa.schema([("feed_id", pa.int64()), ("block", pa.int64()), ("state", pa.string())])


def _follow(ends: bool):
    """Follows dumps sorted by (feed, block, seq) from version to version. A row without dump_id brings the state before its block.

    Gives the moves between versions, or, with ``ends``, the state at the end of every block and the fields held all through it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, version, state, since = None, None, None, None, None
        reached: dict[tuple, tuple[str, State, str]] = {}
        for b in batches:
            out = []
            for feed, block, dump, shape in zip(*[b[c].to_pylist() for c in ("feed_id", "block", "dump_id", "shape")]):
                if (feed, block) != at:
                    if ends and state is not None:
                        out.append((*at, json.dumps([state, sorted(since)])))
                    at, last, version, state, since = (feed, block), None, None, None, None
                if shape == last:
                    continue
                last = shape
                step = reached.get((version, shape))
                if step is None:
                    if len(reached) > 10_000:
                        reached.clear()
                    new = _keep_types(state or {}, _load(shape))
                    text = _shape(new)
                    step = reached[version, shape] = (fingerprint(text), new, text)
                if state is None:
                    since = set(step[1])
                else:
                    since &= step[1].keys()
                    if not ends and step[0] != version:
                        out.append((feed, dump, version, step[0], _shape(state), step[2]))
                version, state = step[0], step[1]
            if out:
                yield _record(out, _ENDS if ends else _MOVES)
        if ends and state is not None:
            yield _record([(*at, json.dumps([state, sorted(since)]))], _ENDS)

    return run


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """From each block's own end state to the state before every later block of the feed."""
    out, before = [], None
    for feed, block, text in rows.sort_values("block")[["feed_id", "block", "state"]].itertuples(index=False):
        state, since = json.loads(text)
        if before is not None:
            out.append((feed, block, _shape(before)))
            for f in since:
                if state[f][1] is None and f in before:
                    state[f][1] = before[f][1]
        before = state
    return pd.DataFrame(out, columns=["feed_id", "block", "shape"])


def moves(read: DataFrame, versions: DataFrame, block: int = BLOCK) -> DataFrame:
    """Where a dump has another version than the one before it in its feed: feed_id, dump_id, from_version, to_version and both shapes."""
    shaped = read.select("feed_id", F.floor(F.col("seq_no") / block).alias("block"), "seq_no", "dump_id", "layout").join(_small(versions.select("layout", "shape")), "layout").drop("layout")
    if not read.where((F.col("seq_no") >= block) | (F.col("seq_no") < 0)).isEmpty():
        ended = shaped.repartition("feed_id", "block").sortWithinPartitions("feed_id", "block", "seq_no").mapInArrow(_follow(True), "feed_id long, block long, state string")
        before = ended.groupBy("feed_id").applyInPandas(_chain, "feed_id long, block long, shape string")
        shaped = shaped.unionByName(before.withColumns({"seq_no": F.lit(None).cast("long"), "dump_id": F.lit(None).cast("long")}))
    ordered = shaped.repartition("feed_id", "block").sortWithinPartitions("feed_id", "block", F.col("seq_no").asc_nulls_first())
    return materialize(ordered.mapInArrow(_follow(False), "feed_id long, dump_id long, from_version string, to_version string, from_shape string, to_shape string"))


def migrations(moved: DataFrame) -> DataFrame:
    """One row per step of each pair of versions met: from_version, to_version, step, field_name, change, old and new path and type, moves (how often it was taken)."""
    schema = pa.schema(
        [("from_version", pa.string()), ("to_version", pa.string()), ("moves", pa.int64()), ("step", pa.int32()), ("field_name", pa.string()), ("change", pa.string()),
         ("from_path", pa.string()), ("to_path", pa.string()), ("from_type", pa.string()), ("to_type", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for a, z, n, was, becomes in zip(*[b[c].to_pylist() for c in ("from_version", "to_version", "moves", "from_shape", "to_shape")]):
                old, new = _load(was), _load(becomes)
                for k, (f, change) in enumerate(migration(old, new)):
                    (op, ot), (np_, nt) = old.get(f, (None, None)), new.get(f, (None, None))
                    rows.append((a, z, n, k + 1, f, change, op, np_, ot, nt))
            if rows:
                yield _record(rows, schema)

    pairs = moved.groupBy("from_version", "to_version").agg(F.count(F.lit(1)).alias("moves"), F.any_value("from_shape").alias("from_shape"), F.any_value("to_shape").alias("to_shape"))
    return pairs.mapInArrow(
        run, "from_version string, to_version string, moves long, step int, field_name string, change string, from_path string, to_path string, from_type string, to_type string"
    )


def changes(dumps: DataFrame, headers: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per change: feed_id, dump_id, field_name, change (added, removed, renamed, retyped)."""
    read = parsed(dumps)
    moved = moves(read, registry(read, headers), block)
    steps = materialize(migrations(moved).select("from_version", "to_version", "field_name", "change"))
    return moved.select("feed_id", "dump_id", "from_version", "to_version").join(_small(steps), ["from_version", "to_version"]).select("feed_id", "dump_id", "field_name", "change")


def all_migrations(dumps: DataFrame, headers: DataFrame, block: int = BLOCK) -> DataFrame:
    """The stored migrations of a whole table of dumps."""
    read = parsed(dumps)
    return migrations(moves(read, registry(read, headers), block))


def versions(dumps: DataFrame, headers: DataFrame) -> DataFrame:
    """Schema versions as they came: per feed and fingerprint its first sequence number and dump, number of dumps, and the shape."""
    read = parsed(dumps)
    shaped = read.select("feed_id", "seq_no", "dump_id", "layout").join(_small(registry(read, headers).select("layout", "fingerprint", "shape")), "layout")
    return shaped.groupBy("feed_id", "fingerprint").agg(
        F.min("seq_no").alias("first_seq_no"), F.min_by("dump_id", F.struct("seq_no", "dump_id")).alias("first_dump_id"), F.count(F.lit(1)).alias("dumps"), F.min("shape").alias("shape")
    )


def rules(dumps: DataFrame, headers: DataFrame) -> DataFrame:
    """The rules of every version that lead to the header table, in the order they are taken: fingerprint, step, rule (rename, default, cast), field, was, becomes."""
    known = registry(parsed(dumps), headers).groupBy("fingerprint").agg(F.any_value("rules").alias("rules"))
    return known.select("fingerprint", F.posexplode("rules")).select("fingerprint", (F.col("pos") + 1).alias("step"), "col.*")


def _cast(text: Column, plain_: Column, field: str, kind: T.DataType) -> Column:
    """Cast rule of a column; what can't be cast is null."""
    if isinstance(kind, T.ArrayType):
        return F.when(text.startswith("["), F.from_json(text, f"array<{kind.elementType.simpleString()}>"))
    if isinstance(kind, T.StringType):
        return F.coalesce(text, plain_)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(plain_.rlike("^[+-]?[0-9.]"), plain_.try_cast(kind))
    whole = F.when(plain_.rlike("^[+-]?[0-9]+$"), plain_.try_cast("long"))
    if field == FORMAT_FIELD:
        whole = whole.bitwiseAND(F.lit(~COMPRESSED_BIT).cast("long"))
    return whole.try_cast(kind)


def conform(dumps: DataFrame, headers: DataFrame) -> DataFrame:
    """All readable dumps in the columns of the header table, each through the rename, default and cast rules of its version.

    Columns: feed_id, seq_no, dump_id, file_id, file_name (of the header, if the header table has it), the header fields, failed_casts (fields whose value
    could not be cast and is null), fingerprint, and received_at of the first arrival.
    """
    arrival = dumps.where("dump_id is not null").groupBy(F.col("dump_id").cast("long").alias("dump_id")).agg(F.min("received_at").alias("received_at"))
    read = parsed(dumps)
    known = registry(read, headers).select("layout", "fingerprint", "places")
    wanted = [f for f in headers.schema if f.name in header_fields(headers)]
    routed = read.join(_small(known), "layout")
    out, failed = [], []
    for k, f in enumerate(wanted):
        place = F.col("places")[k]
        held, text, plain_ = place >= 0, F.get("texts", place), F.get("plains", place)
        got = _cast(text, plain_, f.name, f.dataType)
        missing = F.lit(DEFAULTS.get(f.name)).cast(f.dataType)
        out.append(F.when(held, got).otherwise(missing).alias(f.name))
        failed.append(F.when(held & F.get("kinds", place).isNotNull() & got.isNull(), F.lit(f.name)))
    flat = routed.select(*_LEAD, *out, F.array_compact(F.array(*failed)).alias("failed_casts") if failed else F.array().cast("array<string>").alias("failed_casts"), "fingerprint")
    if "file_name" in headers.columns:
        names = headers.where("file_id is not null").groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.min("file_name").alias("file_name"))
        flat = flat.join(names, "file_id", "left")
    return flat.join(arrival, "dump_id")
