"""Implausible readings per source: robust decomposition, generalised ESD limits, run and range checks.

Readings of a source are taken per file in ``point_index`` order. Each series is split into a trend
(running median), a seasonal part where there is one (``deseason``) and a residual. Residuals are judged per
source: its usual scatter is ``1.4826 * median(|residual|)``, at least ``min_scatter``, and the generalised extreme
studentised deviate test with that robust scale gives the limit from which residuals are outliers. An outlier is
also a spike if it exceeds ``spike_scatters`` usual scatters. Stuck runs and impossible values have their own checks.

How it scales: one shuffle by (source, file); every task decomposes whole series in vectors as they
stream past. The per-source median and the ESD ranks come from a histogram of residuals, combined on the
map side, so a source with a third of all rows costs no more than any other; ranking it is one task per source
and field, over as many rows as there are different residuals. A series of more than ``split_rows`` rows is cut into
blocks of ordinals, field by field. A block carries the few readings its windows reach over to, and of the runs
that come in from the left only (value, length): what a block hands on never grows with the run (``_carried``).
So rows moved stay in proportion to rows read even where a series is constant, and no result depends on the cut.

Defined cases: a null reading or source is left out; rows sent again (same file_id and point_index)
count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.runtime import BROADCAST_ROWS, is_small, materialize

#: Physical limits of each field, both inside: (field, lowest, highest).
RANGES = (("Z", -50_000, 900_000), ("intensity", 0, 65_535))

IMPOSSIBLE, STUCK = 1, 2

#: Cycles a phase must have been seen for its seasonal part to count, and standard errors of a median it must reach.
CYCLES, SEASON_ERRORS = 8, 5.0
#: Standard error of a median of n normal readings, in scatters / sqrt(n).
_MEDIAN_ERROR = 1.2533

_DECOMPOSED = pa.schema([("source", pa.int32()), ("file_id", pa.int64()), ("field", pa.int8()), ("phase", pa.int32()), ("twice", pa.int64()), ("flags", pa.int8()), ("point_id", pa.int64())])
_DECOMPOSED_SQL = "source int, file_id long, field byte, phase int, twice long, flags byte, point_id long"
_CHUNK = 1 << 17


def running_median(v: np.ndarray, first: np.ndarray, last: np.ndarray, half: int) -> np.ndarray:
    """Twice the median of the readings up to ``half`` before and after each one, within its series.

    ``first`` and ``last`` hold, per reading, the bounds of its series. Twice, so that it stays integer.
    """
    n = len(v)
    at = np.arange(n)
    pad = np.full(half, np.iinfo(np.int64).max)
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, v, pad]), 2 * half + 1)
    out = np.empty(n, np.int64)
    whole = (at - half >= first) & (at + half <= last)
    out[whole] = 2 * np.partition(wide[whole], half, axis=1)[:, half]
    edge = np.flatnonzero(~whole)
    if len(edge):
        off = np.arange(-half, half + 1)
        pos = edge[:, None] + off
        inside = (pos >= first[edge][:, None]) & (pos <= last[edge][:, None])
        part = np.sort(np.where(inside, wide[edge], np.iinfo(np.int64).max), axis=1)
        m = inside.sum(1)
        rows = np.arange(len(edge))
        out[edge] = part[rows, (m - 1) // 2] + part[rows, m // 2]
    return out


def stuck_runs(v: np.ndarray, series: np.ndarray, length: int, tolerance: int) -> np.ndarray:
    """Marks readings in a run of at least ``length`` consecutive ones, all within ``tolerance`` of the run's first."""
    n = len(v)
    marked = np.zeros(n, bool)
    if n < length:
        return marked
    ok = np.ones(n - length + 1, bool)
    for k in range(1, length):
        ok &= np.abs(v[k : n - length + 1 + k] - v[: n - length + 1]) <= tolerance
    ok &= series[length - 1 :] == series[: n - length + 1]
    starts = np.flatnonzero(ok)
    if not len(starts):
        return marked
    order = np.argsort(v, kind="stable")
    ranked = v[order]
    delta = np.zeros(n + 1, np.int32)
    # all readings near a level f, cut where neighbours are missing: a run from any reading equal to f ends with its piece
    for f in np.unique(v[starts]):
        near = np.sort(order[np.searchsorted(ranked, f - tolerance) : np.searchsorted(ranked, f + tolerance, "right")])
        cut = np.flatnonzero((np.diff(near) != 1) | (np.diff(series[near]) != 0)) + 1
        piece = np.zeros(len(near), np.int64)
        piece[cut] = 1
        piece = np.cumsum(piece)
        ends = near[np.append(cut - 1, len(near) - 1)]
        hits = np.flatnonzero(v[near] == f)
        which, at = np.unique(piece[hits], return_index=True)
        begin, end = near[hits[at]], ends[which]
        long_enough = end - begin + 1 >= length
        np.add.at(delta, begin[long_enough], 1)
        np.add.at(delta, end[long_enough] + 1, -1)
    return np.cumsum(delta[:-1]) > 0


def _bounds(series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of the series each reading belongs to."""
    edge = np.flatnonzero(np.append(True, np.diff(series) != 0))
    size = np.diff(np.append(edge, len(series)))
    return np.repeat(edge, size), np.repeat(edge + size - 1, size)


def _new_keys(t: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    new = np.ones(t.num_rows, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in (t[c].to_numpy() for c in names)], axis=0)
    return new


def _whole_groups(judge, names: tuple[str, ...]):
    """Hands whole groups of rows sorted by ``names`` to ``judge``, some ``_CHUNK`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < _CHUNK:
                continue
            t = pa.Table.from_batches(held)
            whole = int(np.flatnonzero(_new_keys(t, names))[-1])
            if whole:
                if (r := judge(t.slice(0, whole))) is not None:
                    yield r
                t = t.slice(whole)
            held, rows = t.to_batches(), t.num_rows
        if rows and (r := judge(pa.Table.from_batches(held))) is not None:
            yield r

    return run


def _batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch | None:
    if not parts:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*parts), _DECOMPOSED.types)], schema=_DECOMPOSED)


def _judge_series(ranges, half: int, run_length: int, tolerance: int, period: int):
    """Whole series, all fields in one row each."""

    def judge(t: pa.Table) -> pa.RecordBatch | None:
        source, file, index, pid = (t[c].to_numpy() for c in ("source", "file_id", "point_index", "point_id"))
        new = _new_keys(t, ("source", "file_id"))
        again = np.zeros(len(source), bool)
        again[1:] = ~new[1:] & (index[1:] == index[:-1])
        series = np.cumsum(new)
        out = []
        for code, (name, low, high) in enumerate(ranges):
            keep = ~again & ~np.asarray(t[name].is_null())
            if not keep.any():
                continue
            v = t[name].filter(pa.array(keep)).to_numpy().astype(np.int64)
            s = series[keep]
            first, last = _bounds(s)
            twice = 2 * v - running_median(v, first, last, half)
            flags = ((v < low) | (v > high)).astype(np.int8) * IMPOSSIBLE
            flags |= stuck_runs(v, s, run_length, tolerance).astype(np.int8) * STUCK
            phase = (np.arange(len(v)) - first) % max(1, period)
            out.append([source[keep], file[keep], np.full(len(v), code, np.int8), phase, twice, flags, pid[keep]])
        return _batch(out)

    return judge


_BLOCK_KEY = ("source", "file_id", "field", "block")


def _judge_blocks(ranges, half: int, run_length: int, tolerance: int, period: int):
    """Blocks of one field of a long series; rows with a negative ordinal bring runs that come in: (value, length)."""
    lows, highs = (np.array([r[k] for r in ranges], np.int64) for k in (1, 2))

    def judge(t: pa.Table) -> pa.RecordBatch | None:
        series = np.cumsum(_new_keys(t, _BLOCK_KEY))
        ordinal, value, length = (t[c].to_numpy() for c in ("ordinal", "v", "length"))
        incoming = ordinal < 0
        carried = list(zip(series[incoming], value[incoming], length[incoming]))
        real = ~incoming
        source, file, field, pid, home = (t[c].filter(pa.array(real)).to_numpy(zero_copy_only=False) for c in ("source", "file_id", "field", "point_id", "home"))
        v, s, at = value[real].astype(np.int64), series[real], ordinal[real]
        if not len(v):
            return None
        first, last = _bounds(s)
        twice = 2 * v - running_median(v, first, last, half)
        stuck = stuck_runs(v, s, run_length, tolerance)
        for which, x, before in carried:
            begin, end = np.searchsorted(s, which), np.searchsorted(s, which, "right")
            begin += int(np.argmax(home[begin:end])) if begin < end and home[begin:end].any() else end - begin
            away = np.abs(v[begin:end] - x) > tolerance
            stop = begin + (int(np.argmax(away)) if away.any() else end - begin)
            if before + stop - begin >= run_length:
                stuck[begin:stop] = True
        flags = ((v < lows[field]) | (v > highs[field])).astype(np.int8) * IMPOSSIBLE | stuck.astype(np.int8) * STUCK
        home = home.astype(bool)
        return _batch([[c[home] for c in (source, file, field, at % max(1, period), twice, flags, pid)]])

    return judge


_SUMMARY = pa.schema([("source", pa.int32()), ("file_id", pa.int64()), ("field", pa.int8()), ("block", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("values", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
_SUMMARY_SQL = "source int, file_id long, field byte, block long, n long, low long, high long, values array<long>, lengths array<long>"


def _summarise(tolerance: int):
    """One row per block: its size and range, and the runs still open at its end as (value, length), at most 2 * tolerance + 1."""

    def judge(t: pa.Table) -> pa.RecordBatch:
        edges = np.append(np.flatnonzero(_new_keys(t, _BLOCK_KEY)), t.num_rows)
        keys, value = [t[c].to_numpy() for c in _BLOCK_KEY], t["v"].to_numpy().astype(np.int64)
        rows = []
        for a, b in zip(edges[:-1], edges[1:]):
            v = value[a:b]
            least, most = np.minimum.accumulate(v[::-1])[::-1], np.maximum.accumulate(v[::-1])[::-1]
            open_ = np.flatnonzero((most - v <= tolerance) & (v - least <= tolerance))
            x, at = np.unique(v[open_], return_index=True)
            rows.append((*(k[a] for k in keys), b - a, least[0], most[0], x, b - a - open_[at]))
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), _SUMMARY.types)], schema=_SUMMARY)

    return judge


def _carried(tolerance: int):
    """Chains the summaries of a series: which runs come into each block, one row each."""

    def chain(blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        open_: dict[int, int] = {}
        for r in blocks.sort_values("block").itertuples(index=False):
            out += [(r.source, r.file_id, r.field, r.block, x, n) for x, n in open_.items()]
            through = {x: n + r.n for x, n in open_.items() if r.low >= x - tolerance and r.high <= x + tolerance}
            open_ = {int(x): int(n) for x, n in zip(r.values, r.lengths)} | through
        return pd.DataFrame(out, columns=["source", "file_id", "field", "block", "v", "length"])

    return chain


def _ordinals(rows: DataFrame, key: list[str], bucket: int) -> DataFrame:
    """Adds the place of each row in its series by ``point_index``, counted bucket by bucket so that no task gets a whole series."""
    cut = rows.withColumn("bucket", F.floor(F.col("point_index") / bucket))
    counts = cut.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*key, "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("point_index"))
    return cut.withColumn("inside", inside).join(counts, [*key, "bucket"]).withColumn("ordinal", F.col("before") + F.col("inside") - 1).drop("bucket", "inside", "before")


def _decompose_long(heavy: DataFrame, ranges, half: int, run_length: int, tolerance: int, period: int, block: int) -> DataFrame:
    """The same as ``_judge_series`` for series that are cut into blocks."""
    key = ["source", "file_id", "field"]
    right = max(half, run_length - 1)
    block = max(block, right, half)
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("byte").alias("field"), F.col(r[0]).cast("long").alias("v")) for k, r in enumerate(ranges)]))
    flat = heavy.select("source", "file_id", "point_index", "point_id", each.alias("r")).select("source", "file_id", "r.field", "point_index", "point_id", "r.v").where("v is not null")
    numbered = _ordinals(flat, key, block).drop("point_index")
    own, at = F.floor(F.col("ordinal") / block), F.col("ordinal") % block
    numbered = materialize(numbered.withColumn("own", own))
    summaries = (
        numbered.withColumnRenamed("own", "block").repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY, "ordinal")
        .mapInArrow(_whole_groups(_summarise(tolerance), _BLOCK_KEY), _SUMMARY_SQL)
    )
    carried = summaries.groupBy(*key).applyInPandas(_carried(tolerance), "source int, file_id long, field byte, block long, v long, length long")
    seen = F.array_compact(F.array("own", F.when((at < right) & (F.col("own") > 0), F.col("own") - 1), F.when(at >= block - half, F.col("own") + 1)))
    copies = numbered.withColumn("block", F.explode(seen)).select(*_BLOCK_KEY, "ordinal", "v", F.lit(0).cast("long").alias("length"), "point_id", (F.col("block") == F.col("own")).alias("home"))
    runs = carried.select(*_BLOCK_KEY, F.lit(-1).cast("long").alias("ordinal"), "v", "length", F.lit(0).cast("long").alias("point_id"), F.lit(False).alias("home"))
    ordered = copies.unionByName(runs).repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY, "ordinal")
    return ordered.mapInArrow(_whole_groups(_judge_blocks(ranges, half, run_length, tolerance, period), _BLOCK_KEY), _DECOMPOSED_SQL)


def decompose(
    points: DataFrame, ranges=RANGES, window: int = 11, run_length: int = 20, tolerance: int = 1, period: int = 0, split_rows: int = 1 << 20, block: int = 1 << 18
) -> DataFrame:
    """One row per reading: source, file_id, field (position in ``ranges``), phase, twice the residual, flags, point_id.

    The residual is what the trend leaves; ``deseason`` takes the seasonal part out.
    """
    names = [r[0] for r in ranges]
    readings = points.select(
        F.col("point_source_ID").cast("int").alias("source"), F.col("file_id").cast("long"), F.col("point_index").cast("long"), F.col("point_id").cast("long"), *names
    ).where(F.col("point_source_ID").isNotNull() & F.col("file_id").isNotNull() & F.col("point_index").isNotNull() & F.coalesce(*names).isNotNull())
    how = (ranges, window // 2, run_length, tolerance, period)

    def whole(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition("source", "file_id").sortWithinPartitions("source", "file_id", "point_index")
        return ordered.mapInArrow(_whole_groups(_judge_series(*how), ("source", "file_id")), _DECOMPOSED_SQL)

    big = readings.groupBy("source", "file_id").count().where(F.col("count") > split_rows).select("source", "file_id")
    if big.isEmpty():
        return whole(readings)
    big = materialize(big)
    heavy = readings.join(big, ["source", "file_id"], "left_semi").dropDuplicates(["source", "file_id", "point_index"])
    return whole(readings.join(big, ["source", "file_id"], "left_anti")).unionByName(_decompose_long(heavy, *how, block))


def _ranked(readings: DataFrame, key: list[str], value) -> DataFrame:
    """Histogram of ``value`` per key: value, its count ``c``, rows up to it ``below``, all rows ``n``, and both middle values."""
    hist = readings.groupBy(*key, value.alias("value")).agg(F.count(F.lit(1)).alias("c"))
    all_ = Window.partitionBy(*key)
    up = all_.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumns({"below": F.sum("c").over(up), "n": F.sum("c").over(all_)})
    return ranked.withColumns(
        {
            "lower": F.min(F.when(F.col("below") > F.floor((F.col("n") - 1) / 2), F.col("value"))).over(all_),
            "upper": F.min(F.when(F.col("below") > F.floor(F.col("n") / 2), F.col("value"))).over(all_),
        }
    )


def _scatter(min_scatter: float):
    return F.greatest(F.lit(float(min_scatter)), F.lit(1.4826) * (F.col("lower") + F.col("upper")) / 4)


def deseason(decomposed: DataFrame, min_scatter: float = 1.0) -> DataFrame:
    """Takes the seasonal part out of the residuals and adds it as ``season`` (twice, as they are).

    The seasonal part of a phase is the median of its residuals in the series. It counts only where the phase was seen ``CYCLES``
    times and the median lies ``SEASON_ERRORS`` standard errors from 0, so series without a season are left alone.
    """
    key, phase = ["source", "field"], ["source", "file_id", "field", "phase"]
    scatters = _ranked(decomposed, key, F.abs("twice")).groupBy(*key).agg(F.max(_scatter(min_scatter)).alias("usual"))
    phases = _ranked(decomposed, phase, F.col("twice")).groupBy(*phase).agg(F.max("n").alias("n"), (F.max("lower") + F.max("upper")).alias("sum"))
    held = (F.col("n") >= CYCLES) & (F.abs("sum") / 4 > SEASON_ERRORS * _MEDIAN_ERROR * F.col("usual") / F.sqrt("n"))
    seasons = materialize(phases.join(scatters, key).where(held).select(*phase, F.rint(F.col("sum") / 2).cast("long").alias("season")))
    if is_small(seasons, BROADCAST_ROWS):
        seasons = F.broadcast(seasons)
    out = decomposed.join(seasons, phase, "left").withColumn("season", F.coalesce("season", F.lit(0)))
    return out.withColumn("twice", F.col("twice") - F.col("season"))


#: Upper quantile of the normal law by a published rational approximation (fixed values), good to 1e-9 for tails under 0.024.
_ABOVE = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _polynomial(factors: tuple[float, ...], x):
    value = factors[0]
    for f in factors[1:]:
        value = value * x + f
    return value


#: The limit of the i-th largest studentised deviate among n, one named step after the other, for arrays and for columns.
_LIMIT_STEPS = {
    "q": lambda c, alpha, log, sqrt: sqrt(-2 * log(alpha / (2 * (c["n"] - c["i"] + 1)))),
    "z": lambda c, *_: -_polynomial(_ABOVE, c["q"]) / _polynomial(_BELOW, c["q"]),
    "free": lambda c, *_: c["n"] - c["i"] - 1,
    "zz": lambda c, *_: c["z"] * c["z"],
    # Student's t from the normal quantile, by its expansion in 1/free
    "t": lambda c, *_: c["z"] * (1 + _polynomial((1, 1), c["zz"]) / (4 * c["free"]) + _polynomial((5, 16, 3), c["zz"]) / (96 * c["free"] * c["free"]) + _polynomial((3, 19, 17, -15), c["zz"]) / (384 * c["free"] * c["free"] * c["free"])),
    "limit": lambda c, alpha, log, sqrt: (c["n"] - c["i"]) * c["t"] / sqrt((c["free"] + c["t"] * c["t"]) * (c["n"] - c["i"] + 1)),
}


def esd_limit(n: np.ndarray, i: np.ndarray, alpha: float) -> np.ndarray:
    """Limit of the i-th largest studentised deviate among ``n`` > 2 readings, i up to n/2 (generalised ESD test, level ``alpha``)."""
    c = {"n": np.asarray(n, float), "i": np.asarray(i, float)}
    for name, step in _LIMIT_STEPS.items():
        c[name] = step(c, alpha, np.log, np.sqrt)
    return c["limit"]


def source_limits(decomposed: DataFrame, min_scatter: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """Per source and field: readings, usual scatter and the smallest residual the ESD test rejects (``esd_twice``, null if none).

    Exact: the histogram of residuals holds the ranks, so neither the median nor the test is estimated.
    The test looks at up to half of the readings of a source, and at sources of at least three.
    """
    if not 0 < alpha <= 0.1:
        raise ValueError("alpha must be above 0 and at most 0.1")
    key = ["source", "field"]
    # equal residuals are tested at the rank of the last of them
    tested = _ranked(decomposed, key, F.abs("twice")).select(
        *key, "value", _scatter(min_scatter).alias("scatter"), F.col("n").cast("double"), (F.col("n") - F.col("below") + F.col("c")).cast("double").alias("i")
    )
    at = {name: F.col(name) for name in ("n", "i", *_LIMIT_STEPS)}
    for name, step in _LIMIT_STEPS.items():
        tested = tested.withColumn(name, step(at, alpha, F.log, F.sqrt))
    rejected = (F.col("n") > 2) & (F.col("i") <= F.floor(F.col("n") / 2)) & (F.col("value") / 2 / F.col("scatter") > F.col("limit"))
    return tested.groupBy(*key).agg(
        F.max("n").cast("long").alias("readings"), F.max("scatter").alias("scatter"), F.min(F.when(rejected, F.col("value"))).alias("esd_twice")
    )


def implausible(
    points: DataFrame,
    ranges=RANGES,
    spike_scatters: float = 10.0,
    run_scatter: float = 2.0,
    alpha: float = 0.05,
    period: int = 0,
    only_spikes: bool = False,
    **how,
) -> DataFrame:
    """Flagged readings: point_id, field_name, point_source_ID, is_impossible, is_outlier, is_spike, is_stuck, residual, season, scatter, outlier_from.

    ``is_outlier``: the residual lies beyond the ESD limit of its source, which begins at ``outlier_from``. ``is_spike``: it also exceeds
    ``spike_scatters`` usual scatters. With ``only_spikes`` outliers that are no spikes are left out. A ``period`` above 1 takes out seasons.
    """
    readings = materialize(decompose(points, ranges, period=period, **how))
    readings = materialize(deseason(readings)) if period > 1 else readings.withColumn("season", F.lit(0).cast("long"))
    limits = materialize(source_limits(readings, alpha=alpha))
    if is_small(limits, BROADCAST_ROWS):
        limits = F.broadcast(limits)
    size = F.abs("twice")
    # no scatter is under 1, so smaller residuals can be no spikes, nor outliers under one scatter
    maybe = readings.where((F.col("flags") > 0) | (size > (2 * spike_scatters if only_spikes else 0)))
    named = F.element_at(F.array(*[F.lit(r[0]) for r in ranges]), F.col("field").cast("int") + 1)
    outlier = F.coalesce(size >= F.col("esd_twice"), F.lit(False))
    judged = maybe.join(limits, ["source", "field"]).select(
        "point_id",
        named.alias("field_name"),
        F.col("source").alias("point_source_ID"),
        (F.col("flags").bitwiseAND(IMPOSSIBLE) > 0).alias("is_impossible"),
        outlier.alias("is_outlier"),
        (outlier & (size / 2 > spike_scatters * F.col("scatter"))).alias("is_spike"),
        ((F.col("flags").bitwiseAND(STUCK) > 0) & (F.col("scatter") > run_scatter)).alias("is_stuck"),
        (F.col("twice") / 2).alias("residual"),
        (F.col("season") / 2).alias("season"),
        "scatter",
        (F.col("esd_twice") / 2).alias("outlier_from"),
    )
    return judged.where("is_impossible or is_stuck or " + ("is_spike" if only_spikes else "is_outlier"))
