"""Filling containers of fixed capacity: hierarchical multi-length packing.

There are windows of several context sizes: the capacity, a half, a quarter and so on, one size a tier. Each text is
routed to the tier of the shortest window that holds it; a text larger than the capacity is split into full windows and a
rest, nothing else is split. Tiers are packed from the longest down, each into windows of its own size, the
fullest window with room first. Before the next tier is packed, what room is left in the windows is filled
from all shorter tiers, with the longest text that fits. Windows shorter than the capacity then share containers, so
a container holds one or several windows and never more tokens than its capacity. Last, containers are dealt to step
groups in snake order of their fill, over all containers at once, so that steps carry about the same number of tokens.

How it scales: texts are spread by hash over pack groups of about ``group_tokens`` tokens, one task packs a group
in memory of its sizes only, and no group sees another. What is lost is at most one container a group that is less
than half full. Placing a text takes constant time: windows and texts are listed by size, and a bit set finds the list.
Places in the order of fill come from counts per fill and group, so no task orders all containers.

Defined cases: null and blank texts with 0 tokens go into no container (container_id is null); repeated ids are separate
records; a null id keeps its row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.tokens import token_sizes
from cloudloom.runtime import BROADCAST_ROWS, is_small, materialize

#: Tokens of a pack group: some two thousand containers of 2,048 tokens.
GROUP_TOKENS = 1 << 22
#: Context sizes: the capacity, its half, its quarter and its eighth.
TIERS = 4
#: Containers of a step group.
STEP = 8
#: Containers of all groups are numbered apart by this factor.
STRIDE = 1 << 32


def window_size(tier: int, capacity: int) -> int:
    return max(1, capacity >> tier)


def tier_of(size: int, capacity: int, tiers: int = TIERS) -> int:
    """The tier of the shortest window that holds a text of ``size``."""
    t = 0
    while t + 1 < tiers and size <= capacity >> (t + 1):
        t += 1
    return t


class _BySize:
    """Things listed by a size, with the next larger or smaller size found in constant time."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}
        self.sizes = 0

    def add(self, size: int, thing: int) -> None:
        self.lists.setdefault(size, []).append(thing)
        self.sizes |= 1 << size

    def take(self, size: int) -> int:
        listed = self.lists[size]
        thing = listed.pop()
        if not listed:
            self.sizes ^= 1 << size
        return thing

    def at_least(self, size: int) -> int | None:
        """The smallest size held that is not below ``size``."""
        above = self.sizes >> size
        return size + (above & -above).bit_length() - 1 if above else None

    def at_most(self, size: int) -> int | None:
        """The largest size held that is not above ``size``."""
        below = self.sizes & ((1 << (size + 1)) - 1)
        return below.bit_length() - 1 if below else None


@dataclass
class Windows:
    """Packed windows: tier and tokens of each, and which window holds which tokens of which text."""

    tier: list[int]
    filled: list[int]
    places: list[list[tuple[int, int]]]

    def open(self, tier: int) -> int:
        self.tier.append(tier)
        self.filled.append(0)
        return len(self.tier) - 1

    def put(self, window: int, text: int, tokens: int) -> None:
        self.filled[window] += tokens
        self.places[text].append((window, tokens))


def pack_windows(sizes: list[int], capacity: int, tiers: int = TIERS) -> Windows:
    """Texts in windows of their tier, with the gaps of longer windows filled from shorter tiers."""
    got = Windows([], [], [[] for _ in sizes])
    waiting: list[_BySize] = [_BySize() for _ in range(tiers)]
    for k, size in enumerate(sizes):
        while size > capacity:
            got.put(got.open(0), k, capacity)
            size -= capacity
        if size > 0:
            waiting[tier_of(size, capacity, tiers)].add(size, k)
    for t, own in enumerate(waiting):
        width = window_size(t, capacity)
        rooms, opened = _BySize(), len(got.tier)
        while (size := own.at_most(width)) is not None:
            text = own.take(size)
            room = rooms.at_least(size)
            window = got.open(t) if room is None else rooms.take(room)
            got.put(window, text, size)
            if got.filled[window] < width:
                rooms.add(width - got.filled[window], window)
        shorter = waiting[t + 1 :]
        for window in range(opened, len(got.tier)):
            for other in shorter:
                while (size := other.at_most(width - got.filled[window])) is not None:
                    got.put(window, other.take(size), size)
    return got


def join_windows(windows: Windows, capacity: int) -> list[int]:
    """Container of each window: the longest windows first, each where its tokens fit best, else in a new container."""
    container, rooms, n = [-1] * len(windows.tier), _BySize(), 0
    order = sorted(range(len(windows.tier)), key=lambda w: (windows.tier[w], -windows.filled[w], w))
    for w in order:
        size = windows.filled[w]
        room = rooms.at_least(size)
        if room is None:
            room, container[w] = capacity, n
            n += 1
        else:
            container[w] = rooms.take(room)
        if room > size:
            rooms.add(room - size, container[w])
    return container


_PLACED = "doc_id long, n_tokens long, piece int, pieces int, container_id long, window int, window_tokens int, tier int, piece_tokens long, fill long, grp long, nth long"


def pack_documents(
    docs: DataFrame, capacity: int, group_tokens: int = GROUP_TOKENS, step: int = STEP, tokenizer: str | None = None, tiers: int = TIERS
) -> DataFrame:
    """One row per document and piece: its container, the window of the container it lies in and that window's size and tier, and the step group.

    Columns: doc_id, n_tokens, piece, pieces, container_id (unique over all groups), window (number within the pack group), window_tokens,
    tier, piece_tokens, fill (tokens of the container), step_group.
    """
    if capacity <= 0 or tiers <= 0:
        raise ValueError("capacity and tiers must be positive")
    sized = materialize(token_sizes(docs, ["doc_id"], path=tokenizer))
    total, rows = sized.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    # rows carry no tokens of their own when texts are blank, so bound a group by rows too
    groups = max(1, ceil((total or 0) / group_tokens), ceil(rows / group_tokens))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "n_tokens"], na_position="first")
        group = int(part["grp"].iloc[0])
        sizes = part["n_tokens"].astype(int).tolist()
        windows = pack_windows(sizes, capacity, tiers)
        container = join_windows(windows, capacity)
        fill: dict[int, int] = {}
        for w, c in enumerate(container):
            fill[c] = fill.get(c, 0) + windows.filled[w]
        # the place of a container among those of the group that are as full
        nth, seen = {}, {}
        for c in range(len(fill)):
            nth[c] = seen.get(fill[c], 0)
            seen[fill[c]] = nth[c] + 1
        rows = []
        for doc, size, places in zip(part["doc_id"], sizes, windows.places):
            doc = None if pd.isna(doc) else int(doc)
            for k, (w, tokens) in enumerate(places):
                c, t = container[w], windows.tier[w]
                rows.append((doc, size, k, len(places), group * STRIDE + c, w, window_size(t, capacity), t, tokens, fill[c], group, nth[c]))
            if not places:
                rows.append((doc, size, 0, 0, None, None, None, None, 0, None, group, None))
        names = [x.split()[0] for x in _PLACED.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names})

    # ids that are null or repeated are told apart by their row, so that no group gets all of them
    grouped = sized.withColumn("grp", F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), "n_tokens"), F.lit(groups)).cast("int"))
    placed = materialize(materialize(grouped).groupBy("grp").applyInPandas(place, _PLACED))
    # containers by fill, the fullest first; of equal ones group by group
    full = placed.where("container_id is not null").groupBy("fill", "grp").agg((F.max("nth") + 1).alias("held"))
    levels = full.groupBy("fill").agg(F.sum("held").alias("level"))
    above = levels.select("fill", (F.sum("level").over(Window.orderBy(F.col("fill").desc())) - F.col("level")).alias("above"))
    before = F.sum("held").over(Window.partitionBy("fill").orderBy("grp")) - F.col("held")
    ranks = materialize(full.withColumn("before", before).join(F.broadcast(above), "fill").select("fill", "grp", (F.col("above") + F.col("before")).alias("start"), "held"))
    steps = max(1, ceil((ranks.agg(F.sum("held")).first()[0] or 0) / step))
    ranks = ranks.drop("held")
    if is_small(ranks, BROADCAST_ROWS):
        ranks = F.broadcast(ranks)
    rank = F.col("start") + F.col("nth")
    row, at = F.floor(rank / steps), rank % steps
    return placed.join(ranks, ["fill", "grp"], "left").withColumn("step_group", F.when(row % 2 == 0, at).otherwise(steps - 1 - at)).select(
        "doc_id", "n_tokens", "piece", "pieces", "container_id", "window", "window_tokens", "tier", "piece_tokens", "fill", "step_group"
    )


def oversized(packed: DataFrame) -> DataFrame:
    """Documents that had to be split: larger than a container alone."""
    return packed.where((F.col("pieces") > 1) & (F.col("piece") == 0)).select("doc_id")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Per window size: windows, texts, tokens and unused share of the windows; and the same of containers (tier null)."""
    # a container lies in one pack group, so container and window number tell a window
    used = packed.where("container_id is not null")
    windows = used.groupBy("container_id", "window").agg(F.first("tier").alias("tier"), F.first("window_tokens").alias("size"), F.sum("piece_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"))
    tiers = windows.groupBy("tier", "size").agg(F.count(F.lit(1)).alias("windows"), F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))
    containers = used.groupBy("container_id").agg(F.sum("piece_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts")).agg(
        F.lit(None).cast("int").alias("tier"), F.lit(capacity).alias("size"), F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")
    )
    return tiers.unionByName(containers).withColumn("unused", 1 - F.col("tokens") / F.nullif(F.col("windows") * F.col("size"), F.lit(0)))
