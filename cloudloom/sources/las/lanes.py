"""Many chunks of one size coded side by side: what ``entropy`` and ``items`` do for one, for a lane per chunk, on arrays.

The n-th points of all chunks are coded at once, so a call of NumPy serves hundreds of lanes. Bytes are the same. Lanes are told by
arrays of their numbers, each lane at most once; models are rows of a ``Pool``, made at first use by (lane, slot). Reading, a lane whose bytes
run out or are corrupt is marked ``bad`` and its values mean nothing.
"""

from __future__ import annotations

import numpy as np

from cloudloom.sources.las.entropy import BIT_SHIFT, FULL, LEAST, SYMBOL_SHIFT, Writer
from cloudloom.sources.las.formats import Item
from cloudloom.sources.las.items import RETURN_MAP, Times

#: Fewer lanes are not worth it; more points at once take too much memory.
LEAST_LANES, MOST_LANES, MOST_POINTS = 64, 512, 1 << 19
_NONE = 65535
_RETURNS = np.array(RETURN_MAP, np.int64)


def wrap32(v: np.ndarray) -> np.ndarray:
    return (v + 0x80000000 & FULL) - 0x80000000


def _grown(a: np.ndarray, rows: int) -> np.ndarray:
    if rows <= len(a):
        return a
    new = np.zeros((max(rows, len(a) * 3 // 2), *a.shape[1:]), a.dtype)
    new[: len(a)] = a
    return new


class Pool:
    """Adaptive models: that of slot s has ``sizes[s]`` symbols."""

    def __init__(self, lanes: int, sizes: list[int]):
        self.sizes, self.slots, self.width = np.array(sizes, np.int64), len(sizes), max(sizes)
        self.steps = [1 << k for k in range((self.width - 1).bit_length() - 1, -1, -1)]
        self.padded = 1 << len(self.steps)
        self.row_of = np.full(lanes * self.slots, -1, np.int32)
        kinds = sorted(set(sizes))
        self.kind = np.array([kinds.index(n) for n in sizes], np.int32)
        # models not yet adapted share a distribution
        self.dist = np.full((len(kinds) + lanes, self.padded), _NONE, np.uint16)
        for k, n in enumerate(kinds):
            self.dist[k, :n] = (0x80000000 // n) * np.arange(n) >> 31 - SYMBOL_SHIFT
        self.shared = self.dists = len(kinds)
        self.used = 0
        # room for all models, of which the system gives what is used
        most = lanes * self.slots
        self.counts = np.zeros((most, self.width), np.uint16)
        self.n, self.total, self.cycle, self.left, self.place = (np.zeros(most, np.int64) for _ in range(5))

    def rows(self, lanes: np.ndarray, slot) -> np.ndarray:
        key = lanes * self.slots + slot
        row = self.row_of[key]
        new = row < 0
        if new.any():
            key = key[new]
            slot, a = key % self.slots, self.used
            self.used = z = a + len(key)
            n = self.sizes[slot]
            self.counts[a:z] = np.arange(self.width) < n[:, None]
            self.n[a:z] = self.total[a:z] = n
            self.cycle[a:z] = self.left[a:z] = n + 6 >> 1
            self.place[a:z] = self.kind[slot]
            self.row_of[key] = np.arange(a, z)
            row[new] = np.arange(a, z)
        return row.astype(np.int64)

    def seen(self, row: np.ndarray, s: np.ndarray) -> None:
        self.counts.reshape(-1)[row * self.width + s] += 1
        left = self.left[row] - 1
        self.left[row] = left
        if not left.all():
            self._refresh(row[left == 0])

    def _refresh(self, row: np.ndarray) -> None:
        total, n, counts = self.total[row] + self.cycle[row], self.n[row], self.counts[row]
        over = total > 1 << SYMBOL_SHIFT
        if over.any():
            counts[over] = counts[over] + 1 >> 1
            self.counts[row[over]] = counts[over]
            total[over] = counts[over].sum(1, dtype=np.int64)
        self.total[row] = total
        fresh = row[self.place[row] < self.shared]
        if len(fresh):
            z = self.dists + len(fresh)
            self.dist = _grown(self.dist, z)
            self.place[fresh] = np.arange(self.dists, z)
            self.dists = z
        dist = np.full((len(row), self.padded), _NONE, np.uint16)
        sums = np.zeros((len(row), self.width), np.int64)
        np.cumsum(counts[:, :-1], 1, out=sums[:, 1:])
        dist[:, : self.width] = np.where(np.arange(self.width) < n[:, None], (0x80000000 // total)[:, None] * sums >> 31 - SYMBOL_SHIFT, _NONE)
        self.dist[self.place[row]] = dist
        self.cycle[row] = self.left[row] = np.minimum(5 * self.cycle[row] >> 2, n + 6 << 3)


class Bits:
    """Adaptive models of bits."""

    def __init__(self, lanes: int):
        self.zeros, self.total = np.ones(lanes, np.int64), np.full(lanes, 2)
        self.prob = np.full(lanes, 1 << BIT_SHIFT - 1)
        self.cycle, self.left = np.full(lanes, 4), np.full(lanes, 4)

    def seen(self, lanes: np.ndarray, b: np.ndarray) -> None:
        self.zeros[lanes] += b == 0
        self.left[lanes] -= 1
        if len(r := lanes[self.left[lanes] == 0]):
            total, zeros = self.total[r] + self.cycle[r], self.zeros[r]
            over = total > 1 << BIT_SHIFT
            total, zeros = np.where(over, total + 1 >> 1, total), np.where(over, zeros + 1 >> 1, zeros)
            total += over & (zeros == total)
            self.total[r], self.zeros[r] = total, zeros
            self.prob[r] = zeros * (0x80000000 // total) >> 31 - BIT_SHIFT
            self.cycle[r] = self.left[r] = np.minimum(5 * self.cycle[r] >> 2, 64)


class _Coder:
    """What reading and writing share: all but ``_settle``."""

    def symbol(self, pool: Pool, lanes: np.ndarray, slot, v=None) -> np.ndarray:
        row = pool.rows(lanes, slot)
        dist, base = pool.dist.reshape(-1), pool.place[row] * pool.padded
        length = self.length[lanes]
        part = length >> SYMBOL_SHIFT
        if v is None:
            # below the mark of what is no symbol, whatever a damaged lane holds
            q = np.minimum(self.value[lanes] // part, _NONE - 1)
            v = np.zeros(len(lanes), np.int64)
            for step in pool.steps:
                v += step * (dist[base + v + step] <= q)
        at = base + v
        low = dist[at] * part
        last = v == pool.n[row] - 1
        self._settle(lanes, low, np.where(last, length, dist[at + ~last] * part) - low)
        pool.seen(row, v)
        return v

    def bit(self, models: Bits, lanes: np.ndarray, b=None) -> np.ndarray:
        length = self.length[lanes]
        cut = models.prob[lanes] * (length >> BIT_SHIFT)
        if b is None:
            b = (self.value[lanes] >= cut).astype(np.int64)
        self._settle(lanes, np.where(b, cut, 0), np.where(b, length - cut, cut))
        models.seen(lanes, b)
        return b

    def bits(self, lanes: np.ndarray, n, v=None) -> np.ndarray:
        """``n`` bits a lane, an array or a number."""
        n = np.broadcast_to(n, lanes.shape)
        low, done = np.zeros(len(lanes), np.int64), np.where(n > 19, 16, 0)
        if (long := n > 19).any():
            low[long] = self.bits(lanes[long], 16, None if v is None else v[long] & 0xFFFF)
        part = self.length[lanes] >> n - done
        if v is None:
            got = self.value[lanes] // part
            self.bad[lanes] |= got >> n - done != 0
        else:
            got = v >> done
        self._settle(lanes, got * part, part)
        return (got & (1 << n - done) - 1) << done | low


class LaneReader(_Coder):
    """Lane k reads ``data`` from ``pos[k]`` up to ``end[k]``."""

    writing = False

    def __init__(self, data: np.ndarray, pos: np.ndarray, end: np.ndarray):
        self.data, self.end = data, end
        self.bad = pos + 4 > end
        self.pos = np.where(self.bad, 0, pos)
        self.value = np.zeros(len(pos), np.int64)
        for k in range(4):
            self.value = self.value << 8 | data[np.minimum(self.pos + k, len(data) - 1)]
        self.pos = self.pos + 4
        self.length = np.full(len(pos), FULL)

    def _settle(self, lanes: np.ndarray, low: np.ndarray, length: np.ndarray) -> None:
        value = self.value[lanes] - low
        self.value[lanes], self.length[lanes] = value, length
        short = length < LEAST
        while short.any():
            lanes, value, length = lanes[short], value[short], length[short]
            pos = self.pos[lanes]
            self.bad[lanes] |= pos >= self.end[lanes]
            value = value << 8 | self.data[np.minimum(pos, len(self.data) - 1)]
            length = np.maximum(length, 1) << 8
            self.pos[lanes], self.value[lanes], self.length[lanes] = pos + 1, value, length
            short = length < LEAST


class LaneWriter(_Coder):
    writing = True

    def __init__(self, lanes: int):
        self.out, self.size = np.zeros((lanes, 4096), np.uint8), np.zeros(lanes, np.int64)
        self.base, self.length = np.zeros(lanes, np.int64), np.full(lanes, FULL)
        self.bad = np.zeros(lanes, bool)

    def room(self, n: int) -> None:
        """Makes room for ``n`` more bytes a lane."""
        if (need := int(self.size.max()) + n) > self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros((len(self.out), max(need - self.out.shape[1], self.out.shape[1] // 2)), np.uint8)], 1)

    def _settle(self, lanes: np.ndarray, low: np.ndarray, length: np.ndarray) -> None:
        base = self.base[lanes] + low
        over = base > FULL
        if over.any():
            base &= FULL
            up = lanes[over]
            i = self.size[up] - 1
            while len(full := np.flatnonzero(self.out[up, i] == 255)):
                self.out[up[full], i[full]] = 0
                i[full] -= 1
            self.out[up, i] += 1
        self.base[lanes], self.length[lanes] = base, length
        short = length < LEAST
        while short.any():
            lanes, base, length = lanes[short], base[short], length[short]
            self.out[lanes, self.size[lanes]] = base >> 24
            self.size[lanes] += 1
            base, length = base << 8 & FULL, length << 8
            self.base[lanes], self.length[lanes] = base, length
            short = length < LEAST

    def finish(self) -> list[bytes]:
        got = []
        for k in range(len(self.out)):
            w = Writer()
            w.out = bytearray(self.out[k, : self.size[k]].tobytes())
            w.base, w.length = int(self.base[k]), int(self.length[k])
            got.append(w.finish())
        return got


class Slots:
    """Hands out slots of the pools: one for small alphabets, one for those of up to 256, one for the rest."""

    def __init__(self):
        self.sizes: tuple[list[int], ...] = ([], [], [])

    def take(self, *sizes: int) -> tuple[int, int]:
        """(pool, first slot) of models that need one pool."""
        k = 0 if max(sizes) <= 64 else 1 if max(sizes) <= 256 else 2
        at = len(self.sizes[k])
        self.sizes[k].extend(sizes)
        return k, at

    def pools(self, lanes: int) -> list[Pool]:
        return [Pool(lanes, s or [2]) for s in self.sizes]


class Ints:
    def __init__(self, slots: Slots, lanes: int, width: int, contexts: int = 1, high: int = 8):
        self.width, self.high, self.span, self.low = width, high, 1 << width, -(1 << width - 1)
        self.sizes = slots.take(*[width + 1] * contexts)
        self.fine = slots.take(*[1 << min(k, high) for k in range(1, width + 1)])
        self.small = Bits(lanes)
        self.k = np.zeros(lanes, np.int64)

    def code(self, io, pools, lanes, pred, real=None, context=0) -> np.ndarray:
        c = None
        if io.writing:
            c = real - pred
            if self.width == 32:
                c = wrap32(c)
            else:
                c = np.where(c < self.low, c + self.span, np.where(c >= -self.low, c - self.span, c))
        got = pred + self._correction(io, pools, lanes, c, context)
        return wrap32(got) if self.width == 32 else got % self.span

    def _correction(self, io, pools, lanes, c, context) -> np.ndarray:
        k = None if c is None else np.frexp(np.where(c <= 0, -c, c - 1).astype(np.float64))[1].astype(np.int64)
        k = io.symbol(pools[self.sizes[0]], lanes, self.sizes[1] + context, k)
        self.k[lanes] = k
        out = np.full(len(lanes), self.low, np.int64)
        if len(z := np.flatnonzero(k == 0)):
            out[z] = io.bit(self.small, lanes[z], None if c is None else c[z])
        if not len(m := np.flatnonzero((k > 0) & (k < 32))):
            return out
        k, at = k[m], lanes[m]
        rest = np.maximum(k - self.high, 0)
        v = None
        if c is not None:
            v = c[m]
            v = np.where(v > 0, v - 1, v + (1 << k) - 1)
        top = io.symbol(pools[self.fine[0]], at, self.fine[1] + k - 1, None if v is None else v >> rest)
        got = top << rest
        if len(r := np.flatnonzero(rest)):
            got[r] |= io.bits(at[r], rest[r], None if v is None else v[r] & (1 << rest[r]) - 1)
        out[m] = np.where(got >= 1 << k - 1, got + 1, got - (1 << k) + 1)
        return out


class Point10V2:
    def __init__(self, slots: Slots, first: np.ndarray):
        lanes = len(first)
        self.last = first.copy()
        self.last[:, 3] = 0
        self.dx, self.dy, self.z = Ints(slots, lanes, 32, 2), Ints(slots, lanes, 32, 22), Ints(slots, lanes, 32, 20)
        self.changed = slots.take(64)
        self.intensity, self.source = Ints(slots, lanes, 16, 4), Ints(slots, lanes, 16)
        self.ranks = slots.take(256, 256)
        self.returns, self.classes, self.users = (slots.take(*[256] * 256) for _ in range(3))
        self.seen = np.zeros((lanes, 16), np.int64)
        self.middle, self.drop_high = np.zeros((2, lanes, 16, 5), np.int64), np.ones((2, lanes, 16), bool)
        self.heights = np.zeros((lanes, 8), np.int64)

    def _add(self, axis: int, lanes, m, v) -> None:
        five, high = self.middle[axis, lanes, m], self.drop_high[axis, lanes, m]
        self.drop_high[axis, lanes, m] = np.where(high, v < five[:, 2], v <= five[:, 2])
        kept = np.where(high[:, None], five[:, :4], five[:, 1:])
        self.middle[axis, lanes, m] = np.sort(np.concatenate([kept, v[:, None]], 1), 1)

    def code(self, io, pools, lanes, p):
        w, last = io.writing, self.last
        mask = None
        if w:
            m = _RETURNS[p[:, 4] >> 3 & 7, p[:, 4] & 7]
            mask = (p[:, 4] != last[:, 4]) * 32 + (p[:, 3] != self.seen[lanes, m]) * 16 + sum((p[:, f] != last[:, f]) << 8 - f for f in (5, 6, 7, 8))
        mask = io.symbol(pools[self.changed[0]], lanes, self.changed[1], mask)
        new = last.copy()
        real = lambda at, f: p[at, f] if w else None

        def switched(bit: int, bank: tuple[int, int], f: int) -> None:
            if len(at := np.flatnonzero(mask & bit)):
                new[at, f] = io.symbol(pools[bank[0]], at, bank[1] + last[at, f], real(at, f))

        switched(32, self.returns, 4)
        r, n = new[:, 4] & 7, new[:, 4] >> 3 & 7
        m, level = _RETURNS[n, r], np.abs(n - r)
        if len(at := np.flatnonzero(mask & 16)):
            self.seen[at, m[at]] = self.intensity.code(io, pools, at, self.seen[at, m[at]], real(at, 3), np.minimum(m[at], 3))
        new[:, 3] = self.seen[lanes, m]
        switched(8, self.classes, 5)
        if len(at := np.flatnonzero(mask & 4)):
            step = io.symbol(pools[self.ranks[0]], at, self.ranks[1] + (new[at, 4] >> 6 & 1), p[at, 6] - last[at, 6] & 255 if w else None)
            new[at, 6] = last[at, 6] + step & 255
        switched(2, self.users, 7)
        if len(at := np.flatnonzero(mask & 1)):
            new[at, 8] = self.source.code(io, pools, at, last[at, 8], real(at, 8))
        single = (n == 1).astype(np.int64)
        d = self.dx.code(io, pools, lanes, self.middle[0, lanes, m, 2], wrap32(p[:, 0] - last[:, 0]) if w else None, single)
        new[:, 0] = wrap32(last[:, 0] + d)
        self._add(0, lanes, m, d)
        d = self.dy.code(io, pools, lanes, self.middle[1, lanes, m, 2], wrap32(p[:, 1] - last[:, 1]) if w else None, single + np.minimum(self.dx.k & ~1, 20))
        new[:, 1] = wrap32(last[:, 1] + d)
        self._add(1, lanes, m, d)
        k = (self.dx.k + self.dy.k) // 2
        new[:, 2] = self.z.code(io, pools, lanes, self.heights[lanes, level], p[:, 2] if w else None, single + np.minimum(k & ~1, 18))
        self.heights[lanes, level] = new[:, 2]
        self.last = new
        return new


class GpsTimeV2:
    """``items.Times`` with a code for unchanged times."""

    MOST, LEAST = Times.MOST, Times.LEAST
    FULL = MOST - LEAST + 2

    def __init__(self, slots: Slots, first: np.ndarray):
        lanes = len(first)
        self.times, self.steps, self.extreme = (np.zeros((lanes, 4), np.int64) for _ in range(3))
        self.times[:, 0] = first[:, 0]
        self.at, self.newest = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.multiples, self.fresh = slots.take(self.FULL + 4), slots.take(6)
        self.diff = Ints(slots, lanes, 32, 9)

    @staticmethod
    def _fits(t: np.ndarray, of: np.ndarray) -> np.ndarray:
        # a difference beyond 64 bits wraps, but is far off as a float
        d = t - of
        return (wrap32(d) == d) & (np.abs(t.astype(np.float64) - of.astype(np.float64)) < 1 << 40)

    def _other(self, lanes, t) -> np.ndarray:
        out = np.zeros(len(lanes), np.int64)
        for k in (3, 2, 1):
            out = np.where(self._fits(t, self.times[lanes, self.at[lanes] + k & 3]), k, out)
        return out

    def _begin(self, io, pools, lanes, t) -> None:
        if not len(lanes):
            return
        self.newest[lanes] = self.newest[lanes] + 1 & 3
        high = self.diff.code(io, pools, lanes, self.times[lanes, self.at[lanes]] >> 32, None if t is None else t >> 32, 8)
        low = io.bits(lanes, 16, None if t is None else t & 0xFFFF)
        low = low | io.bits(lanes, 16, None if t is None else t >> 16 & 0xFFFF) << 16
        at = self.newest[lanes]
        self.times[lanes, at] = high << 32 | low
        self.at[lanes] = at
        self.steps[lanes, at] = self.extreme[lanes, at] = 0

    def _unstepped(self, io, pools, lanes, t) -> np.ndarray:
        """Codes of lanes whose sequence has no step yet; gives the lanes that went on to another sequence."""
        at, kind, delta = self.at[lanes], None, None
        if t is not None:
            delta = t - self.times[lanes, at]
            kind = np.where(t == self.times[lanes, at], 0, np.where(self._fits(t, self.times[lanes, at]), 1, 2 + self._other(lanes, t)))
        kind = io.symbol(pools[self.fresh[0]], lanes, self.fresh[1], kind)
        if len(m := np.flatnonzero(kind == 1)):
            got = self.diff.code(io, pools, lanes[m], np.zeros(len(m), np.int64), None if t is None else delta[m], 0)
            self.steps[lanes[m], at[m]] = got
            self.times[lanes[m], at[m]] += got
            self.extreme[lanes[m], at[m]] = 0
        self._begin(io, pools, lanes[m := kind == 2], None if t is None else t[m])
        m = kind > 2
        self.at[lanes[m]] = at[m] + kind[m] - 2 & 3
        return lanes[m]

    def _stepped(self, io, pools, lanes, t) -> np.ndarray:
        at, kind, delta = self.at[lanes], None, None
        step = self.steps[lanes, at]
        if t is not None:
            delta = t - self.times[lanes, at]
            fits = self._fits(t, self.times[lanes, at])
            q = (np.where(fits, delta, 0).astype(np.float32) / step.astype(np.float32)).astype(np.float64)
            times = np.clip(np.trunc(np.where(q >= 0, q + 0.5, q - 0.5)), self.LEAST, self.MOST).astype(np.int64)
            kind = np.where(fits, np.where(times >= 0, times, self.MOST - times), self.FULL + self._other(lanes, t))
            kind = np.where(t == self.times[lanes, at], self.FULL - 1, kind)
        kind = io.symbol(pools[self.multiples[0]], lanes, self.multiples[1], kind)
        if len(m := np.flatnonzero(kind < self.FULL - 1)):
            who, where = lanes[m], at[m]
            times = np.where(kind[m] <= self.MOST, kind[m], self.MOST - kind[m])
            context = np.select(
                [times == 1, times == 0, times >= self.MOST, times >= 10, times > 0, times > self.LEAST], [1, 7, 4, 3, 2, 5], 6
            )
            got = self.diff.code(io, pools, who, wrap32(times * step[m]), None if t is None else delta[m], context)
            self.extreme[who[times == 1], where[times == 1]] = 0
            far = (times == 0) | (times == self.MOST) | (times == self.LEAST)
            self.extreme[who[far], where[far]] += 1
            far &= self.extreme[who, where] > 3
            self.steps[who[far], where[far]] = got[far]
            self.extreme[who[far], where[far]] = 0
            self.times[who, where] += got
        self._begin(io, pools, lanes[m := kind == self.FULL], None if t is None else t[m])
        m = kind > self.FULL
        self.at[lanes[m]] = at[m] + kind[m] - self.FULL & 3
        return lanes[m]

    def code(self, io, pools, lanes, p):
        left, rounds = lanes, 0
        while len(left):
            # who goes on to another sequence has found it; noise may go around for long
            if (rounds := rounds + 1) > 8:
                io.bad[left] = True
                break
            stepped = self.steps[left, self.at[left]] != 0
            on = []
            for part, how in ((left[~stepped], self._unstepped), (left[stepped], self._stepped)):
                if len(part):
                    on.append(how(io, pools, part, p[part, 0] if io.writing else None))
            left = np.concatenate(on)
            left = left[~io.bad[left]]
        return self.times[lanes, self.at][:, None]


CODECS = {("POINT10", 2): Point10V2, ("GPSTIME11", 2): GpsTimeV2}


def lanes_for(items: list[Item], chunk: int, chunks: int) -> int:
    """How many of ``chunks`` chunks are coded at once, 0 if they should be coded one by one."""
    n = min(MOST_LANES, MOST_POINTS // max(chunk, 1), chunks)
    return n if n >= LEAST_LANES and all((i.kind, i.version) in CODECS for i in items) else 0


def _made(items: list[Item], firsts: list[np.ndarray]) -> tuple[list, list[Pool]]:
    slots = Slots()
    codecs = [CODECS[i.kind, i.version](slots, f) for i, f in zip(items, firsts)]
    return codecs, slots.pools(len(firsts[0]))


def decode(data: np.ndarray, firsts: list[np.ndarray], pos: np.ndarray, end: np.ndarray, count: int, items: list[Item], keep: bool = True) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Values of each item (lanes, points, values) of chunks whose first points are given and whose streams start at ``pos``; where they end; which are bad."""
    codecs, pools = _made(items, firsts)
    io, lanes = LaneReader(data, pos, end), np.arange(len(pos))
    out = [np.empty((len(pos), count if keep else 1, f.shape[1]), np.int64) for f in firsts]
    for o, f in zip(out, firsts):
        o[:, 0] = f
    for k in range(1, count):
        for codec, o in zip(codecs, out):
            v = codec.code(io, pools, lanes, None)
            if keep:
                o[:, k] = v
    return out, io.pos, io.bad


def encode(values: list[np.ndarray], items: list[Item]) -> list[bytes]:
    """The streams behind the first points of chunks, from the values of each item (lanes, points, values)."""
    codecs, pools = _made(items, [v[:, 0] for v in values])
    io, lanes = LaneWriter(len(values[0])), np.arange(len(values[0]))
    for k in range(1, values[0].shape[1]):
        # more than any point takes
        io.room(256)
        for codec, v in zip(codecs, values):
            codec.code(io, pools, lanes, v[:, k])
    return io.finish()
