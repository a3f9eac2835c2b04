"""Suffix and common-prefix arrays by external induced sorting.

After Bingmann, Fischer and Osipov, "Inducing Suffix and LCP Arrays in External
Memory" (2013). A text is a file of 64-bit symbols. Suffixes fall into two types
by whether the next suffix is smaller (L) or larger (S); the S suffixes after an
L are sorted first, by recursion on the names of the stretches between them, and
induce all others in two sweeps. A sweep takes suffixes in order from a priority
queue and puts the suffixes to their left into it, as tuples of place, arrival and
run: suffixes of one symbol c stand in the order of how often c follows itself,
then of the arrival of the suffix after that run. The queue is one of ranges of
symbols. A range's tuples wait in a file; when its turn comes they are laid out by
symbol, and its symbols are taken in groups, as large as none of a group's suffixes
induces another, each by a few array operations. With each suffix goes its common
prefix with the suffix before it, up to ``cap``: that of the runs, and where these
are equal one more than the least of those between the two suffixes that induced
them, from minima of blocks that grow with the sweep.

In memory are the tuples of one range, ``range_size`` on average, and ``buffer``
tuples that are to be written; a symbol with more than that is read in parts, of
which those in runs of the same symbol are sorted together. All that is as long as
the text, such as the text, types, orders, prefixes and their minima, is in files
that are mapped and read in blocks or at the places that a group of suffixes has.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_BLOCK = 16
_TUPLE = np.dtype([("place", np.int64), ("arrival", np.int64), ("run", np.int64)])


@dataclass(frozen=True)
class SortOptions:
    """``range_size``: suffixes whose symbols form a range; ``buffer``: tuples held before they are written, and read at once."""

    cap: int = 50
    range_size: int = 2_000_000
    buffer: int = 250_000


class Scratch:
    """A folder of a task's own, removed at its end."""

    def __init__(self, root: str):
        self.path = os.path.join(root, f"suffixes-{uuid.uuid4().hex}")
        os.makedirs(self.path)
        self._n = 0

    def file(self) -> str:
        self._n += 1
        return os.path.join(self.path, str(self._n))

    def empty(self, n: int, dtype: object) -> np.ndarray:
        """A mapped file of ``n`` zeros."""
        return np.asarray(np.memmap(self.file(), dtype, "w+", shape=n)) if n else np.zeros(0, dtype)

    def keep(self, values: np.ndarray) -> np.ndarray:
        """``values`` in a file, mapped back."""
        out = self.empty(len(values), values.dtype)
        out[:] = values
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        shutil.rmtree(self.path, ignore_errors=True)


class Log:
    """Values appended to a file, by ``limit`` of them."""

    def __init__(self, scratch: Scratch, dtype: object, limit: int):
        self.name, self.dtype, self.limit = scratch.file(), np.dtype(dtype), limit
        self.now: list[np.ndarray] = []
        self.held = self.n = 0

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.now.append(np.ascontiguousarray(values, self.dtype))
            self.held += len(values)
            self.n += len(values)
            if self.held >= self.limit:
                self.flush()

    def flush(self) -> None:
        if self.now:
            with open(self.name, "ab") as f:
                (np.concatenate(self.now) if len(self.now) > 1 else self.now[0]).tofile(f)
            self.now, self.held = [], 0

    def all(self) -> np.ndarray:
        """Everything so far, mapped."""
        self.flush()
        return np.asarray(np.memmap(self.name, self.dtype, "r")) if self.n else np.zeros(0, self.dtype)

    def drop(self) -> None:
        self.now = []
        if os.path.exists(self.name):
            os.remove(self.name)


class _Ranges:
    """A log for each range of symbols; together they hold ``limit`` values in memory."""

    def __init__(self, scratch: Scratch, dtype: object, n: int, limit: int):
        self.logs = [Log(scratch, dtype, 1 << 60) for _ in range(n)]
        self.limit, self.held = limit, 0

    def add(self, to: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(to, kind="stable")
        to = to[order]
        edge = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(to)], strict=False):
            self.logs[int(to[a])].add(values[order[a:b]])
        self.held += len(to)
        if self.held >= self.limit:
            for log in self.logs:
                log.flush()
            self.held = 0


def blocks(n: int, size: int) -> Iterator[tuple[int, int]]:
    for lo in range(0, n, size):
        yield lo, min(n, lo + size)


class _Minima:
    """Least common prefix over stretches of the sweep so far, in mapped files."""

    def __init__(self, scratch: Scratch, n: int):
        self.scratch, self.room = scratch, -(-n // _BLOCK) * _BLOCK
        self.raw, self.head, self.tail = (scratch.empty(self.room, np.uint8) for _ in range(3))
        self.table: list[np.ndarray] = []
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        lo, hi = self.size // _BLOCK * _BLOCK, self.size + len(values)
        end = -(-hi // _BLOCK) * _BLOCK
        self.raw[self.size : hi] = values
        self.raw[hi:end] = 255
        v = self.raw[lo:end].reshape(-1, _BLOCK)
        np.minimum.accumulate(v, 1, out=self.head[lo:end].reshape(-1, _BLOCK))
        self.tail[lo:end] = np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
        was, now = self.size // _BLOCK, hi // _BLOCK  # whole blocks
        self.size = hi
        if now == was:
            return
        width, level = 1, 0
        while width <= now:
            if level == len(self.table):
                self.table.append(self.scratch.empty(self.room // _BLOCK, np.uint8))
            a, b = max(0, was - width + 1), now - width + 1
            if level:
                below = self.table[level - 1]
                self.table[level][a:b] = np.minimum(below[a:b], below[a + width // 2 : b + width // 2])
            else:
                self.table[0][a:b] = self.tail[a * _BLOCK : b * _BLOCK : _BLOCK]
            width, level = width * 2, level + 1

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima over [lo, hi], for arrays of both."""
        a, b = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.tail[lo], self.head[hi])
        mid = np.flatnonzero(b - a > 1)
        if len(mid):
            s, n = a[mid] + 1, b[mid] - a[mid] - 1
            level = np.frexp(n.astype(float))[1] - 1
            for k in np.flatnonzero(np.bincount(level)).tolist():
                m = np.flatnonzero(level == k)
                t = self.table[k]
                out[mid[m]] = np.minimum(out[mid[m]], np.minimum(t[s[m]], t[s[m] + n[m] - (1 << k)]))
        same = np.flatnonzero(a == b)
        if len(same):
            at = np.minimum(lo[same, None] + np.arange(_BLOCK), hi[same, None])
            out[same] = self.raw[at].min(1)
        return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffixes a and b, up to ``cap``, given that the first ``known`` agree."""
    out = np.minimum(known, cap).astype(np.int64)
    open_ = np.flatnonzero(out < cap)
    n = len(text)
    while len(open_):
        i, j = a[open_] + out[open_], b[open_] + out[open_]
        inside = (i < n) & (j < n)
        open_, i, j = open_[inside], i[inside], j[inside]
        open_ = open_[text[i] == text[j]]
        out[open_] += 1
        open_ = open_[out[open_] < cap]
    return out


class _Text:
    """A text with, for each place, its type (1: S), how many equal symbols end there and how many more follow."""

    def __init__(self, text: np.ndarray, scratch: Scratch, o: SortOptions):
        n = len(text)
        self.text, self.n, self.size = text, n, max(_BLOCK, o.buffer)
        self.scratch, self._dense = scratch, None
        self.kind, self.left, self.right = scratch.empty(n, np.uint8), scratch.empty(n, np.int32), scratch.empty(n, np.int32)
        self.induced = scratch.empty(n, np.uint8), scratch.empty(n, np.uint8)  # by type: which are induced by the next suffix
        start = 0
        for lo, hi in blocks(n, self.size):
            at = np.arange(lo, hi)
            new = np.append(lo == 0 or text[lo] != text[lo - 1], text[lo + 1 : hi] != text[lo : hi - 1])
            first = np.maximum.accumulate(np.where(new, at, start))
            self.left[lo:hi], start = at - first + 1, int(first[-1])
        self.kind[n - 1] = after = 1
        stop = n - 1
        for lo, hi in reversed(list(blocks(n - 1, self.size))):
            a, b = text[lo:hi], text[lo + 1 : hi + 1]
            equal = a == b
            at = np.arange(lo, hi)
            last = np.minimum.accumulate(np.where(equal, stop, at)[::-1])[::-1]
            s = np.append((a < b).astype(np.uint8), np.uint8(after))
            self.kind[lo:hi] = s[np.where(last < hi, last - lo, hi - lo)]
            self.right[lo:hi] = last - at
            for want in (0, 1):
                self.induced[want][lo:hi] = (self.kind[lo:hi] == want) & (last == at)
            stop, after = int(last[0]), int(self.kind[lo])

    def dense(self, sign: int) -> np.ndarray:
        """Numbers of the symbols in the order of ``sign`` times them, for a text of one range."""
        if self._dense is None:
            found, number = np.unique(self.text, return_inverse=True)
            self._dense = self.scratch.keep(number.astype(np.int32)), len(found)
        return self._dense[0] if sign > 0 else self._dense[1] - 1 - self._dense[0]

    def stars(self, at: np.ndarray) -> np.ndarray:
        """Which places are of type S after one of type L."""
        return (self.kind[at] == 1) & (at > 0) & (self.kind[np.maximum(at - 1, 0)] == 0)


def _bounds(text: np.ndarray, sign: int, size: int) -> np.ndarray:
    """Symbols that part the suffixes into ranges of about ``size``, from a regular sample; frequent ones are ranges of their own."""
    n = -(-len(text) // size)
    if n < 2:
        return np.zeros(0, np.int64)
    some = np.sort(text[:: max(1, len(text) // 100_000)] * sign)
    at = some[np.arange(1, n) * len(some) // n]
    hot = at[:-1][at[1:] == at[:-1]]
    return np.unique(np.concatenate([at, hot + 1]))


class _Sweep:
    """Suffixes of type ``want`` induced by sorted ``seeds``, in order of ``sign`` times the symbol.

    Within a symbol the induced come first, then its seeds, which are induced from
    too. Gives places and common prefixes with the suffix before, of the induced or
    with ``with_seeds`` of all; without ``seed_lcp`` prefixes are zero.
    """

    def __init__(self, t: _Text, want: int, seeds: np.ndarray, seed_lcp: np.ndarray | None, sign: int, o: SortOptions, scratch: Scratch, with_seeds: bool):
        self.t, self.want, self.seeds, self.seed_lcp, self.sign, self.o, self.scratch = t, want, seeds, seed_lcp, sign, o, scratch
        self.with_seeds, self.cap = with_seeds, o.cap if seed_lcp is not None else 0
        self.bounds = _bounds(t.text, sign, o.range_size)
        self.waiting = _Ranges(scratch, _TUPLE, len(self.bounds) + 1, t.size)
        self.out_p, self.out_l = Log(scratch, np.int64, t.size), Log(scratch, np.uint8, t.size)
        self.minima = _Minima(scratch, t.n) if self.cap else None
        self.order = 0
        self.last = None
        self.dense: np.ndarray | None = None

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        t, n_ranges = self.t, len(self.bounds) + 1
        if n_ranges == 1:
            self.dense = t.dense(self.sign)
            self._range(0, None, None, None, 0, len(self.seeds))
            return self.out_p.all(), self.out_l.all()
        symbols, pairs = _Ranges(self.scratch, np.int64, n_ranges, t.size), _Ranges(self.scratch, np.dtype([("of", np.int64), ("by", np.int64)]), n_ranges, t.size)
        for lo, hi in blocks(t.n - 1, t.size):  # the last suffix is not induced
            at = np.flatnonzero(t.kind[lo:hi] == self.want) + lo
            c = t.text[at] * self.sign
            r = np.searchsorted(self.bounds, c, "right")
            symbols.add(r, c)
            end = np.flatnonzero(t.right[at] == 0)
            by = t.text[at[end] + 1] * self.sign
            end, by = end[(inside := np.searchsorted(self.bounds, by, "right") == r[end])], by[inside]
            both = np.empty(len(end), pairs.logs[0].dtype)
            both["of"], both["by"] = c[end], by
            pairs.add(r[end], both)
        edges = np.zeros(len(self.bounds), np.int64)
        for lo, hi in blocks(len(self.seeds), t.size):
            edges += np.searchsorted(t.text[self.seeds[lo:hi]] * self.sign, self.bounds, "left")
        edges = [0, *edges.tolist(), len(self.seeds)]
        for r in range(n_ranges):
            low, high = (int(self.bounds[r - 1]) if r else None), (int(self.bounds[r]) if r < n_ranges - 1 else None)
            if low is not None and high == low + 1:
                self._one_symbol(r, low, edges[r], edges[r + 1])
            else:
                self._range(r, high, symbols.logs[r].all(), pairs.logs[r].all(), edges[r], edges[r + 1])
            for logs in (symbols, pairs, self.waiting):
                logs.logs[r].drop()
        return self.out_p.all(), self.out_l.all()

    def _range(self, r: int, high: int | None, symbols: np.ndarray, pairs: np.ndarray, s: int, s_end: int) -> None:
        """Lay out a range's tuples and seeds by symbol and take them group by group."""
        t = self.t
        own = np.asarray(self.seeds[s:s_end])
        if self.dense is not None:
            at = (t.kind[:-1] == self.want).nonzero()[0]
            seeded = self.dense[own]
            count = np.bincount(self.dense[at]) if len(at) else np.zeros(1, np.int64)
            n_seeds = np.bincount(seeded, minlength=len(count))
            count = np.append(count, np.zeros(len(n_seeds) - len(count), np.int64)) + n_seeds
            at = at[t.right[at] == 0]
            of, by = self.dense[at], self.dense[at + 1]
            c = None
        else:
            own_c = t.text[own] * self.sign
            c, count = np.unique(np.concatenate([symbols, own_c]), return_counts=True)
            seeded = np.searchsorted(c, own_c)
            n_seeds = np.bincount(seeded, minlength=len(c))
            of, by = np.searchsorted(c, pairs["of"]), np.searchsorted(c, pairs["by"])
        if not len(count):
            return
        first = np.concatenate([[0], np.cumsum(count)])
        slots = np.zeros(first[-1], _TUPLE)
        place, arrival, run = (np.ascontiguousarray(slots[f]) for f in _TUPLE.names)
        del slots
        seed = np.zeros(first[-1], bool)
        given = np.zeros(first[-1], np.uint8)
        rank = np.arange(len(own)) - np.repeat(np.cumsum(n_seeds) - n_seeds, n_seeds)
        at = first[1:][seeded] - n_seeds[seeded] + rank
        place[at], seed[at] = own, True
        if self.cap:
            given[at] = self.seed_lcp[s:s_end]
        free = first[:-1].copy()

        def put(q: np.ndarray, w: np.ndarray, k: np.ndarray | int, symbol: np.ndarray | None) -> None:
            u = self.dense[q] if symbol is None else np.searchsorted(c, symbol)
            if len(u) > 1:
                by = u.argsort(kind="stable")
                u, q, w = u[by], q[by], w[by]
                k = k[by] if isinstance(k, np.ndarray) else k
                new = np.empty(len(u), bool)
                new[0] = True
                np.not_equal(u[1:], u[:-1], out=new[1:])
                edge = new.nonzero()[0]
                nth = np.arange(len(u))
                size = np.empty(len(edge), np.int64)
                size[:-1], size[-1] = edge[1:] - edge[:-1], len(u) - edge[-1]
                to = free[u] + nth - edge.repeat(size)
                free[u[edge]] += size
            else:
                to = free[u]
                free[u] += 1
            place[to], arrival[to] = q, w
            if isinstance(k, np.ndarray):
                run[to] = k

        rows = self.waiting.logs[r].all()
        for lo, hi in blocks(len(rows), t.size):
            x = rows[lo:hi]
            put(x["place"], x["arrival"], x["run"], None if c is None else t.text[x["place"]] * self.sign)
        least = np.full(len(count), -1)
        np.maximum.at(least, of, by)
        begin, starts = 0, [0]
        for i, by in enumerate(least.tolist()):
            if by >= begin and i:
                starts.append(begin := i)
        symbol = np.repeat(np.arange(len(count)), count)
        for a, b in zip(starts, [*starts[1:], len(count)], strict=True):
            x, y = int(first[a]), int(first[b])
            p, w, k, d, g, u = place[x:y], arrival[x:y], run[x:y], seed[x:y], given[x:y], symbol[x:y]
            if k.any():
                by = np.lexsort((np.where(d, 0, k), u * 2 + d))
                p, w, k = p[by], w[by], k[by]
            self._take(p, w, k, d, g, u, high, put, r)

    def _one_symbol(self, r: int, symbol: int, s: int, s_end: int) -> None:
        """A frequent symbol, in parts: suffixes that a smaller one follows, those in runs, then seeds."""
        t, rows = self.t, self.waiting.logs[r].all()
        runs = []
        zero = lambda n, kind=np.int64: np.zeros(n, kind)

        def take(x: np.ndarray) -> None:
            for lo, hi in blocks(len(x), t.size):
                y = x[lo:hi]
                self._take(y["place"], y["arrival"], y["run"], zero(len(y), bool), zero(len(y), np.uint8), zero(len(y)), symbol + 1, None, r)

        self.last = None
        for lo, hi in blocks(len(rows), t.size):
            x = rows[lo:hi]
            runs.append(x[x["run"] > 0])
            take(x[x["run"] == 0])
        runs = np.concatenate(runs) if runs else rows
        take(runs[np.argsort(runs["run"], kind="stable")])
        for lo, hi in blocks(s_end - s, t.size):
            own = np.asarray(self.seeds[s + lo : s + hi])
            given = np.asarray(self.seed_lcp[s + lo : s + hi]) if self.cap else zero(len(own), np.uint8)
            self._take(own, zero(len(own)), zero(len(own)), np.ones(len(own), bool), given, zero(len(own)), symbol + 1, None, r)
        self.last = None

    def _take(self, p: np.ndarray, w: np.ndarray, k: np.ndarray, d: np.ndarray, g: np.ndarray, u: np.ndarray, high: int | None, put: object, r: int) -> None:
        """The next suffixes in order: places, arrivals, runs, whether seeds, given prefixes and symbols. None induces another."""
        n, t = len(p), self.t
        if not n:
            return
        lcp = np.zeros(n, np.uint8)
        seeds = bool(d.any())
        if self.cap:
            self._prefixes(lcp, p, w, k, d, g, u, seeds, put is None)
            self.minima.add(lcp)
        if self.with_seeds or not seeds:
            self.out_p.add(p)
            self.out_l.add(lcp)
        else:
            own = (~d).nonzero()[0]
            self.out_p.add(p[own])
            self.out_l.add(lcp[own])
        ok = t.induced[self.want][p - 1].nonzero()[0]  # nothing stands before the first, and the last is not induced
        self.order += n
        if not len(ok):
            return
        q, w = p[ok] - 1, ok + (self.order - n)
        size = t.left[q]
        run: np.ndarray | int = 0
        if len(q) < (total := int(size.sum())):
            run = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            q, w = np.repeat(q, size) - run, np.repeat(w, size)
        if self.dense is not None:
            put(q, w, run, None)
            return
        c = t.text[q] * self.sign
        if high is not None:
            far = (c >= high).nonzero()[0]
            if len(far):
                tuples = np.empty(len(far), _TUPLE)
                tuples["place"], tuples["arrival"], tuples["run"] = q[far], w[far], run[far] if isinstance(run, np.ndarray) else 0
                self.waiting.add(np.searchsorted(self.bounds, c[far], "right"), tuples)
                here = (c < high).nonzero()[0]
                q, w, c, run = q[here], w[here], c[here], run[here] if isinstance(run, np.ndarray) else 0
        if len(q):
            put(q, w, run, c)

    def _prefixes(self, lcp: np.ndarray, p: np.ndarray, w: np.ndarray, k: np.ndarray, d: np.ndarray, g: np.ndarray, u: np.ndarray, seeds: bool, parts: bool) -> None:
        """The common prefix of each suffix with the one before it; ``parts``: they go on where the last ones ended."""
        more = parts and self.last is not None
        if more:
            p, w, k, d, g, u = (np.append(x[:1], y) for x, y in zip((*self.last, g[:1], u), (p, w, k, d, g, u), strict=True))
        if parts:
            self.last = tuple(x[-1:].copy() for x in (p, w, k, d))
        i = (u[1:] == u[:-1]).nonzero()[0] + 1
        if not len(i):
            return
        value = np.empty(len(i), np.int64)
        plain = np.arange(len(i))
        if seeds or more:
            now, before = d[i], d[i - 1]
            both = (now & before).nonzero()[0]
            value[both] = g[i[both]]
            turn = (now & ~before).nonzero()[0]
            value[turn] = np.minimum(k[i[turn] - 1], self.t.right[p[i[turn]]]) + 1
            plain = (~now).nonzero()[0]
        if len(plain):
            j = i[plain]
            a, b = k[j - 1], k[j]
            if a.any() or b.any():
                apart = (a != b).nonzero()[0]
                value[plain[apart]] = np.minimum(a[apart], b[apart]) + 1
                same = (a == b).nonzero()[0]
                j, plain, b = j[same], plain[same], b[same]
            if len(j):
                value[plain] = b + 1 + self.minima.least(w[j - 1] + 1, w[j])
        lcp[i - 1 if more else i] = np.minimum(value, self.cap)


def suffix_order(text: np.ndarray, scratch: Scratch, options: SortOptions | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes but the last, largest suffix first, and the common
    prefix of each with the one listed before it, up to the cap; both mapped files.

    ``text`` are signed 64-bit symbols; the last is the least and occurs once.
    """
    o = options or SortOptions()
    n = len(text)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    t = _Text(text, scratch, o)
    found = Log(scratch, np.int64, t.size)
    for lo, hi in blocks(n, t.size):
        at = np.arange(lo, hi)
        found.add(at[t.stars(at)])
    stars = found.all()
    m = len(stars)
    lcp = scratch.empty(m, np.uint8)
    if m > 1:
        # stretches from star to star in order: two sweeps from stars in order of their symbol only
        larger, _ = _Sweep(t, 0, _by_symbol(t, stars, scratch, o), None, 1, o, scratch, False).run()
        smaller, _ = _Sweep(t, 1, larger[::-1], None, -1, o, scratch, False).run()
        name, names = _names(t, stars, smaller[::-1], scratch)
        order = scratch.empty(m, np.int64)
        seeds = scratch.empty(m, np.int64)
        if names < m:
            falling, common = suffix_order(name, scratch, o)
            order[0] = m - 1
            for lo, hi in blocks(m - 1, t.size):
                order[1 + lo : 1 + hi] = falling[::-1][lo:hi]
        else:
            common = None
            for lo, hi in blocks(m, t.size):
                order[name[lo:hi]] = np.arange(lo, hi)
        for lo, hi in blocks(m, t.size):
            own = order[lo:hi]
            seeds[lo:hi] = stars[own]
            before = np.append(seeds[max(0, lo - 1)], seeds[lo : hi - 1])
            share = np.zeros(hi - lo, np.int64)
            if common is not None and m > 2:
                later = np.arange(max(2, lo), max(2, hi))
                share[later - lo] = common[m - later]
            # as many stretches as agree are as many symbols as they cover
            known = stars[np.minimum(own + share, m - 1)] - seeds[lo:hi]
            lcp[lo:hi] = _common(text, seeds[lo:hi], before, known, o.cap)
        lcp[0] = 0
    else:
        seeds = stars
    larger, l_lcp = _Sweep(t, 0, seeds, lcp, 1, o, scratch, False).run()
    falling_lcp = scratch.empty(len(larger), np.uint8)  # with the one before in falling order
    for lo, hi in blocks(len(larger) - 1, t.size):
        falling_lcp[1 + lo : 1 + hi] = l_lcp[::-1][lo:hi]
    return _Sweep(t, 1, larger[::-1], falling_lcp, -1, o, scratch, True).run()


def _by_symbol(t: _Text, stars: np.ndarray, scratch: Scratch, o: SortOptions) -> np.ndarray:
    """The stars in the order of their symbols, range by range."""
    bounds = _bounds(t.text, 1, o.range_size)
    parts = _Ranges(scratch, np.int64, len(bounds) + 1, t.size)
    for lo, hi in blocks(len(stars), t.size):
        own = stars[lo:hi]
        parts.add(np.searchsorted(bounds, t.text[own], "right"), own)
    out, at = scratch.empty(len(stars), np.int64), 0
    for r, log in enumerate(parts.logs):
        own = log.all()
        if not (0 < r < len(bounds) and bounds[r] == bounds[r - 1] + 1):
            own = own[np.argsort(t.text[own], kind="stable")]
        for lo, hi in blocks(len(own), t.size):
            out[at + lo : at + hi] = own[lo:hi]
        at += len(own)
        log.drop()
    return out


def _names(t: _Text, stars: np.ndarray, sorted_s: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, int]:
    """Ranks of the stretches from each star to the next, equal for equal ones, by place in the text, and how many there are.

    ``sorted_s``: all S suffixes but the last, sorted by their stretches.
    """
    m = len(stars)
    nth, out = scratch.empty(t.n, np.int64), scratch.empty(m, np.int64)
    for lo, hi in blocks(m, t.size):
        nth[stars[lo:hi]] = np.arange(lo, hi)
    rank, before = 0, m - 1  # the last star is the least, by itself
    for lo, hi in blocks(len(sorted_s), t.size):
        own = sorted_s[lo:hi]
        own = nth[own[t.stars(own)]]
        if not len(own):
            continue
        prev = np.append(before, own[:-1])
        a, b = stars[own], stars[prev]
        size = stars[np.minimum(own + 1, m - 1)] - a
        new = np.ones(len(own), bool)
        alive = np.flatnonzero(size == stars[np.minimum(prev + 1, m - 1)] - b)
        step = 0
        while len(alive):  # equal up to and with the next star
            alive = alive[t.text[a[alive] + step] == t.text[b[alive] + step]]
            done = size[alive] == step
            new[alive[done]] = False
            alive = alive[~done]
            step += 1
        ranks = rank + np.cumsum(new)
        out[own] = ranks
        rank, before = int(ranks[-1]), int(own[-1])
    return out, rank + 1
