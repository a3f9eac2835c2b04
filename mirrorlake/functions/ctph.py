"""Context-triggered piecewise hashing, after Kornblum (2006), a batch at a time.

The rolling hash at a byte depends on the seven bytes up to it only, so it is a
sum of shifted arrays. Of a piece's hash only the value mod 64 is ever shown, and
bit k of ``19 * h`` is bit k of h, flipped by something that the lower bits
decide. So each of the six bits is one running XOR over all the bytes of a batch,
whatever the number of pieces.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
WINDOW, LENGTH, LEAST = 7, 64, 3


def first_blocksize(size: int, most: int = 0) -> int:
    if size < LEAST * LENGTH:
        return 0
    span = min(size, most) if most > 0 else size
    return LEAST << max(0, (span - 1) // (LEAST * LENGTH)).bit_length()


def rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, before which there are zeros."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    n = len(data)
    total, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for k in range(WINDOW):  # k bytes back
        x = padded[WINDOW - 1 - k : WINDOW - 1 - k + n]
        total += x * np.uint32(1 + WINDOW - k)
        mixed ^= x << np.uint32(5 * k)
    return total + mixed


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash mod 64 of each stretch; the stretches follow one another and cover ``data``."""
    n = len(data)
    size = ends - starts
    first = starts[size > 0]
    low = np.zeros(n, np.uint8)  # lower bits of the hash before each byte
    for k in range(6):
        step = ((low * np.uint8(19)) >> np.uint8(k) & np.uint8(1)) ^ (data >> np.uint8(k) & np.uint8(1))
        run = np.bitwise_xor.accumulate(step)
        before = np.zeros(n, np.uint8)
        before[1:] = run[:-1]
        base = np.repeat(before[first], size[size > 0])
        bit = before ^ base ^ np.uint8(39 >> k & 1)
        low |= bit << np.uint8(k)
    out = np.full(len(starts), 39, np.uint8)
    last = ends[size > 0] - 1
    out[size > 0] = ((low[last].astype(np.int64) * 19) & 63).astype(np.uint8) ^ (data[last] & np.uint8(63))
    return out


#: Bytes of contents handled at once; keeps the working arrays inside the CPU's caches.
_BATCH = 1 << 19


def _texts(data: np.ndarray, first: np.ndarray, marks: list[np.ndarray], most: int, live: np.ndarray) -> list[str]:
    """For each content one letter for each stretch up to a mark, ``most`` at most, and if ``live`` one for the rest."""
    kept = [m[:most] + 1 for m in marks]
    inner = [np.concatenate([[a], a + m]) for a, m in zip(first[:-1], kept, strict=True)]
    starts = np.concatenate(inner)
    values = LETTERS[_pieces(data, starts, np.append(starts[1:], len(data)))].tobytes().decode()
    out, at = [], 0
    for m, end in zip(kept, live.tolist(), strict=True):
        out.append(values[at : at + len(m) + end])
        at += len(m) + 1
    return out


def _signed(parts: list[np.ndarray], sizes: list[int], most: int) -> list[str | None]:
    """Signatures of contents of 192 bytes or more, all at once."""
    gap = np.zeros(WINDOW - 1, np.uint8)  # what stands before a content is as if zero
    rolls = rolling(np.concatenate([x for p in parts for x in (gap, p)]))
    place = np.cumsum([0, *(len(p) + len(gap) for p in parts)])
    live = np.array([bool(p[-WINDOW:].any()) for p in parts])
    chosen: list[tuple[int, np.ndarray, np.ndarray] | None] = []
    for k, size in enumerate(sizes):
        roll, bs, got = rolls[place[k] + len(gap) : place[k + 1]], first_blocksize(size, most), None
        for _ in range(6):
            marks = np.flatnonzero(roll % np.uint32(bs) == bs - 1)
            if min(len(marks), LENGTH - 1) + live[k] >= LENGTH // 2 or bs <= LEAST:
                got = bs, marks, marks[roll[marks] % np.uint32(2 * bs) == 2 * bs - 1]
                break
            bs = max(LEAST, bs // 2)
        chosen.append(got)
    good = [k for k, c in enumerate(chosen) if c]
    if not good:
        return [None] * len(parts)
    data = np.concatenate([parts[k] for k in good])
    first = np.cumsum([0, *(len(parts[k]) for k in good)])
    one = _texts(data, first, [chosen[k][1] for k in good], LENGTH - 1, live[good])
    two = _texts(data, first, [chosen[k][2] for k in good], LENGTH // 2 - 1, live[good])
    out: list[str | None] = [None] * len(parts)
    for k, a, b in zip(good, one, two, strict=True):
        out[k] = f"{chosen[k][0]}:{a}:{b}"
    return out


def signatures(contents: list[bytes | None], sizes: list[int | None] | None = None, most: int = 0) -> list[str | None]:
    """"blocksize:text:text" of the first ``most`` bytes of each content, all with 0; null if short or too regular.

    The block size is halved up to five times until the first text has 32 letters.
    """
    sizes = [None] * len(contents) if sizes is None else sizes
    out: list[str | None] = [None] * len(contents)
    held: list[int] = []
    parts: list[np.ndarray] = []
    real: list[int] = []

    def flush() -> None:
        for k, v in zip(held, _signed(parts, real, most) if held else [], strict=True):
            out[k] = v
        held.clear(), parts.clear(), real.clear()

    total = 0
    for k, (content, size) in enumerate(zip(contents, sizes, strict=True)):
        if content is None:
            continue
        size = len(content) if size is None else size
        data = np.frombuffer(content, np.uint8)[: min(size, most) if most > 0 else size]
        if not first_blocksize(size, most) or not len(data):
            continue
        if total + len(data) > _BATCH:
            flush()
            total = 0
        held.append(k), parts.append(data), real.append(size)
        total += len(data)
    flush()
    return out


def signature(content: bytes | None, size: int | None = None, most: int = 0) -> str | None:
    return signatures([content], [size], most)[0]


@lru_cache(1 << 12)
def strip_runs(text: str) -> str:
    return re.sub(r"(.)\1{3,}", r"\1\1\1", text)


def _subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one machine word or two."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u) | (v - u)
    return len(a) - (v & full).bit_count()


@lru_cache(1 << 12)
def grams(text: str, n: int = 7) -> frozenset[str]:
    return frozenset(text[i : i + n] for i in range(len(text) - n + 1))


def score(a: str, b: str, blocksize: int) -> int:
    """0 to 100 for two signature texts: 100 if equal, else from their edit distance
    if they share seven letters in a row, and never more than the block size allows."""
    a, b = strip_runs(a), strip_runs(b)
    if not a or not b:
        return 0
    if a == b:
        return 100
    if grams(a).isdisjoint(grams(b)):
        return 0
    both = len(a) + len(b)
    distance = both - 2 * _subsequence(a, b)
    value = 100 - distance * LENGTH // both * 100 // LENGTH
    return max(0, min(value, blocksize * min(len(a), len(b)) // LEAST, 100))


@lru_cache(1 << 12)
def parse(text: str | None) -> tuple[int, str, str] | None:
    parts = (text or "").split(":", 2)
    return (int(parts[0]), parts[1], parts[2]) if len(parts) == 3 and re.fullmatch(r"\s*[+-]?\d+\s*", parts[0]) else None


def compare(x: str | None, y: str | None, parity: bool = False) -> int:
    """Similarity of two signatures; those whose block sizes differ by more than twice have none.

    At twice the block size the first text of the coarser is compared with the
    second of the finer, which cover the same level; with ``parity`` the other way.
    """
    p, q = parse(x), parse(y)
    if not p or not q:
        return 0
    if p[0] == q[0]:
        return max(score(p[1], q[1], p[0]), score(p[2], q[2], 2 * p[0]))
    if p[0] < q[0]:
        p, q = q, p
    if p[0] != 2 * q[0]:
        return 0
    return score(p[2], q[1], p[0]) if parity else score(p[1], q[2], p[0])


def slots(text: str | None, parity: bool = False) -> list[tuple[str, int, str]]:
    """(level, block size, text without runs) for each comparison that a signature can take part in; those of one level are compared."""
    p = parse(text)
    if not p:
        return []
    out = [(f"{p[0]}", p[0], p[1]), (f"{2 * p[0]}", 2 * p[0], p[2])]
    if parity:  # the second text of the coarser against the first of the finer
        out = [(f"a{p[0]}", p[0], p[1]), (f"b{2 * p[0]}", 2 * p[0], p[2]), (f"x{p[0]}", p[0], p[2]), (f"x{2 * p[0]}", 2 * p[0], p[1])]
    return [(level, size, t) for level, size, t in ((level, size, strip_runs(t)) for level, size, t in out) if t]


def keys(text: str | None, parity: bool = False) -> list[str]:
    """What two signatures with a positive similarity have at least one of in common."""
    out: set[str] = set()
    for level, _, t in slots(text, parity):
        out.add(f"{level}={t}")
        out.update(f"{level}:{g}" for g in grams(t))
    return sorted(out)


_PLACE = {chr(c): i for i, c in enumerate(LETTERS)}


def letter_masks(text: str, n: int = 4) -> list[int]:
    """Which of 64 letters occur at least once, twice, ... ``n`` times, as bits of signed 64-bit numbers."""
    masks = [0] * n
    for c in text:
        bit = 1 << _PLACE.get(c, ord(c) & 63)
        for k in range(n):
            if not masks[k] & bit:
                masks[k] |= bit
                break
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def may_score(x: Column, y: Column, least: int) -> Column:
    """False only if two texts (size, n, m1 to m4) of :func:`slots_column` have a score below ``least``.

    A common subsequence has no more of a letter than either text, which bounds the
    score from above, and so does the block size unless the texts are equal.
    """
    most = max((k for k in range(LENGTH + 1) if k * 100 // LENGTH <= 100 - least), default=-1)
    masks = [f"m{k}" for k in range(1, 5)]
    rest = lambda t: t["n"] - sum((F.bit_count(t[m]) for m in masks), F.lit(0))
    shared = sum((F.bit_count(x[m].bitwiseAND(y[m])) for m in masks), F.least(rest(x), rest(y)))
    same = x["n"] == y["n"]
    for m in masks:
        same = same & (x[m] == y[m])
    return (shared * 2 * LENGTH > (x["n"] + y["n"]) * (LENGTH - 1 - most)) & ((x["size"] * F.least(x["n"], y["n"]) >= LEAST * least) | same)


def signature_column(content: Column, size: Column, most: int = 0) -> Column:
    @F.pandas_udf("string")
    def run(c: pd.Series, s: pd.Series) -> pd.Series:
        known = [None if pd.isna(n) else x for x, n in zip(c, s, strict=True)]
        return pd.Series(signatures(known, [None if pd.isna(n) else int(n) for n in s], most), dtype=object)

    return run(content, size)


def compare_column(a: Column, b: Column, parity: bool = False) -> Column:
    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([compare(p, q, parity) for p, q in zip(x, y, strict=True)], dtype="int32")

    return run(a, b)


def slots_column(text: Column, parity: bool = False) -> Column:
    """An array of structs (level, size, text, n, m1 to m4) of :func:`slots`, with length and :func:`letter_masks`."""

    @F.pandas_udf("array<struct<level:string,size:long,text:string,n:int,m1:long,m2:long,m3:long,m4:long>>")
    def run(x: pd.Series) -> pd.Series:
        row = lambda level, size, t: {"level": level, "size": size, "text": t, "n": len(t), **{f"m{k}": m for k, m in enumerate(letter_masks(t), 1)}}
        return pd.Series([[row(*s) for s in slots(t, parity)] for t in x], dtype=object)

    return run(text)


def runs_column(level: Column, text: Column) -> Column:
    """An array of structs (key, before): each seven letters of a level and text, and the letter before, 0 at the start. A shorter text is its own key."""
    n = F.length(text)
    at = lambda i: F.struct(F.xxhash64(level, F.substring(text, i, F.lit(WINDOW))).alias("key"), F.when(i > 1, F.ascii(F.substring(text, i - 1, F.lit(1)))).otherwise(0).alias("before"))
    whole = F.array(F.struct(F.xxhash64(level, F.lit("="), text).alias("key"), F.lit(0).alias("before")))
    return F.when(n < WINDOW, whole).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), at))
