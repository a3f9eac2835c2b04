"""Vectorised reading of texts: Arrow buffers in, numpy arrays out.

A batch of strings is one byte buffer with offsets, so words, their hashes and
shingles are found for all its documents at once, without a Python object per
word. A word is a run of letters, marks, numbers and underscores of any script;
all other characters, such as quotes, dashes and spaces beyond ASCII too, part
words. In scripts that are written without spaces (Han, kana, Thai, Lao, Burmese,
Khmer) each character is a word. Callers lower the case in the JVM first where it
matters; composed and decomposed letters differ. Null texts count as empty ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes handled at once; keeps the working arrays inside the CPU's caches.
PIECE = 1 << 19

_C = np.arange(256)
IS_DIGIT = (_C >= 48) & (_C <= 57)
IS_UPPER = (_C >= 65) & (_C <= 90)
IS_LOWER = (_C >= 97) & (_C <= 122)
IS_WORD = IS_DIGIT | IS_UPPER | IS_LOWER | (_C == 95) | (_C >= 128)
IS_SPACE = (_C == 32) | ((_C >= 9) & (_C <= 13))
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


#: What a byte belongs to: what parts words, a word, a character that is a word, or the first byte of a mark.
GAP, WORD, ALONE, MARK = range(4)
_ASCII = np.where(IS_WORD, WORD, np.where(IS_SPACE, GAP, MARK)).astype(np.uint8)
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FE), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The class of each code point; all of planes 2 and 3 are Han."""
    out = np.full(0x110000, MARK, np.uint8)
    names = [unicodedata.category(chr(c))[0] for c in range(0x20000)]
    out[: len(names)] = [WORD if x in "LMN" else GAP if x in "ZC" else MARK for x in names]
    for lo, hi in _UNSPACED:
        own = out[lo : hi + 1]
        own[own == WORD] = ALONE
    out[0x20000:0x40000] = ALONE
    return out


def classes(piece: np.ndarray) -> np.ndarray:
    """The class of each byte of whole characters; bytes after the first of a mark part words."""
    out = _ASCII[piece]
    lead = np.flatnonzero(piece >= 0xC0)
    if not len(lead):
        return out
    b = piece[lead].astype(np.int64)
    size = 2 + (b >= 0xE0) + (b >= 0xF0)
    code = np.where(size == 2, b & 0x1F, np.where(size == 3, b & 0x0F, b & 0x07))
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        code[more] = code[more] << 6 | piece[np.minimum(lead[more] + k, len(piece) - 1)] & 0x3F
    kind = _kinds()[np.minimum(code, 0x10FFFF)]
    odd = np.flatnonzero(kind != WORD)
    if len(odd):
        at, kind, size = lead[odd], kind[odd], size[odd]
        for k in range(3, 0, -1):
            more = size > k
            out[np.minimum(at[more] + k, len(piece) - 1)] = np.where(kind[more] == MARK, GAP, kind[more])
        out[at] = kind
    return out


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of an array of strings; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs.astype(np.int64)


def slices(offs: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes, at least one document each."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def runs(raw: np.ndarray, offs: np.ndarray, table: np.ndarray = IS_WORD) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Maximal runs of bytes in ``table``, never across documents, piece by piece.

    Yields the piece's first byte, its bytes, and where runs start and end in it.
    A piece ends where no run is cut, so very long documents need little memory.
    For words, ``table`` being ``IS_WORD``, characters beyond ASCII count as :func:`classes` says.
    """
    pos, end = int(offs[0]), int(offs[-1])
    while pos < end:
        stop = min(pos + PIECE, end)
        while stop < end and table[raw[stop]] and table[raw[stop - 1]]:
            near = offs[np.searchsorted(offs, stop)]
            far = min(int(near), stop + PIECE)
            gap = np.flatnonzero(~table[raw[stop:far]])
            stop = stop + int(gap[0]) if len(gap) else far
            if stop == near:
                break
        piece = raw[pos:stop]
        kind = classes(piece) if table is IS_WORD else None
        inside = table[piece] if kind is None else (kind == WORD) | (kind == ALONE)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        if kind is not None and (alone := np.flatnonzero((kind == ALONE) & ((piece & 0xC0) != 0x80))).size:
            width = 2 + (piece[alone] >= 0xE0).astype(np.int64) + (piece[alone] >= 0xF0)
            first[alone] = last[alone + width - 1] = True
            before, after = alone[alone > 0] - 1, (alone + width)[alone + width < len(piece)]
            last[before] |= inside[before]
            first[after] |= inside[after]
        cuts = offs[np.searchsorted(offs, pos, "right") : np.searchsorted(offs, stop, "left")] - pos
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        yield pos, piece, np.flatnonzero(first), np.flatnonzero(last) + 1
        pos = stop


def hashes(piece: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, equal for equal bytes anywhere."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(max(2 * PIECE, 1 << int(len(piece)).bit_length()))
    total = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(_VALUE[piece] * up[: len(piece)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the documents, and n + 1 places where documents begin."""
    out, at = [], []
    for pos, piece, start, end in runs(raw, offs):
        out.append(hashes(piece, start, end))
        at.append(start + pos)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    return np.concatenate(out), np.searchsorted(np.concatenate(at), offs)


def shingles(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row within documents, with n + 1 places.

    A document of fewer than k words has none; see :func:`sets` for one shingle
    of whatever it has.
    """
    n = len(word)
    count = np.maximum(np.diff(first) - k + 1, 0)
    place = np.concatenate([[0], np.cumsum(count)])
    if n < k:
        return np.zeros(0, np.uint64), place
    all_ = word[: n - k + 1].copy()
    factor = 1
    for j in range(1, k):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        all_ += word[j : n - k + 1 + j] * np.uint64(factor)
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, first[:-1][count > 0], 1)
    np.add.at(valid, (first[:-1] + count)[count > 0], -1)
    return mix(all_[np.cumsum(valid)[: n - k + 1] > 0]), place


def sets(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`shingles`, but a document of 1 to k - 1 words has one shingle, of all its words."""
    got, place = shingles(word, first, k)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return got, place
    extra = np.array([mix(np.array([sum((int(w) * pow(0xA24BAED4963EE407, j + 1, 1 << 64)) for j, w in enumerate(word[first[d] : first[d + 1]])) % (1 << 64)], np.uint64))[0] for d in short], np.uint64)
    count = np.diff(place)
    count[short] = 1
    at = place[short]
    return np.insert(got, at, extra), np.concatenate([[0], np.cumsum(count)])


def per_doc(reduce: np.ufunc, values: np.ndarray, place: np.ndarray, empty: object) -> np.ndarray:
    """``reduce`` over each document's values along the first axis; ``empty`` where there are none."""
    n = np.diff(place)
    out = np.full((len(n), *values.shape[1:]), empty, values.dtype)
    some = n > 0
    if some.any():
        out[some] = reduce.reduceat(values, place[:-1][some], axis=0)
    return out


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
