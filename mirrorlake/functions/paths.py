"""Paths, names, sizes and dates as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: C) -> Column:
    return F.substring_index(_col(path), "/", -1)


def dirname(path: C) -> Column:
    """All before the last slash; the slash itself for what stands in the root."""
    p = _col(path)
    up = F.regexp_replace(p, "/[^/]*$", "")
    return F.when(~p.contains("/"), F.lit("")).when(up == "", F.lit("/")).otherwise(up)


def extension(name: C) -> Column:
    """From the last dot that has something but dots before it; lower case, dot included."""
    return F.lower(F.regexp_extract(_col(name), r"[^.].*(\.[^.]*)$", 1))


def stem(name: C) -> Column:
    n = _col(name)
    return F.substring(n, F.lit(1), F.length(n) - F.length(extension(n)))


def glob_regex(globs: Sequence[str]) -> str | None:
    """One anchored expression for all shell patterns; case counts. None without any."""

    def one(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            c = glob[i]
            close = glob.find("]", i + 2) if c == "[" else -1
            if c == "[" and close > 0:
                body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                out += "[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]"
                i = close
            else:
                out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
            i += 1
        return out

    found = [one(g) for g in globs if g]
    return "(?s)^(?:" + "|".join(found) + ")\\z" if found else None


def not_excluded(name: C, parent: C, globs: Sequence[str], dirs: Sequence[str]) -> Column:
    """Whether neither the name matches a pattern nor a folder above it is left out."""
    test = F.lit(True)
    if pattern := glob_regex(globs):
        test = ~_col(name).rlike(pattern)
    if dirs:
        test = test & ~F.arrays_overlap(F.split(_col(parent), "/"), F.array(*map(F.lit, dirs)))
    return test


def size_in_range(size: C, least: int, most: int) -> Column:
    s = _col(size)
    return (s >= least) & (s <= most) if most else s >= least


def allowed(path: C, roots: Sequence[str]) -> Column:
    """Equal to or below one of the roots; without roots everything is allowed."""
    if not roots:
        return F.lit(True)
    p = _col(path)
    tests = [(p == r.rstrip("/")) | p.startswith(r.rstrip("/") + "/") for r in roots]
    return reduce(lambda a, b: a | b, tests)


def share_root(path: C, roots: Sequence[str]) -> Column:
    """The root and the first folder below it; null outside all roots."""
    p = _col(path)
    parts = [F.when(p.startswith(r.rstrip("/") + "/"), F.concat(F.lit(r.rstrip("/") + "/"), F.substring_index(F.substring(p, len(r.rstrip("/")) + 2, 1 << 30), "/", 1))) for r in roots]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def below(path: C, root: C) -> Column:
    """``path`` as seen from ``root``; its last name if it is elsewhere."""
    p, r = _col(path), F.rtrim(_col(root), F.lit("/"))
    inside = F.startswith(p, F.concat(r, F.lit("/")))
    return F.when(inside, F.substring(p, F.length(r) + 2, F.length(p))).otherwise(basename(p))


def human_bytes(n: C, units: Sequence[str] = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")) -> Column:
    """Bytes in the largest unit of 1,024 that gives at least one; whole bytes, else one decimal, halves to the even one as C's printf has it."""
    v = _col(n)
    out = F.when(v.isNotNull(), F.format_string(f"%d {units[0]}", v))
    for k, unit in enumerate(units[1:], 1):
        out = F.when(v >= (1 << 10 * k), F.format_string(f"%.1f {unit}", F.bround(v / (1 << 10 * k), 1))).otherwise(out)
    return out


def day(epoch: C) -> Column:
    """The date of seconds since 1970, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(_col(epoch)), "yyyy-MM-dd")


def bit_length(n: C) -> Column:
    v = _col(n)
    return F.when(v > 0, F.length(F.bin(v))).otherwise(0)


def signature_blocksize(size: C, most: int = 0) -> Column:
    """Block size that a signature of so many bytes begins with; 0 below 192 bytes.

    The least 3 * 2**k that fits the bytes read into 64 blocks, in whole numbers.
    """
    s = _col(size)
    span = F.least(s, F.lit(most)) if most > 0 else s
    k = bit_length(F.floor((span - 1) / 192).cast("long"))
    return F.when(s < 192, F.lit(0)).otherwise(F.expr("3") * F.call_function("shiftleft", F.lit(1).cast("long"), k)).cast("long")


def parsed_blocksize(signature: C) -> Column:
    return F.coalesce(F.split(_col(signature), ":")[0].try_cast("int"), F.lit(0))
