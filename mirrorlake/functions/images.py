"""Pictures: difference hashes, sizes, and what a camera wrote into them.

Only headers and tags are parsed here, with the standard library; pixels come
from Spark's image source, or from any decoder the caller has.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = tuple("." + e for e in "bmp gif heic heif jpeg jpg png tif tiff webp".split())
META = "width int, height int, format string, taken string, camera string"
_EXIF, _MAKE, _MODEL, _CHANGED, _TAKEN, _SCANNED = 0x8769, 0x010F, 0x0110, 0x0132, 0x9003, 0x9004


def shrink(gray: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means over equal areas, with the shares of pixels that lie on an edge."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        at = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None) * m / n

    h, w = gray.shape
    return weights(h, rows) @ gray.astype(float) @ weights(w, cols).T


def dhash(gray: np.ndarray) -> int:
    """64 bits, row by row: whether a point of the 9 by 8 picture is brighter than the next; as a signed number."""
    small = np.rint(shrink(gray, 8, 9))
    bits = int("".join("1" if b else "0" for b in (small[:, :-1] > small[:, 1:]).ravel()), 2)
    return bits - (1 << 64) if bits >> 63 else bits


def to_gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Brightness of the pixels as the image source stores them, blue first."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return px[:, :, 0] if channels == 1 else np.rint(px[:, :, 2] * 0.299 + px[:, :, 1] * 0.587 + px[:, :, 0] * 0.114)


def dhash_column(image: Column) -> Column:
    """:func:`dhash` of the image source's struct; null where it could not decode."""

    @F.pandas_udf("long")
    def run(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        ok = lambda d, h, w: d is not None and h > 0 and w > 0
        return pd.Series([dhash(to_gray(d, int(h), int(w), int(c))) if ok(d, h, w) else None for d, h, w, c in zip(data, height, width, channels, strict=True)], dtype="Int64")

    return run(image["data"], image["height"], image["width"], image["nChannels"])


def dhash_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def taken(original: Column, digitized: Column, changed: Column) -> Column:
    """The first that is given, with dashes for the colons of the date."""
    tidy = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.regexp_replace(F.coalesce(tidy(original), tidy(digitized), tidy(changed)), "^([^:]*):([^:]*):", "$1-$2-")


def camera(make: Column, model: Column) -> Column:
    """Make and model, without a make that the model begins with."""
    a, b = (F.nullif(F.trim(c), F.lit("")) for c in (make, model))
    told = F.coalesce(F.startswith(F.lower(b), F.lower(F.substring_index(a, " ", 1))), F.lit(False))
    return F.nullif(F.concat_ws(" ", F.when(~told, a), b), F.lit(""))


def _tags(data: bytes) -> dict[int, str | int]:
    """Texts and numbers of a TIFF block's first directory and the camera's own."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return {}
    out: dict[int, str | int] = {}
    todo = [struct.unpack_from(order + "I", data, 4)[0]]
    seen: set[int] = set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            p = at + 2 + 12 * k
            if p + 12 > len(data):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", data, p)
            if kind == 2:
                q = p + 8 if n <= 4 else struct.unpack_from(order + "I", data, p + 8)[0]
                out.setdefault(tag, data[q : q + n].decode("utf-8", "replace").replace("\0", " ").strip())
            elif kind in (3, 4):
                out.setdefault(tag, struct.unpack_from(order + ("H" if kind == 3 else "I"), data, p + 8)[0])
                if tag == _EXIF:
                    todo.append(int(out[tag]))
    return out


def meta(data: bytes | None) -> dict[str, object] | None:
    """Width, height, format, date and camera, as far as the bytes tell; null for no picture."""
    if not data:
        return None
    w = h = None
    kind, tags = None, {}
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            kind, (w, h) = "PNG", struct.unpack_from(">II", data, 16)
        elif data[:4] == b"GIF8":
            kind, (w, h) = "GIF", struct.unpack_from("<HH", data, 6)
        elif data[:2] == b"BM":
            kind, (w, h) = "BMP", struct.unpack_from("<ii", data, 18)
            h = abs(h)
        elif data[:2] in (b"II", b"MM"):
            kind, tags = "TIFF", _tags(data)
            w, h = tags.get(0x0100), tags.get(0x0101)
        elif data[:2] == b"\xff\xd8":
            kind, at = "JPEG", 2
            while at + 4 <= len(data) and data[at] == 0xFF:
                mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
                if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    tags = _tags(data[at + 10 : at + 2 + size])
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack_from(">HH", data, at + 5)
                    break
                at += 2 + size
    except struct.error:
        return None
    if kind is None:
        return None
    when = next((str(tags[t]) for t in (_TAKEN, _SCANNED, _CHANGED) if tags.get(t)), None)
    make, model = (str(tags.get(t) or "") for t in (_MAKE, _MODEL))
    if make and model and model.lower().startswith(make.split()[0].lower()):
        make = ""
    return {"width": w, "height": h, "format": kind, "taken": when.replace(":", "-", 2) if when else None, "camera": " ".join(x for x in (make, model) if x) or None}


def meta_column(content: Column) -> Column:
    """Struct of :data:`META`."""

    @F.pandas_udf(META)
    def run(c: pd.Series) -> pd.DataFrame:
        rows = [meta(x) or {} for x in c]
        column = lambda k, kind: pd.Series([r.get(k) for r in rows], dtype=kind)
        return pd.DataFrame({k: column(k, "Int32" if k in ("width", "height") else object) for k in ("width", "height", "format", "taken", "camera")})

    return F.when(content.isNotNull(), run(content))


def thumbnail(data: bytes | None, side: int = 360) -> bytes | None:
    """A JPEG of at most ``side`` pixels, upright; null if Pillow is missing or can't read it."""
    try:
        import io

        from PIL import Image, ImageOps
    except ImportError:
        return None
    try:
        with Image.open(io.BytesIO(data or b"")) as im:
            small = ImageOps.exif_transpose(im).convert("RGB")
            small.thumbnail((side, side))
            small.save(out := io.BytesIO(), "JPEG", quality=80)
            return out.getvalue()
    except Exception:  # any broken picture
        return None
