"""Scalar functions against values worked out by hand and slow models."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mirrorlake.functions import ctph, images, names, paths, signatures
from mirrorlake.options import TRASH, ScanOptions

LETTERS = "".join(map(chr, ctph.LETTERS))


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def serial_signature(data, most=0):
    """Byte by byte, as the method is usually described."""
    blocksize = ctph.first_blocksize(len(data), most)
    if not blocksize:
        return None
    data, mask = data[: most or None], 2**32 - 1
    for _ in range(6):
        window, plain, weighted, shifted = [0] * 7, 0, 0, 0
        h = g = 671621479
        first, second = "", ""
        for i, byte in enumerate(data):
            h, g = h * 16777619 & mask ^ byte, g * 16777619 & mask ^ byte
            weighted = weighted - plain + 7 * byte & mask
            plain = plain + byte - window[i % 7] & mask
            window[i % 7] = byte
            shifted = shifted << 5 & mask ^ byte
            r = plain + weighted + shifted & mask
            if r % blocksize == blocksize - 1 and len(first) < 63:
                first += LETTERS[h % 64]
                h = 671621479
            if r % (2 * blocksize) == 2 * blocksize - 1 and len(second) < 31:
                second += LETTERS[g % 64]
                g = 671621479
        if plain or weighted or shifted:
            first, second = first + LETTERS[h % 64], second + LETTERS[g % 64]
        if len(first) >= 32 or blocksize <= 3:
            return f"{blocksize}:{first}:{second}"
        blocksize = max(3, blocksize // 2)
    return None


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 256), st.sampled_from([0, 0, 300, 2000]), st.integers(0, 9), st.integers(0, 20))
def test_signature_equals_the_serial_one(n, letters, most, seed, zeros):
    data = bytes(random.Random(seed).choices(range(letters), k=n)) + bytes(zeros)
    assert ctph.signature(data, None, most) == serial_signature(data, most)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(1, 256), st.integers(0, 9)), max_size=8))
def test_signatures_of_a_batch_equal_the_serial_ones(rows):
    data = [random.Random(seed).randbytes(n) if letters > 200 else bytes(random.Random(seed).choices(range(letters), k=n)) for n, letters, seed in rows]
    whole, ctph._BATCH = ctph._BATCH, 4000
    try:
        assert ctph.signatures([*data, None]) == [*map(serial_signature, data), None]
    finally:
        ctph._BATCH = whole


def test_signature_edges():
    assert ctph.signature(None) is None
    assert ctph.signature(b"a" * 191) is None
    assert ctph.signature(b"hello world " * 5000) is None  # periodic: too few pieces at any block size
    assert [ctph.first_blocksize(n) for n in (191, 192, 193, 384, 385, 768)] == [0, 3, 6, 6, 12, 12]
    assert ctph.first_blocksize(1 << 40, 4 << 20) == ctph.first_blocksize(4 << 20)


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y) * 2))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=64), st.text("abc", max_size=64))
def test_subsequence_gives_the_weighted_distance(a, b):
    assert len(a) + len(b) - 2 * ctph._subsequence(a, b) == slow_distance(a, b)


def test_scores():
    assert ctph.strip_runs("aaaaabbbcc") == "aaabbbcc"
    assert ctph.score("abcdefgh", "abcdefgh", 3) == 100
    assert ctph.score("", "abc", 3) == 0
    assert ctph.score("abcdefg1", "1abcdef", 96) == 0  # six in common
    assert ctph.score("abcdefghij", "abcdefghik", 3072) == 100 - (2 * 64 // 20) * 100 // 64
    assert ctph.score("abcdefghij", "abcdefghik", 3) == 10  # capped by the block size
    assert ctph.compare("x", "3:a:b") == ctph.compare(None, "3:a:b") == 0
    s = "ABCDEFGHIJKLMNOP"
    assert ctph.compare(f"96:{s}:zz", f"48:yy:{s}") == 100  # the same level
    assert ctph.compare(f"96:zz:{s}", f"48:{s}:yy", parity=True) == 100
    assert ctph.compare(f"96:{s}:zz", f"24:yy:{s}") == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.booleans())
def test_keys_miss_no_positive_score(seed, parity):
    r = random.Random(seed)
    base = "".join(r.choices("abcdefgh", k=r.randint(1, 40)))
    other = base[r.randint(0, 5) :] + "".join(r.choices("abcd", k=r.randint(0, 9)))
    x, y = f"{r.choice([3, 6])}:{base}:{other}", f"{r.choice([3, 6])}:{other}:{base}"
    if ctph.compare(x, y, parity):
        assert set(ctph.keys(x, parity)) & set(ctph.keys(y, parity))


def test_signature_column(spark):
    data = random.Random(1).randbytes(3000)
    rows = spark.createDataFrame([(bytearray(data), 3000), (None, 5000), (bytearray(b""), 0)], "c binary, n long")
    got = [r[0] for r in rows.select(ctph.signature_column(F.col("c"), F.col("n"))).collect()]
    assert got == [serial_signature(data), None, None]
    pair = spark.createDataFrame([(got[0], got[0]), (got[0], None)], "a string, b string")
    assert [r[0] for r in pair.select(ctph.compare_column(F.col("a"), F.col("b"))).collect()] == [100, 0]


@pytest.mark.parametrize("name, ext", [(".bashrc", ""), ("a.", "."), ("a.tar.GZ", ".gz"), ("...", ""), ("..a.b", ".b"), ("plain", "")])
def test_extension(spark, name, ext):
    assert one(spark, paths.extension("n"), n=name) == ext
    assert one(spark, paths.stem("n"), n=name) == name[: len(name) - len(ext)]


def test_paths(spark):
    assert one(spark, paths.dirname("p"), p="/a") == "/"
    assert one(spark, paths.dirname("p"), p="a") == ""
    assert one(spark, paths.dirname("p"), p="/a/b/c.txt") == "/a/b"
    assert one(spark, paths.basename("p"), p="/a/b/c.txt") == "c.txt"
    assert one(spark, paths.allowed("p", ["/a/b"]), p="/a/bc") is False
    assert one(spark, paths.allowed("p", []), p="/x") is True
    assert one(spark, paths.share_root("p", ["/v1", "/v2/"]), p="/v2/photo/x/y") == "/v2/photo"
    assert one(spark, paths.share_root("p", ["/v1"]), p="/v3/x") is None
    assert one(spark, paths.below("p", F.lit("/r")), p="/elsewhere/f.txt") == "f.txt"
    assert [one(spark, paths.human_bytes("n"), n=n) for n in (0, 1023, 1024, 1536, 1 << 40)] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "1.0 TiB"]
    assert [one(spark, paths.bit_length("n"), n=n) for n in (0, 1, 255, 256)] == [0, 1, 8, 9]
    assert [one(spark, paths.signature_blocksize("n"), n=n) for n in (191, 192, 193, 10**6)] == [ctph.first_blocksize(n) for n in (191, 192, 193, 10**6)]
    assert [one(spark, paths.parsed_blocksize("s"), s=s) for s in ("96:a:b", "x:y", "")] == [96, 0, 0]


def test_globs(spark):
    import fnmatch

    globs = ["*.part", "Thumbs.db", "a[!b-d]?x*", "[]]", "x[", "*.!sync", "^a"]
    test = ~paths.not_excluded("n", F.lit("/a"), globs, [])
    for name in ("f.part", "f.PART", "Thumbs.db", "ThumbsXdb", "aezx", "abzx", "]", "x[", "x", "q.!sync", "^a", "f.part\n"):
        assert one(spark, test, n=name) == any(fnmatch.fnmatchcase(name, g) for g in globs), name
    assert one(spark, paths.not_excluded("n", F.lit("/a/.git/b"), [], [".git"]), n="x") is False


def test_quick_hash_ignores_tails_up_to_twice_the_edge(spark):
    import hashlib

    edge = signatures.EDGE
    for n in (0, 10, edge, edge + 1, 2 * edge, 2 * edge + 1):
        data = random.Random(n).randbytes(n)
        want = hashlib.md5(str(n).encode() + data[:edge] + (data[-edge:] if n > 2 * edge else b"")).hexdigest()
        rows = spark.createDataFrame([(bytearray(data), n)], "c binary, n long")
        assert rows.select(signatures.quick_hash(F.col("c"), F.col("n"))).first()[0] == want


def test_names(spark):
    bare = {"report 12.txt": "report", "report_12.txt": "report12", "Report (1).TXT": "report", "report copy.txt": "report", "reportcopy.txt": "reportcopy", "--.txt": ""}
    for name, want in bare.items():
        assert one(spark, names.bare_name("n"), n=name) == want, name
    assert one(spark, names.name_similarity("a", "b"), a="holiday.jpg", b="holiday copy.jpg") == 1.0
    assert one(spark, names.name_similarity("a", "b"), a="--.x", b="a.x") == 0.0
    for name, want in {"Movies": "movi", "videos": "video", "s": "s", "--": "", "es": "es"}.items():
        assert one(spark, names.normal_folder("n"), n=name) == want


@pytest.mark.parametrize(
    "a, b, why",
    [("/x/Video", "/y/video", "same name"), ("/x/Video", "/x/Videos", "same word in another form"), ("/x/Bilder", "/x/Pics", "synonyms"), ("/x/photo", "/x/unrelated", ""), ("/x/trip", "/x/trip2024", "one begins like the other"), ("/x/holidaypics", "/x/holidaypix", "much alike"), ("/", "/a", "")],
)
def test_kinship(spark, a, b, why):
    got = one(spark, names.kinship("a", "b"), a=a, b=b)
    assert (got.related, got.why) == (why != "", why)


def test_dhash(spark):
    ramp = np.tile(np.arange(90)[::-1], (80, 1))
    assert images.dhash(ramp) == -1  # every point brighter than the next
    assert images.dhash(ramp[:, ::-1]) == 0
    small = np.arange(72).reshape(8, 9)
    assert np.array_equal(images.shrink(small, 8, 9), small)
    assert np.allclose(images.shrink(np.ones((7, 11)), 8, 9), 1)
    for distance, want in ((0, 100), (8, 88), (9, 86), (64, 0)):
        bits = (1 << distance) - 1
        bits = bits - (1 << 64) if bits >> 63 else bits
        assert one(spark, signatures.dhash_similarity(F.col("a"), F.col("b")), a=0, b=bits) == want
    px = bytes(v for row in ramp[:16, :18] for p in row for v in (p, p, p))
    image = spark.createDataFrame([((16, 18, 3, bytearray(px)),), ((-1, -1, 0, None),)], "image struct<height:int,width:int,nChannels:int,data:binary>")
    assert [r[0] for r in image.select(images.dhash_column(F.col("image"))).collect()] == [-1, None]


def _jpeg(make, model):
    import struct

    def entry(tag, text, at):
        return struct.pack("<HHII", tag, 2, len(text) + 1, at), text.encode() + b"\0"

    head = b"II*\0" + struct.pack("<I", 8)
    n, rows, tail = 3, b"", b""
    base = 8 + 2 + 12 * n + 4
    for tag, text in ((0x010F, make), (0x0110, model)):
        row, body = entry(tag, text, base + len(tail))
        rows, tail = rows + row, tail + body
    sub = base + len(tail)
    rows += struct.pack("<HHII", 0x8769, 4, 1, sub)
    row, body = entry(0x9003, "2019:07:14 18:22:05", sub + 2 + 12 + 4)
    tiff = head + struct.pack("<H", n) + rows + bytes(4) + tail + struct.pack("<H", 1) + row + bytes(4) + body
    exif = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 480, 640, 1) + bytes(3)


def test_image_meta(spark):
    import struct

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 20, 10)
    assert images.meta(_jpeg("NIKON CORPORATION", "NIKON D750")) == {"width": 640, "height": 480, "format": "JPEG", "taken": "2019-07-14 18:22:05", "camera": "NIKON D750"}
    assert images.meta(_jpeg("Canon", "EOS 5D"))["camera"] == "Canon EOS 5D"
    assert images.meta(b"nothing") is None and images.meta(None) is None and images.meta(b"\x89PNG\r\n\x1a\n") is None
    rows = spark.createDataFrame([(bytearray(png),), (bytearray(b"x"),), (None,)], "c binary")
    got = [r[0] for r in rows.select(images.meta_column(F.col("c"))).collect()]
    assert (got[0].width, got[0].height, got[0].format, got[0].camera) == (20, 10, "PNG", None)
    assert got[2] is None and got[1].format is None


def test_options():
    o = ScanOptions().updated({"min_size": "7", "dry_run": "true", "verify_bytes": "0", "exclude_globs": ["*.x"], "nonsense": 1})
    assert (o.min_size, o.dry_run, o.verify_bytes, o.exclude_globs) == (7, True, False, ("*.x",))
    assert TRASH in o.exclude_dirs
