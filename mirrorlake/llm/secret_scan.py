"""Secret scan: two Markov models of characters, one of random strings, one of identifiers.

A token, a run of letters, digits, ``_-+/`` and bytes beyond ASCII, is a secret if
its log-likelihood as a random string exceeds that as an ordinary identifier by
enough for each character. Inside other tokens, of any length, so are the stretches
whose summed log-likelihood ratio is large: a key behind a path, after letters
beyond ASCII, or a short password. Such a stretch has a digit or capitals within, as
letters alone may be a word of a language that no label covers. Both models are first-order and trained from
labelled strings: generated keys of the usual alphabets against words of a bounded
sample of labelled documents, joined to identifiers, and numbers.
"""

from __future__ import annotations

import random
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from mirrorlake.llm import text as T
from mirrorlake.llm.docstats import labelled

ALPHABET = string.ascii_letters + string.digits + "_-+/"
_CLASS = np.full(256, len(ALPHABET), np.int64)
_CLASS[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_START = len(ALPHABET) + 1
_KEY = _CLASS < len(ALPHABET)
_TOKEN = _KEY | (np.arange(256) >= 128)
_JOINT = np.isin(np.arange(256), np.frombuffer(b"_-+/", np.uint8))
_COMMON = "the of and to in is that for it with as was on are by this from at or have not be which you all can has more when out use time data value index config name file user result error request response handler manager total count default parser buffer client server service account session number order customer update create delete select insert table column password secret token private public".split()


@dataclass(frozen=True)
class SecretOptions:
    """``sample_rows`` bounds the labelled documents whose words train the identifier model,
    ``words`` those words, the most frequent of ``word_letters`` letters, and the strings made for each model.

    Tokens of ``least_length`` need a mean ratio of ``threshold``; stretches of any length,
    of shorter tokens and within longer ones, need a sum of ``least_total`` too, and end
    where it falls by ``drop``; and ``least_stretch`` characters, as shorter ones, such as
    the first seven of a commit's hash, are names and not secrets. So a secret is missed
    where it is shorter or its characters don't add up to ``least_total``, as random
    letters and digits of that length mostly do.
    """

    sample_rows: int = 2_000
    words: int = 20_000
    word_letters: tuple[int, int] = (2, 40)
    least_length: int = 16
    threshold: float = 0.35
    least_stretch: int = 8
    least_total: float = 16.0
    drop: float = 10.0
    smoothing: float = 0.3
    mask: str = "[SECRET]"
    seed: int = 5


def random_strings(n: int, seed: int) -> list[str]:
    """Keys of the usual kinds: hex, base 62, base 64, capitals and digits, with prefixes or not."""
    r = random.Random(seed)
    hexes, b62 = "0123456789abcdef", string.ascii_letters + string.digits
    kinds = [(hexes, (32, 40, 64)), (hexes.upper(), (32, 40, 64)), (b62, (20, 24, 32, 40)), (b62 + "+/", (28, 40, 44)), (b62 + "-_", (22, 32, 43)), (string.ascii_uppercase + string.digits, (16, 20, 32)), (string.ascii_lowercase + string.digits, (16, 24, 32))]
    out = []
    for i in range(n):
        letters, lengths = kinds[i % len(kinds)]
        head = r.choice(["", "", "", "sk_", "AKIA", "ghp_", "key-"])
        out.append(head + "".join(r.choices(letters, k=r.choice(lengths))))
    return out


def identifiers(words: list[str], n: int, seed: int) -> list[str]:
    """Words as they are, in capitals, joined to names and paths, and plain numbers."""
    r = random.Random(seed + 1)
    words = sorted(set(words)) or _COMMON
    out = []
    for i in range(n):
        some = [r.choice(words) for _ in range(r.randint(1, 4))]
        kind = i % 7
        if kind == 0:
            out.append("_".join(some))
        elif kind == 1:
            out.append(some[0] + "".join(w.capitalize() for w in some[1:]))
        elif kind == 2:
            out.append("-".join(some) + (str(r.randint(1, 99)) if r.random() < 0.3 else ""))
        elif kind == 3:
            out.append("_".join(some).upper())
        elif kind == 4:
            out.append("/".join(some))
        elif kind == 5:
            out.append("".join(r.choices(string.digits, k=r.randint(6, 19))) if r.random() < 0.5 else f"{r.randint(1970, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}")
        else:
            out.append("".join(some))
    return out


def _logs(strings: list[str], smoothing: float) -> np.ndarray:
    size = len(ALPHABET) + 2
    count = np.full((size, size), smoothing)
    for s in strings:
        c = np.concatenate([[_START], _CLASS[np.frombuffer(s.encode(), np.uint8)]])
        np.add.at(count, (c[:-1], c[1:]), 1)
    return np.log(count / count.sum(1, keepdims=True))


def _best(v: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The largest sum of adjacent values within each run."""
    size = np.diff(place)
    total = np.cumsum(v)
    own = total - np.repeat(total[place[:-1]] - v[place[:-1]], size)
    step = np.repeat(np.arange(len(size)) * (max(0.0, -float(own.min())) + 1), size)  # puts each run below all earlier ones
    low = np.minimum.accumulate(np.minimum(own, 0) - step) + step
    return np.maximum.reduceat(own - low, place[:-1])


def _rises(v: list[float], o: SecretOptions) -> Iterator[tuple[int, int, float]]:
    """(begin, stop, sum) of the stretches that score, each up to where the sum is highest before it drops."""
    begin, stop, total, best = 0, 0, 0.0, 0.0
    for i, x in enumerate([*v, -np.inf]):
        total += x
        if total > best:
            best, stop = total, i + 1
        elif total <= 0 or best - total >= o.drop:
            if stop - begin >= o.least_stretch and best >= o.least_total and best >= o.threshold * (stop - begin):
                yield begin, stop, best
            begin, total, best = i + 1, 0.0, 0.0


@dataclass
class Markov:
    """log P(random) - log P(identifier) of each step from one character to the next."""

    ratio: np.ndarray

    def _steps(self, raw: np.ndarray, offs: np.ndarray, table: np.ndarray, least: int, mixed: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Where runs of ``least`` bytes start and end, the ratios of all their bytes, and n + 1 places of runs in these.

        ``mixed``: only runs with something else than small letters after the first byte.
        """
        for pos, piece, start, end in T.runs(raw, offs, table):
            long = end - start >= least
            if mixed:
                other = np.cumsum(~T.IS_LOWER[piece])
                long &= other[end - 1] > other[start]
            start, end = start[long], end[long]
            if not len(start):
                continue
            size = end - start
            place = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(place[-1]) - np.repeat(place[:-1] - start, size)
            c = _CLASS[piece[at]]
            before = np.concatenate([[_START], c[:-1]])
            before[place[:-1]] = _START
            yield start + pos, end + pos, self.ratio[before, c], place

    def tokens(self, raw: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where tokens of ``least`` bytes start and end, and their ratios for each byte."""
        out = [(start, end, np.add.reduceat(v, place[:-1]) / (end - start)) for start, end, v, place in self._steps(raw, offs, _TOKEN, least)]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def stretches(self, raw: np.ndarray, offs: np.ndarray, o: SecretOptions) -> list[tuple[int, int, float]]:
        """Starts, ends and mean ratios of the stretches of ASCII that score, each drawn out to the joints around it."""
        out: list[tuple[int, int, float]] = []
        least = max(1, int(np.ceil(o.least_total / max(float(self.ratio.max()), 1e-9))))  # shorter ones can't reach the sum
        for start, end, v, place in self._steps(raw, offs, _KEY, least, mixed=True):
            for k in np.flatnonzero(_best(v, place) >= o.least_total - 1e-3).tolist():
                first, last = int(start[k]), int(end[k])
                joint = np.flatnonzero(_JOINT[raw[first:last]]) + first
                own: list[tuple[int, int, float]] = []
                for i, j, total in _rises(v[place[k] : place[k + 1]].tolist(), o):
                    x, y = first + i, first + j
                    left, right = np.searchsorted(joint, x), np.searchsorted(joint, y)
                    x = x if _JOINT[raw[x]] else int(joint[left - 1]) + 1 if left else first
                    y = y if _JOINT[raw[y - 1]] else int(joint[right]) if right < len(joint) else last
                    letters = raw[x:y].tobytes().decode().strip("_-+/")
                    if letters.isalpha() and (letters[1:].islower() or letters.isupper()):
                        continue
                    if own and x <= own[-1][1]:
                        own[-1] = (own[-1][0], y, max(own[-1][2], total / (j - i)))
                    else:
                        own.append((x, y, total / (j - i)))
                out += own
        return out

    def hits(self, raw: np.ndarray, offs: np.ndarray, o: SecretOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and scores of all secrets in order: whole tokens, and stretches within other tokens."""
        start, end, score = self.tokens(raw, offs, o.least_length)
        whole = score >= o.threshold
        start, end, score = start[whole], end[whole], score[whole]
        found = self.stretches(raw, offs, o)
        if not found:
            return start, end, score
        a, b, c = (np.array(x) for x in zip(*found, strict=True))
        if len(start):
            before = np.searchsorted(start, a, "right") - 1
            free = (before < 0) | (end[before] <= a)
            a, b, c = a[free], b[free], c[free]
        start, end, score = np.concatenate([start, a]), np.concatenate([end, b]), np.concatenate([score, c])
        order = np.argsort(start, kind="stable")
        return start[order], end[order], score[order]

    def of(self, s: str) -> float:
        """The ratio for each byte of one string."""
        c = np.concatenate([[_START], _CLASS[np.frombuffer(s.encode(), np.uint8)]])
        return float(self.ratio[c[:-1], c[1:]].sum() / max(1, len(c) - 1))


def fit(words: list[str], o: SecretOptions | None = None) -> Markov:
    o = o or SecretOptions()
    return Markov(_logs(random_strings(o.words, o.seed), o.smoothing) - _logs(identifiers(words + _COMMON, o.words, o.seed), o.smoothing))


def train(docs: DataFrame, labels: DataFrame | None, o: SecretOptions) -> Markov:
    """Both models; without labelled documents, identifiers are made of common English words only."""
    if labels is None:
        return fit([], o)
    some = labelled(docs, labels, ["quality"], o.sample_rows)
    word = F.explode(F.array_distinct(F.split("text", r"[^\p{L}]+"))).alias("word")
    counted = some.select(word).filter(F.length("word").between(*o.word_letters)).groupBy("word").count()
    return fit([r.word for r in counted.orderBy(F.desc("count"), "word").limit(o.words).collect()], o)


def _offsets(raw: np.ndarray, begin: int, at: list[int]) -> list[int]:
    """Characters between ``begin`` and each of the ascending byte positions."""
    out, total, last = [], 0, begin
    for a in at:
        total += int(np.count_nonzero((raw[last:a] & 0xC0) != 0x80))
        out.append(total)
        last = a
    return out


def secrets(docs: DataFrame, labels: DataFrame | None, options: SecretOptions | None = None) -> DataFrame:
    """(doc_id, start, end, score, preview) of each secret, ``start`` and ``end`` in characters.

    Whole texts are read; null and empty ones have none. Each occurrence has a row,
    also where documents or rows repeat; rows without an id keep a null id. Ids are
    whole numbers. ``preview`` shows four characters. Numbers that only name things but
    are random, such as UUIDs and hashes of commits, look like keys and count as such.
    """
    o = options or SecretOptions()
    model = train(docs, labels, o)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = T.buffers(b.column(1))
            for lo, hi in T.slices(offs):
                start, end, score = model.hits(raw, offs[lo : hi + 1], o)
                if not len(start):
                    continue
                doc = np.searchsorted(offs[lo : hi + 1], start, "right") - 1 + lo
                rows: list[tuple] = []
                for d in np.unique(doc):
                    own = np.flatnonzero(doc == d)
                    at = _offsets(raw, int(offs[d]), [int(x) for k in own for x in (start[k], end[k])])
                    rows += [(d, at[2 * i], at[2 * i + 1], float(score[k]), raw[start[k] : start[k] + 16].tobytes().decode("utf-8", "ignore")[:4]) for i, k in enumerate(own)]
                d, s, e, v, t = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(v), pa.array(t)], ["doc_id", "start", "end", "score", "preview"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, start long, end long, score double, preview string")


def redact(docs: DataFrame, labels: DataFrame | None, options: SecretOptions | None = None) -> DataFrame:
    """``docs`` with each secret replaced by the mask, and ``n_chars``, if there, counted again.

    All rows stay, without an id too, and all else in them; null texts stay null.
    """
    o = options or SecretOptions()
    model = train(docs, labels, o)
    text = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    kind = pa.int32() if chars is not None and isinstance(docs.schema["n_chars"].dataType, IntegerType) else pa.int64()
    mask = o.mask.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(text)
            raw, offs = T.buffers(column)
            new: dict[int, str] = {}
            for lo, hi in T.slices(offs):
                start, end, _ = model.hits(raw, offs[lo : hi + 1], o)
                doc = np.searchsorted(offs[lo : hi + 1], start, "right") - 1 + lo
                for d in np.unique(doc):
                    parts, last = [], int(offs[d])
                    for k in np.flatnonzero(doc == d):
                        parts += [raw[last : start[k]].tobytes(), mask]
                        last = int(end[k])
                    new[int(d)] = b"".join([*parts, raw[last : offs[d + 1]].tobytes()]).decode("utf-8", "replace")
            if new:
                changed = np.zeros(b.num_rows, bool)
                changed[list(new)] = True
                texts = pc.replace_with_mask(column, pa.array(changed), pa.array([new[i] for i in sorted(new)], column.type))
                columns = list(b.columns)
                columns[text] = texts
                if chars is not None:
                    counted = pa.array([len(new[i]) for i in sorted(new)], kind).cast(columns[chars].type)
                    columns[chars] = pc.replace_with_mask(columns[chars], pa.array(changed), counted)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)
