"""PII: a semi-Markov conditional random field over spans.

After Sarawagi and Cohen, "Semi-Markov Conditional Random Fields for Information
Extraction" (2004). A segmentation of the text into plain tokens and entities of
at most ``longest`` tokens is scored by features of whole candidate spans (how
many digits and groups, whether brackets close, valid octets, the shape of the
domain, what stands on either side) and of neighbouring labels. Dynamic
programming over (place, label) finds boundaries and types together. Weights are
trained here by the gradient of the conditional likelihood, with forward and
backward sums, on generated labelled sentences.

Only spans with a digit or an @ can be entities, and a plain token scores nothing,
so the best segmentation of a text falls apart into those of the regions around
such characters. Regions are found on the bytes of whole batches; Python sees
nothing else of a text.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorlake.llm import text as T

KINDS = ("email", "phone", "ip_address", "card_number")
_O = len(KINDS)
FEATURES = (
    "bias", "one_at", "name_ok", "domain_ok", "has_at", "three_dots", "octets_ok", "digits_7", "digits_8_9", "digits_10_12", "digits_13_19", "digits_20",
    "one_run", "groups_of_4", "plus", "closed", "unclosed", "dash", "space", "dot", "starts_marked", "ends_marked", "more_left", "more_right", "long_group", "short_group", "wrapped",
)
_AT = {f: i for i, f in enumerate(FEATURES)}
_TOKENS = re.compile(r"[^\W_]+|\S")
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[^\W]+(?:[.+\-][^\W]+)*")
_DOMAIN = re.compile(r"[^\W_]+(?:-[^\W_]+)*(?:\.[^\W_]+(?:-[^\W_]+)*)*\.[^\W\d_]{2,}")


@dataclass(frozen=True)
class PiiOptions:
    """``longest``: tokens of an entity; ``reach``: bytes read on either side of a digit or @, and then on to white space.

    ``reach`` loses nothing: between two digits of an entity stand fewer marks than that.
    """

    longest: int = 24
    reach: int = 96
    sentences: int = 240
    epochs: int = 14
    rate: float = 0.3
    ridge: float = 1e-3
    seed: int = 3


@lru_cache(maxsize=1 << 16)
def span_features(span: str, left: str, right: str) -> tuple[int, ...]:
    """Numbers of the features that hold for a whole span; ``left`` and ``right`` are the characters beside it."""
    on = ["bias"]
    groups = _DIGITS.findall(span)
    digits = sum(map(len, groups))
    at = span.count("@")
    if at:
        on.append("has_at")
        name, _, domain = span.partition("@")
        on += ["one_at"] * (at == 1) + ["name_ok"] * bool(_NAME.fullmatch(name)) + ["domain_ok"] * bool(_DOMAIN.fullmatch(domain))
    else:
        octets = span.split(".")
        if len(octets) == 4:
            on.append("three_dots")
            if all(o.isdigit() and len(o) <= 3 and int(o) <= 255 for o in octets):
                on.append("octets_ok")
        on += ["digits_7"] * (digits <= 7) + ["digits_8_9"] * (8 <= digits <= 9) + ["digits_10_12"] * (10 <= digits <= 12) + ["digits_13_19"] * (13 <= digits <= 19) + ["digits_20"] * (digits >= 20)
        on += ["one_run"] * (len(groups) == 1) + ["groups_of_4"] * (len(groups) > 2 and all(len(g) == 4 for g in groups))
        on += ["long_group"] * (len(groups) > 1 and max(map(len, groups)) > 4) + ["short_group"] * (len(groups) > 1 and min(map(len, groups)) < 2)
        on += ["plus"] * span.startswith("+") + ["dash"] * ("-" in span) + ["space"] * (" " in span) + ["dot"] * ("." in span)
        if "(" in span or ")" in span:
            on += ["wrapped"] * (span[0] == "(" and span[-1] == ")")
            on.append("closed" if re.fullmatch(r"[^()]*\([^()]*\)[^()]*", span) else "unclosed")
    on += ["starts_marked"] * (not (span[0].isalnum() or span[0] in "+(")) + ["ends_marked"] * (not span[-1].isalnum())
    on += ["more_left"] * (left.isalnum() or left in ("@", "+", "-", "_") or (left == "(" and not at)) + ["more_right"] * (right.isalnum() or right in ("@", "-", "_", ")"))
    return tuple(_AT[f] for f in on)


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKENS.finditer(text)]


def candidates(text: str, spans: list[tuple[int, int]], longest: int) -> list[tuple[int, int]]:
    """(first, after last) token of each span that may be an entity.

    Those without white space around one @ or more, and those of digits and marks
    only, with single spaces between, of seven digits or of four groups with dots.
    """
    out = []
    n = len(spans)
    alpha = [text[a].isalpha() or not text[a:b].isdigit() and text[a:b].isalnum() for a, b in spans]
    word = [text[a].isalnum() for a, _ in spans]
    for i in range(n):
        a = spans[i][0]
        if not (word[i] or text[a] in "+("):
            continue
        at = digits = dots = 0
        letters = spaces = False
        for j in range(i, min(n, i + longest)):
            b0, b1 = spans[j]
            if j > i and spans[j - 1][1] != b0:
                if b0 - spans[j - 1][1] > 1 or text[b0 - 1] != " " or at or letters:
                    break
                spaces = True
            piece = text[b0:b1]
            at += piece == "@"
            dots += piece == "."
            if alpha[j]:
                letters = True
                if spaces:
                    break
            elif word[j]:
                digits += len(piece)
            if not (word[j] or piece == ")") or (at and spaces):
                continue
            if (at and not spaces and word[i]) or (not letters and not at and (digits >= 7 or (dots == 3 and digits >= 4))):
                out.append((i, j + 1))
    return out


@dataclass
class SemiCrf:
    """``weights`` [kind, feature] and ``steps`` [label, label], the last label being plain text."""

    weights: np.ndarray
    steps: np.ndarray
    longest: int

    def __post_init__(self) -> None:
        self._w = self.weights.tolist()
        self._t = self.steps.tolist()
        self._known: dict[tuple[int, ...], list[float]] = {}

    def scores(self, feats: tuple[int, ...]) -> list[float]:
        got = self._known.get(feats)
        if got is None:
            got = self._known[feats] = [sum(w[f] for f in feats) for w in self._w]
        return got

    def lattice(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, tuple[int, ...]]]]:
        spans = tokens(text)
        found = []
        for i, j in candidates(text, spans, self.longest):
            a, b = spans[i][0], spans[j - 1][1]
            found.append((i, j, span_features(text[a:b], text[a - 1 : a], text[b : b + 1])))
        return spans, found

    def entities(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, score) of the entities in the best segmentation.

        ``score`` is by how much the segmentation with the entity beats that with plain
        text in its place, all else being the same: log-odds, never below zero.
        """
        spans, found = self.lattice(text)
        if not found:
            return []
        n = len(spans)
        ends: list[list[tuple[int, list[float]]]] = [[] for _ in range(n + 1)]
        for i, j, feats in found:
            ends[j].append((i, self.scores(feats)))
        t = self._t
        labels = range(_O + 1)
        best = [[-1e18] * (_O + 1) for _ in range(n + 1)]
        back: list[list[tuple[int, int]]] = [[(0, _O)] * (_O + 1) for _ in range(n + 1)]
        best[0][_O] = 0.0
        for j in range(1, n + 1):
            before = best[j - 1]
            y = max(labels, key=lambda k: before[k] + t[k][_O])
            best[j][_O], back[j][_O] = before[y] + t[y][_O], (j - 1, y)
            for i, s in ends[j]:
                before = best[i]
                for k in range(_O):
                    y = max(labels, key=lambda q: before[q] + t[q][k])
                    v = before[y] + t[y][k] + s[k]
                    if v > best[j][k]:
                        best[j][k], back[j][k] = v, (i, y)
        out = []
        after = _O  # the end counts as plain text
        j, y = n, max(labels, key=lambda k: best[n][k] + t[k][_O])
        while j > 0:
            i, x = back[j][y]
            if y != _O:
                s = next(s for p, s in ends[j] if p == i)
                plain = t[x][_O] + (j - i - 1) * t[_O][_O] + t[_O][after]
                out.append((spans[i][0], spans[j - 1][1], KINDS[y], t[x][y] + s[y] + t[y][after] - plain))
            j, y, after = i, x, y
        return out[::-1]


def _lse(values: list[float]) -> float:
    m = max(values)
    return m + math.log(sum(math.exp(v - m) for v in values)) if m > -1e17 else m


def _gradient(model: SemiCrf, n: int, found: list, truth: dict[tuple[int, int], int], gw: np.ndarray, gt: np.ndarray) -> float:
    """Adds observed minus expected counts of one sentence; returns its log-likelihood."""
    t, labels = model._t, range(_O + 1)
    segments: list[list[tuple[int, int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        segments[j].append((j - 1, _O, 0.0, ()))
    for i, j, feats in found:
        segments[j] += [(i, k, s, feats) for k, s in enumerate(model.scores(feats))]
    fore = [[-1e18] * (_O + 1) for _ in range(n + 1)]
    fore[0][_O] = 0.0
    for j in range(1, n + 1):
        into: list[list[float]] = [[] for _ in labels]
        for i, k, s, _ in segments[j]:
            into[k].append(s + _lse([fore[i][q] + t[q][k] for q in labels]))
        fore[j] = [_lse(v) if v else -1e18 for v in into]
    aft = [[-1e18] * (_O + 1) for _ in range(n + 1)]
    aft[n] = [0.0] * (_O + 1)
    total = _lse(fore[n])
    for j in range(n, 0, -1):
        for i, k, s, feats in segments[j]:
            rest = s + aft[j][k]
            for q in labels:
                v = t[q][k] + rest
                p = math.exp(min(0.0, fore[i][q] + v - total)) if fore[i][q] > -1e17 else 0.0
                if p > 1e-12:
                    gt[q, k] -= p
                    for f in feats:
                        gw[k, f] -= p
        starts: dict[int, list] = {}
        for i, k, s, _ in segments[j]:
            starts.setdefault(i, []).append((k, s + aft[j][k]))
        for i, outs in starts.items():
            for q in labels:
                aft[i][q] = _lse([aft[i][q], *(t[q][k] + v for k, v in outs)])
    score, y, j = 0.0, _O, 0
    own = {(i, e): f for i, e, f in found}
    while j < n:
        hit = next(((e, k) for (i, e), k in truth.items() if i == j), None)
        if hit:
            e, k = hit
            score += t[y][k] + model.scores(own[j, e])[k]
            gt[y, k] += 1
            for f in own[j, e]:
                gw[k, f] += 1
            y, j = k, e
        else:
            score += t[y][_O]
            gt[y, _O] += 1
            y, j = _O, j + 1
    return score - total


def sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated texts with the entities in them: all kinds, in many forms, among decoys."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéüñ"
    word = lambda: "".join(r.choices(letters, k=r.randint(1, 9)))
    num = lambda k: "".join(r.choices("0123456789", k=k))

    def email() -> str:
        name = r.choice([word(), word() + "." + word(), word() + "." + num(2), word() + "_" + num(r.randint(1, 4)), word() + "+" + word(), word() + num(2)])
        return name + "@" + r.choice(["", "mail" + num(1) + ".", word() + "-" + word() + "."]) + r.choice(["example", word() + "s", word() + num(1)]) + "." + r.choice(["com", "org", "net", "de", "co.uk", "fr", "es"])

    def phone() -> str:
        return r.choice([
            lambda: f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"+{r.randint(1, 99)} {num(3)} {num(3)} {num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}",
            lambda: f"+{r.randint(1, 99)}-{num(3)}-{num(3)}-{num(4)}", lambda: f"+{num(2)}{num(r.randint(8, 10))}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"+{num(2)} {num(2)} {num(4)} {num(4)}",
        ])()

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def card() -> str:
        return r.choice([lambda: num(16), lambda: num(16), lambda: " ".join(num(4) for _ in range(4)), lambda: "-".join(num(4) for _ in range(4)), lambda: num(15)])()

    def decoy() -> str:
        return r.choice([
            lambda: f"version {r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{r.randint(1900, 2030)}-{num(2)}-{num(2)}", lambda: f"{num(2)}.{num(2)}.{r.randint(1900, 2030)}", lambda: f"{num(1)},{num(3)},{num(3)}.{num(2)}",
            lambda: "".join(r.choices("0123456789abcdef", k=40)), lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: "@" + word(), lambda: f"{word()} @ {word()}", lambda: f"{r.randint(256, 999)}.{num(3)}.{r.randint(300, 999)}.{num(3)}", lambda: f"{num(7)}",
            lambda: num(25), lambda: f"{num(3)} {num(2)} {num(3)}", lambda: f"{num(5)} {num(5)}", lambda: f"{r.randint(1900, 2030)} {r.randint(1900, 2030)} {r.randint(1900, 2030)}",
        ])()

    made = {"email": email, "phone": phone, "ip_address": ip, "card_number": card}
    out = []
    for i in range(n):
        text, truth = word(), []
        for _ in range(r.randint(1, 3)):
            text += r.choice([" ", " ", ", ", "\n", "### "]) + word() + r.choice([" ", " ", ": ", " (", ' "', " | "])
            if r.random() < 0.3:
                text += decoy()
            else:
                kind = KINDS[(i + len(truth)) % len(KINDS)] if r.random() < 0.8 else r.choice(KINDS)
                s = made[kind]()
                truth.append((len(text), len(text) + len(s), kind))
                text += s
            text += r.choice(["", ".", ",", "!!", "$$$", "###", ")", " |", '"']) + r.choice([" ", "\n"]) + word()
        out.append((text, truth))
    return out


@lru_cache(maxsize=4)
def fit(o: PiiOptions) -> SemiCrf:
    """Weights by gradient steps with momentum on the generated sentences."""
    data = []
    blank = SemiCrf(np.zeros((_O, len(FEATURES))), np.zeros((_O + 1, _O + 1)), o.longest)
    for text, truth in sentences(o.sentences, o.seed):
        spans, found = blank.lattice(text)
        starts, stops = {a: i for i, (a, _) in enumerate(spans)}, {b: i + 1 for i, (_, b) in enumerate(spans)}
        own = {(i, j) for i, j, _ in found}
        marked = {(starts[a], stops[b]): KINDS.index(k) for a, b, k in truth if a in starts and b in stops and (starts[a], stops[b]) in own}
        data.append((len(spans), found, marked))
    r = random.Random(o.seed)
    w, t = np.zeros_like(blank.weights), np.zeros_like(blank.steps)
    vw, vt = np.zeros_like(w), np.zeros_like(t)
    for epoch in range(o.epochs):
        r.shuffle(data)
        for at in range(0, len(data), 12):
            gw, gt = np.zeros_like(w), np.zeros_like(t)
            model = SemiCrf(w, t, o.longest)
            for n, found, marked in data[at : at + 12]:
                _gradient(model, n, found, marked, gw, gt)
            step = o.rate / (1 + 0.15 * epoch) / 4
            vw, vt = 0.8 * vw + step * (gw - o.ridge * w), 0.8 * vt + step * (gt - o.ridge * t)
            w, t = w + vw, t + vt
            t -= t[_O, _O]  # a plain token after plain text scores nothing
    return SemiCrf(w, t, o.longest)


_TRIGGER = T.IS_DIGIT | (np.arange(256) == 64)


def regions(raw: np.ndarray, offs: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, byte after) of the stretches that may hold entities.

    They reach ``reach`` bytes beyond each trigger, then on to white space however
    far that is, and never across documents; those that touch are one.
    """
    base, stop = int(offs[0]), int(offs[-1])
    hit = np.flatnonzero(_TRIGGER[raw[base:stop]]) + base
    if not len(hit):
        return (np.zeros(0, np.int64),) * 3
    space = np.flatnonzero(T.IS_SPACE[raw[base:stop]]) + base
    doc = np.searchsorted(offs, hit, "right") - 1
    begin, end = offs[doc], offs[doc + 1]
    before = np.searchsorted(space, hit - reach, "right") - 1  # the last white space up to there
    after = np.searchsorted(space, hit + reach, "left")
    a = np.where(before >= 0, space[np.maximum(before, 0)] + 1, begin) if len(space) else begin
    b = np.where(after < len(space), space[np.minimum(after, len(space) - 1)], end) if len(space) else end
    a, b = np.maximum(a, begin), np.minimum(b, end)
    first = np.append(True, (a[1:] > np.maximum.accumulate(b)[:-1]) | (np.diff(doc) > 0))
    at = np.flatnonzero(first)
    return doc[at], a[at], np.maximum.reduceat(b, at)


def pii(docs: DataFrame, options: PiiOptions | None = None) -> DataFrame:
    """(doc_id, kind, start, end, span, score) of each entity, places in characters.

    Whole texts are read; null and empty ones have none. Each occurrence has a
    row, also where documents or rows repeat; rows without an id keep a null id.
    Ids are whole numbers. The kinds are those of :data:`KINDS`; entities of more
    than ``longest`` tokens (runs of letters or digits, and single marks) are not found.
    """
    o = options or PiiOptions()
    model = fit(o)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = T.buffers(batch.column(1))
            rows: list[tuple] = []
            for lo, hi in T.slices(offs):
                last, chars, upto = -1, 0, 0
                for d, a, b in zip(*(x.tolist() for x in regions(raw, offs[lo : hi + 1], o.reach)), strict=True):
                    piece = raw[a:b].tobytes().decode("utf-8", "replace")
                    found = model.entities(piece)
                    if not found:
                        continue
                    if d != last:
                        last, chars, upto = d, 0, int(offs[lo + d])
                    chars += int(np.count_nonzero((raw[upto:a] & 0xC0) != 0x80))
                    upto = a
                    rows += [(lo + d, k, chars + s, chars + e, piece[s:e], v) for s, e, k, v in found]
            if rows:
                d, k, s, e, span, v = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(k), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(span), pa.array(v, pa.float64())], ["doc_id", "kind", "start", "end", "span", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, kind string, start long, end long, span string, score double")
