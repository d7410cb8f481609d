"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings sums, over all subsequences of three characters, the product of their decayed
occurrences: ``DECAY`` to the power of the span, spans up to ``SPAN``; it is normalised. Inserted characters
only lengthen spans, so a gapped insult stays close to the plain one.

Units are the words of a text, one byte per letter or digit (those beyond ASCII by their place in the code table); signs and combining accents between
letters are taken out before, so any number of them may part the letters of an insult. Runs of single letters over
any white space ("i d  i o t") form one unit, and so do short words with their neighbours ("id iot"); long units are
cut into overlapping windows. Insults of several longer words are no units. A labelled text is toxic if one of its sentences is: witnesses of toxic texts
are found by covering the toxic texts of the sample with words absent from clean ones, then renewed by the
machine itself, with the best units of clean texts as hard negatives. A text's margin is that of its highest unit;
a logistic curve, fitted on sample texts kept from the machine, turns it into a score.

Landmarks give k(x) = sum of alpha * k(x, landmark); since the kernel is a product of explicit subsequence
features, the landmarks fold into one weight per subsequence, which is what the tasks receive (8 MB).

Bounds (documented, of the fit only): at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled texts, ``SEEDS``
candidate words, ``LANDMARKS`` landmarks. Every whole text is scored.

Defined results: null and empty texts have no unit and get the score of the lowest margin; without both labels
in the learning rows every score is 0; a repeated row is scored again; a document with several labels, and a text
of several documents, is learned with its largest; empty tables give empty results. Other columns may have any name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import rows_of, text_chunks

ORDER, SPAN, DECAY, SYMBOLS = 3, 8, 0.7, 128
FOREIGN = SYMBOLS - 37  # symbols of the letters beyond ASCII; neighbours in the code table differ
SAMPLE_TOXIC, SAMPLE_CLEAN, SEEDS, LANDMARKS, ROUNDS = 4000, 8000, 4000, 256, 3
UNIT, STRIDE = 24, 12
THRESHOLD = 0.7
CACHE = 400_000
#: Bytes of a text that are cut into units at once, and cells of a block of features.
PART_BYTES, CELLS = 1 << 20, 1 << 20

FRAGMENT, JOINED = 3, 9  # letters of a short word, and of one joined with its neighbours


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Byte that stands for each code point below 65,536: 32 for white space, 0 for what is taken out."""
    return np.array([_letter(code) for code in range(1 << 16)], np.uint8)


def _letter(code: int) -> int:
    c = chr(code)
    if c.isspace():
        return 32
    if not (c.isalnum() or (unicodedata.category(c)[0] == "M" and not 0x300 <= code < 0x370)):
        return 0
    return code if code < 128 else 128 + code % FOREIGN


_SYMBOL = np.zeros(256, np.int32)  # 0: a gap, in no subsequence
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[48:58] = np.arange(27, 37)
_SYMBOL[128 : 128 + FOREIGN] = 37 + np.arange(FOREIGN)
_POWERS = DECAY ** np.arange(SPAN + 1)
#: A blank between two words that are too long to be joined with anything.
_CUT = re.compile(rb"(?<=[a-z]{4})[ \n](?=[a-z]{4})")


class Spans(NamedTuple):
    """Units as spans of the letters of some texts, white space and signs taken out."""

    letters: np.ndarray
    row: np.ndarray
    start: np.ndarray
    size: np.ndarray


def _letters_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and blanks of all texts, and the row of each."""
    shown = [t.decode("utf-8", "replace") for t in texts]
    codes = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letter_table()[np.minimum(codes, (1 << 16) - 1)]
    high = np.flatnonzero(codes >= 1 << 16)
    if len(high):
        found, at = np.unique(codes[high], return_inverse=True)
        letters[high] = np.array([_letter(int(c)) for c in found], np.uint8)[at]
    kept = letters > 0
    return letters[kept], np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in shown])[kept]


def spans_of(texts: list[bytes]) -> Spans:
    """Units of lower-cased texts: words, short ones joined with their neighbours, runs of single letters, windows of long ones."""
    marks, row = _letters_of(texts)
    solid = marks != 32
    first = solid.copy()
    first[1:] &= ~solid[:-1] | (row[1:] != row[:-1])
    letters, row = marks[solid], row[solid]
    # Without the white space, words lie side by side; so do the words of a joined unit.
    start = np.flatnonzero(first[solid])
    size, owner = np.diff(np.append(start, len(letters))), row[start]
    found = [(owner, start, size)]
    if len(start) > 1:
        total, pair = size[:-1] + size[1:], owner[:-1] == owner[1:]
        at = np.flatnonzero(pair & (np.minimum(size[:-1], size[1:]) <= FRAGMENT) & (total <= JOINED))
        found.append((owner[at], start[at], total[at]))
        short = size <= FRAGMENT
        at = np.flatnonzero(pair[:-1] & pair[1:] & short[:-2] & short[1:-1] & short[2:])
        found.append((owner[at], start[at], size[at] + size[at + 1] + size[at + 2]))
        joined = np.concatenate([[False], pair & (size[:-1] == 1) & (size[1:] == 1), [False]])
        edges = np.diff(joined.view(np.int8))
        at, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        at, end = at[end - at >= 2], end[end - at >= 2]
        found.append((owner[at], start[at], end - at + 1))
    row, start, size = (np.concatenate(x) for x in zip(*found, strict=True))
    long = size > UNIT
    if long.any():
        windows = (size[long] - UNIT + STRIDE - 1) // STRIDE + 1
        step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = np.repeat(start[long], windows) + STRIDE * step
        end = np.minimum(begin + UNIT, np.repeat(start[long] + size[long], windows))
        row, start, size = (np.concatenate([x[~long], y]) for x, y in ((row, np.repeat(row[long], windows)), (start, begin), (size, end - begin)))
    return Spans(letters, row, start, size)


def packed(spans: Spans) -> np.ndarray:
    """The units as rows of ``UNIT`` bytes, zeros behind."""
    every = np.lib.stride_tricks.sliding_window_view(np.concatenate([spans.letters, np.zeros(UNIT, np.uint8)]), UNIT)
    out = every[spans.start]
    out[np.arange(UNIT) >= spans.size[:, None]] = 0
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def unit_hashes(units: np.ndarray) -> np.ndarray:
    """64-bit hash of each packed unit."""
    words = np.ascontiguousarray(units).view(np.uint64)
    out = _mixed(words[:, 0] + np.uint64(1))
    for k in range(1, words.shape[1]):
        out = _mixed(out + words[:, k] * np.uint64(0x9E3779B97F4A7C15))
    return out


def units_of(text: bytes) -> set[bytes]:
    """Distinct units of a lower-cased text."""
    s = spans_of([text])
    return {s.letters[a : a + n].tobytes() for a, n in zip(s.start.tolist(), s.size.tolist(), strict=True)}


def parts_of(text: bytes) -> list[bytes]:
    """The text, or if it is long, parts that no unit crosses."""
    out, at = [], 0
    while len(text) - at > PART_BYTES:
        cut = _CUT.search(text, at + PART_BYTES // 2)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


@lru_cache(maxsize=UNIT + 1)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found = [(i, j, k) for i in range(length) for j in range(i + 1, min(length, i + SPAN - 1)) for k in range(j + 1, min(length, i + SPAN))]
    i, j, k = np.array(found, np.int64).reshape(-1, ORDER).T
    return i, j, k, (k - i + 1).astype(np.int32)


def features(units: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For units of each length: their places, unit row, subsequence and unit-norm weight of each feature."""
    lengths = np.array([len(u) for u in units])
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        i, j, k, span = _triples(length)
        if not len(i):
            continue
        for start in range(0, len(at), max(1, CELLS // len(i))):
            part = at[start : start + max(1, CELLS // len(i))]
            symbols = _SYMBOL[np.frombuffer(b"".join(units[p] for p in part), np.uint8).reshape(len(part), length)]
            a, b, c = symbols[:, i], symbols[:, j], symbols[:, k]
            key = np.where((a > 0) & (b > 0) & (c > 0), ((a * SYMBOLS + b) * SYMBOLS + c) * 16 + span, 0)
            key.sort(axis=1)
            row = np.repeat(np.arange(len(part)), key.shape[1])
            flat = key.ravel()
            row, flat = row[flat > 0], flat[flat > 0]
            if not len(flat):
                continue
            code = flat >> 4
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])]))
            weight = np.add.reduceat(_POWERS[flat & 15], first)
            code, row = code[first], row[first]
            norm = np.sqrt(np.bincount(row, weight * weight, len(part)))
            yield part, row, code, weight / norm[row]


def kernel(units: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Normalised kernel of every unit with every landmark, exactly."""
    found = list(features(landmarks))
    used = np.unique(np.concatenate([code for _, _, code, _ in found])) if found else np.zeros(0, np.int32)
    number = np.full(SYMBOLS**ORDER, -1, np.int32)
    number[used] = np.arange(len(used))
    table = np.zeros((len(used), len(landmarks)), np.float32)
    for part, row, code, weight in found:
        table[number[code], part[row]] = weight
    out = np.zeros((len(units), len(landmarks)))
    for part, row, code, weight in features(units):
        shared = np.flatnonzero(number[code] >= 0)
        for start in range(0, len(shared), 200_000):
            u = shared[start : start + 200_000]
            np.add.at(out, part[row[u]], table[number[code[u]]] * weight[u, None])
    return out


def fold(landmarks: list[bytes], alpha: np.ndarray) -> np.ndarray:
    """One weight per subsequence: the landmarks' features, weighed by alpha."""
    table = np.zeros(SYMBOLS**ORDER)
    for part, row, code, weight in features(landmarks):
        np.add.at(table, code, weight * alpha[part[row]])
    return table.astype(np.float32)


def _norms(symbols: np.ndarray) -> np.ndarray:
    """Norm of the features of units of one length."""
    i, j, k, span = _triples(symbols.shape[1])
    out = np.full(len(symbols), np.sqrt((_POWERS[span] ** 2).sum()))
    order = np.sort(symbols, axis=1)
    odd = np.flatnonzero((order[:, 0] == 0) | (order[:, 1:] == order[:, :-1]).any(axis=1))
    if len(odd):  # a subsequence may occur repeatedly, or hold a gap
        a, b, c = symbols[odd][:, i], symbols[odd][:, j], symbols[odd][:, k]
        key = np.where((a > 0) & (b > 0) & (c > 0), ((a * SYMBOLS + b) * SYMBOLS + c) * 16 + span, 0)
        key.sort(axis=1)
        first = np.ones(key.shape, bool)
        first[:, 1:] = key[:, 1:] >> 4 != key[:, :-1] >> 4
        place = np.flatnonzero(first.ravel())
        sums = np.add.reduceat(np.where(key > 0, _POWERS[key & 15], 0.0).ravel(), place)
        out[odd] = np.sqrt(np.bincount(place // key.shape[1], sums * sums, len(odd)))
    return out


def packed_margins(units: np.ndarray, sizes: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Margin of each packed unit: its features' weights, over their norm."""
    out = np.full(len(units), bias)
    for length in np.unique(sizes).tolist():
        i, j, k, span = _triples(length)
        if not len(i):
            continue
        at, power = np.flatnonzero(sizes == length), _POWERS[span].astype(np.float32)
        for start in range(0, len(at), max(1, CELLS // len(i))):
            part = at[start : start + max(1, CELLS // len(i))]
            symbols = _SYMBOL[units[part, :length]]
            a, b, c = symbols[:, i], symbols[:, j], symbols[:, k]
            found = weights[(a * SYMBOLS + b) * SYMBOLS + c]
            if not symbols.all():
                found = found * ((a > 0) & (b > 0) & (c > 0))
            norm = _norms(symbols)
            out[part] += np.divide(found @ power, norm, out=np.zeros(len(part)), where=norm > 0)
    return out


def margins(units: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    sizes = np.array([len(u) for u in units], np.int64)
    table = np.zeros((len(units), sizes.max(initial=1)), np.uint8)
    for row, u in enumerate(units):
        table[row, : len(u)] = np.frombuffer(u, np.uint8)
    return packed_margins(table, sizes, weights, bias)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss and balanced classes, by Newton steps on its active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w, active = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(steps):
        xa = x[active] * cost[active, None]
        w = np.linalg.solve(ridge + xa.T @ x[active], xa.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def fit_machine(positive: list[bytes], negative: list[bytes]) -> tuple[np.ndarray, float]:
    """Nyström features on landmarks of both classes, a machine on them, folded to subsequence weights."""
    half = LANDMARKS // 2
    landmarks = list(dict.fromkeys(positive[:half] + negative[: LANDMARKS - min(half, len(positive))]))
    gram = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-3
    whiten = vectors[:, good] / np.sqrt(values[good])
    units = positive + negative
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    w, bias = fit_svm(kernel(units, landmarks) @ whiten, y)
    return fold(landmarks, whiten @ w), bias


def cover(words: list[tuple[bytes, list[int]]]) -> list[bytes]:
    """Words that cover the texts they stand for, most new texts first, until each next one adds nothing."""
    left = [(w, set(d)) for w, d in words]
    out: list[bytes] = []
    seen: set[int] = set()
    while left:
        left = [(w, d - seen) for w, d in left]
        left = [x for x in left if x[1]]
        if not left:
            break
        word, docs = max(left, key=lambda x: (len(x[1]), x[0]))
        if len(docs) < 2 and out:
            break
        out.append(word)
        seen |= docs
    return out


class Model:
    """Subsequence weights, bias, and the logistic curve of the highest margin."""

    def __init__(self, weights: np.ndarray | None, bias: float = 0.0, slope: float = 0.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift
        self._forget()

    def _forget(self) -> None:
        self.known, self.margin = np.zeros(0, np.uint64), np.zeros(0)

    def __getstate__(self):
        return self.__dict__ | {"known": np.zeros(0, np.uint64), "margin": np.zeros(0)}

    def _margins(self, units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and margin of each unit; the margins of many seen before are remembered."""
        hashes = unit_hashes(units)
        distinct, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        old = self.known[place] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        found = np.zeros(len(distinct))
        found[old] = self.margin[place[old]]
        new = first[~old]
        found[~old] = packed_margins(units[new], sizes[new], self.weights, self.bias)
        if len(self.known) + len(new) > CACHE:
            self.known, self.margin = distinct[:CACHE], found[:CACHE]
        else:
            self.known = np.concatenate([self.known, distinct[~old]])
            order = np.argsort(self.known)
            self.known, self.margin = self.known[order], np.concatenate([self.margin, found[~old]])[order]
        return hashes, found[at]

    def _parts(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, Spans, np.ndarray, np.ndarray]]:
        """Texts of the units, the units, their hashes and margins, about ``PART_BYTES`` at a time."""
        owners, held, size = [], [], 0
        for owner, text in enumerate(texts):
            for part in parts_of(text):
                if held and size + len(part) > PART_BYTES:
                    yield self._scored(owners, held)
                    owners, held, size = [], [], 0
                owners.append(owner)
                held.append(part)
                size += len(part)
        if held:
            yield self._scored(owners, held)

    def _scored(self, owners: list[int], parts: list[bytes]) -> tuple[np.ndarray, Spans, np.ndarray, np.ndarray]:
        spans = spans_of(parts)
        return np.array(owners)[spans.row], spans, *self._margins(packed(spans), spans.size)

    def highest(self, texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Highest margin of each text and the unit that has it; equal margins go by the unit's hash."""
        top, units, hashes = np.full(len(texts), -np.inf), [b""] * len(texts), np.zeros(len(texts), np.uint64)
        for owner, spans, code, margin in self._parts(texts):
            order = np.lexsort((code, margin, owner))
            last = order[np.flatnonzero(np.diff(owner[order], append=-1))]
            for at, row in zip(last.tolist(), owner[last].tolist(), strict=True):
                if (margin[at], code[at]) > (top[row], hashes[row]):
                    top[row], hashes[row] = margin[at], code[at]
                    units[row] = spans.letters[spans.start[at] : spans.start[at] + spans.size[at]].tobytes()
        return top, units

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        top = np.full(len(texts), -4.0)
        for owner, _, _, margin in self._parts(texts):
            np.maximum.at(top, owner, margin)
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -50, 50)))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y = 1 | x), with targets kept off 0 and 1."""
    ones, zeros = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a = np.column_stack([np.clip(x, -4, 4), np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), a.T @ (p - t) + 1e-3 * w)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).cast("binary")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches, "text"):
        sets = [units_of(t) for t in rows_of(chunk.column("text"))]
        sizes = [len(s) for s in sets]
        yield pa.RecordBatch.from_pydict({
            "unit": pa.array([u for s in sets for u in s], pa.binary()),
            "toxic": pa.array(np.repeat(np.array(chunk.column("toxic").to_pylist(), np.int32), sizes)),
            "number": pa.array(np.repeat(np.array(chunk.column("number").to_pylist(), np.int64), sizes)),
        })


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks."""
    spark = docs.sparkSession
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = [r for t, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)) for r in marked.filter(F.col("toxic") == t).orderBy(*order).limit(n).collect()]
    if len({r["toxic"] for r in sample}) < 2:
        return Model(None)
    chosen = spark.createDataFrame([(r["doc_id"], r["toxic"], i) for i, r in enumerate(sample)], "doc_id bigint, toxic int, number bigint")
    texts = docs.select("doc_id", lowered(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("number").alias("number"))
    rest = F.pmod(F.xxhash64("number"), F.lit(4)) == 0
    # Words of toxic learning texts that clean ones lack.
    learning = texts.filter(~rest)
    seen = learning.mapInArrow(_units, "unit binary, toxic int, number bigint").groupBy("unit").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"), F.collect_list(F.when(F.col("toxic") == 1, F.col("number"))).alias("docs")
    )
    listed = seen.filter("bad >= 2 and good * 20 <= bad").orderBy(F.desc("bad"), "unit").limit(SEEDS).collect()
    common = [bytes(r["unit"]) for r in seen.filter("good >= 2").orderBy(F.desc("good"), "unit").limit(SEEDS // 2).select("unit").collect()]
    seeds = cover([(bytes(r["unit"]), r["docs"]) for r in listed])
    if not seeds:
        seeds = [bytes(r["unit"]) for r in seen.filter("bad >= 1 and good = 0").orderBy(F.desc("bad"), "unit").limit(SEEDS // 8).select("unit").collect()]
    if not seeds or not common:
        return Model(None)

    def tops(model: Model, which: DataFrame) -> pd.DataFrame:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in text_chunks(batches, "text"):
                top, unit = shared.value.highest(rows_of(chunk.column("text")))
                yield pa.RecordBatch.from_pydict({"toxic": chunk.column("toxic"), "margin": pa.array(top), "unit": pa.array(unit, pa.binary())})

        found = which.select("text", "toxic").mapInArrow(run, "toxic int, margin double, unit binary").toPandas()
        shared.destroy()
        return found.assign(unit=found.unit.map(bytes)).sort_values(["toxic", "unit", "margin"])

    positive, negative = seeds, common
    model = Model(*fit_machine(positive, negative))
    for _ in range(ROUNDS):
        found = tops(model, learning)
        hard = found[(found.toxic == 0) & (found.margin > -1)].sort_values(["margin", "unit"], ascending=False).unit
        hits = found[(found.toxic == 1) & (found.margin > 0)].unit.value_counts()
        negative = list(dict.fromkeys([u for u in hard if u not in set(seeds)] + negative))[: 2 * SEEDS]
        clean = set(negative)
        positive = list(dict.fromkeys(seeds + [u for u in hits.index if u not in clean]))[:SEEDS]
        model = Model(*fit_machine(positive, negative))
    held = tops(model, texts.filter(rest))
    if held.toxic.nunique() < 2:
        held = tops(model, learning)
    model.slope, model.shift = fit_logistic(held.margin.to_numpy(), held.toxic.to_numpy())
    return model


def score_column(model: Model, text: Column, spark) -> Column:
    """Score of a text column, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            chunks = text_chunks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text")
            found = [shared.value.scores(rows_of(c.column("text"))) for c in chunks]
            yield pa.array(np.concatenate(found) if found else [], pa.float64())

    return score(lowered(text))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score, predicted."""
    scored = docs.select("doc_id", score_column(model, F.col("text"), docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the model rejects, columns unchanged."""
    return docs.filter(score_column(model, F.col("text"), docs.sparkSession) < THRESHOLD)
