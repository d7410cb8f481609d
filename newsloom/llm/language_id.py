"""Language identification by rank-order profiles of n-grams.

A language's profile is its ``PROFILE`` most frequent n-grams over all learning texts; a document's profile is
made the same way. The prediction is the language with the smallest out-of-place distance: the sum over the
document's n-grams of the difference of ranks, or ``PROFILE`` where the language lacks the n-gram. N-grams are
1 to 3 bytes of the lower-cased UTF-8 words, with a blank at both ends; ties of counts go by bytes.

Counting is done per task and merged by one aggregation. The profiles are the only broadcast data: at most
``MAX_LANGUAGES`` times ``PROFILE`` rows, which is checked.

Defined results: null text or text without a letter gives ``und`` and score 0; so does every text if nothing
was learned. Otherwise the score is second / (best + second) of the distances (1 for a single language). Equal
distances go to the first language in code-point order. Repeated rows are each predicted; an empty table gives
an empty result. Only doc_id, text and, for learning, lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import bytes_of, text_chunks

SIZES, PROFILE, MAX_LANGUAGES = (1, 2, 3), 300, 4096
CHUNK_BYTES = 1 << 20
#: Rows of partial counts that a task holds before it sends them on.
HELD_COUNTS = 1 << 20

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_LOW = np.uint64(0xFFFFFFFF)


def grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Row number << 32 | n-gram, unsorted, for all n-grams of all rows of lower-cased text."""
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(off))
    padded = np.full(len(data) + rows + 1, 32, np.uint8)
    padded[np.arange(len(data)) + row + 1] = _LETTER[data]
    owner = np.zeros(len(padded), np.uint64)
    owner[np.arange(len(data)) + row + 1] = row
    owner[off[1:] + np.arange(1, rows + 1)] = np.arange(rows)  # the blank behind a row
    wide, solid, out = padded.astype(np.uint64), padded != 32, []
    for n in SIZES:
        count = len(padded) - n + 1
        if count <= 0:
            continue
        code = wide[:count]
        for k in range(1, n):
            code = code << np.uint64(8) | wide[k : count + k]
        good = solid[:count] if n == 1 else solid[:count] | solid[1 : count + 1] if n == 2 else np.ones(count, bool)
        for k in range(1, n - 1):
            good = good & solid[k : count + k]
        # A gram that starts with a blank belongs to the row of its next byte.
        at = owner[:count] if n == 1 else np.where(solid[:count], owner[:count], owner[1 : count + 1])
        out.append((at << np.uint64(32) | code)[good])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts (or sums of weights)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[starts], np.diff(np.concatenate([starts, [len(keys)]]))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(weights, starts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    langs: dict[str, int] = {}
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def flush() -> pa.RecordBatch:
        names = list(langs)
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([names[i] for i in (keys >> np.uint64(32)).tolist()], pa.string()),
            "gram": pa.array((keys & _LOW).astype(np.int64)), "n": pa.array(counts),
        })

    for chunk in text_chunks(batches, "text", CHUNK_BYTES):
        mine = np.array([langs.setdefault(x, len(langs)) for x in chunk.column("lang").to_pylist()], np.uint64)
        found = grams(*bytes_of(chunk.column("text")))
        k, c = counted(mine[(found >> np.uint64(32)).astype(np.int64)] << np.uint64(32) | found & _LOW)
        keys, counts = counted(np.concatenate([keys, k]), np.concatenate([counts, c]))
        if len(keys) > HELD_COUNTS:
            yield flush()
            keys, counts = keys[:0], counts[:0]
    yield flush()


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).cast("binary")


def learn_profiles(labelled: DataFrame, profile: int = PROFILE) -> dict[str, list[int]]:
    """N-grams of each language in ``labelled`` (text, lang), most frequent first."""
    texts = labelled.filter("lang is not null and text is not null").select(lowered(F.col("text")).alias("text"), "lang")
    counts = texts.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= profile)
    out: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").limit(MAX_LANGUAGES * profile + 1).collect():
        out.setdefault(row["lang"], []).append(row["gram"])
    if len(out) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return out


class Ranker:
    """Out-of-place distances of documents to all profiles."""

    def __init__(self, profiles: dict[str, list[int]], profile: int = PROFILE):
        self.langs, self.profile = sorted(profiles, key=lambda x: x.encode()), profile
        self.codes = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def distances(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each row to each language, and the length of its own profile."""
        keys, counts = counted(grams(data, off))
        order = counts.astype(np.uint64) << np.uint64(32) | _LOW - (keys & _LOW)
        ends = np.searchsorted(keys >> np.uint64(32), np.arange(len(off) - 1), side="right")
        top, start = [], 0
        for end in ends.tolist():
            own = order[start:end]
            if len(own) > self.profile:
                own = np.partition(own, len(own) - self.profile)[len(own) - self.profile :]
            top.append(np.sort(own)[::-1])
            start = end
        sizes = np.array([len(t) for t in top])
        codes = (_LOW - (np.concatenate(top) & _LOW)).astype(np.int64) if top else np.zeros(0, np.int64)
        rank = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.searchsorted(self.codes, codes)
        place[(place == len(self.codes)) | (np.append(self.codes, -1)[place] != codes)] = len(self.codes)
        own = self.ranks[place]
        apart = np.where(own < 0, self.profile, np.abs(own - rank[:, None]))
        sums = np.concatenate([np.zeros((1, len(self.langs)), np.int64), np.cumsum(apart, axis=0)])
        return sums[np.cumsum(sizes)] - sums[np.cumsum(sizes) - sizes], sizes

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], list[float]]:
        apart, sizes = self.distances(data, off)
        best = np.argmin(apart, axis=1)
        first = apart[np.arange(len(apart)), best].astype(float)
        if len(self.langs) > 1:
            second = np.partition(apart, 1, axis=1)[:, 1].astype(float)
            score = np.where(first + second > 0, second / np.maximum(first + second, 1e-9), 0.5)
        else:
            score = np.ones(len(apart))
        return [self.langs[b] for b in best.tolist()], score.tolist()


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    readable = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", lowered(F.col("text")).alias("text"), readable.alias("readable"))
    ranker = docs.sparkSession.sparkContext.broadcast(Ranker(profiles) if profiles else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ranker.value
        for chunk in text_chunks(batches, "text", CHUNK_BYTES):
            known = chunk.column("readable").to_pylist()
            langs, scores = model.predict(*bytes_of(chunk.column("text"))) if model else (["und"] * len(known), [0.0] * len(known))
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), "lang_pred": pa.array([x if k else "und" for x, k in zip(langs, known, strict=True)], pa.string()),
                "score": pa.array([x if k and model else 0.0 for x, k in zip(scores, known, strict=True)], pa.float64()),
            })

    return rows.select(F.col("doc_id").cast("long"), "text", "readable").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
