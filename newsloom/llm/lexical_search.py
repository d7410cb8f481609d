"""Ranked lexical search by an Aho-Corasick scan of the documents.

All terms of the items, each guarded by a blank on both sides, form one automaton. A single pass over the texts
counts the term frequencies of every document straight from the text; there is no document index. The scan also
counts each document's terms, from which the number of documents, their total length and, with the hits, the
document frequencies follow by plain aggregations. The automaton's outputs are term numbers; each maps to the items
that hold it, through which a term's contribution is added to their scores.

Nothing is emitted per item and document: a task keeps the ``top`` best rows of each item and sends those on.
Items are taken in blocks of ``BLOCK_BYTES`` of distinct terms, one broadcast after the other, so the automaton is
bounded however many items there are. Long texts are scanned in slices that meet at a blank.

Defined results: null and term-less texts are no documents of the collection; rows with one item_id (or none) are
one item, a term counts once for it; repeated document rows are ranked each; equal scores go by doc_id, null ids
last; empty tables give an empty result. Only doc_id, item_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, ascii_lower, rows_of, text_chunks

TOP = 50
#: Bytes of the distinct terms of a block of items.
BLOCK_BYTES = 1 << 20
#: Bytes of text scanned at once, and cells of a task's score table.
SLICE, CELLS = 1 << 20, 1 << 20
SLOTS = 32
# The characters between terms, and the scale of the ranking.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WEIGHT_SCALE, TF_SCALE, K_ONE, LENGTH_PERCENT = 1000, 1_000_000_000, 20, 50
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_second = itemgetter(1)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item, term), the item as a string."""
    found = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0))
    return items.select(F.col("item_id").cast("string").alias("item"), F.explode(found).alias("term")).distinct()


class Automaton:
    """Guarded terms; term i belongs to the items ``items_of[starts[i]:starts[i + 1]]``."""

    def __init__(self, pairs: list[tuple[str | None, str]]):
        self.items = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i or ""))
        number = {i: k for k, i in enumerate(self.items)}
        holders: dict[str, list[int]] = {}
        for item, term in pairs:
            holders.setdefault(term, []).append(number[item])
        self.terms = sorted(holders)
        self.sizes = np.array([len(holders[t]) for t in self.terms], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.items_of = np.array([k for t in self.terms for k in sorted(holders[t])], np.int64)
        self._machine = None

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def frequencies(self, text: bytes) -> tuple[int, Counter]:
        """Number of the text's terms, and how often it holds each item term."""
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for k, term in enumerate(self.terms):
                # One character per byte: a guarded term can't begin or end within another.
                self._machine.add_word(f" {term.encode().decode('latin-1')} ", k)
            self._machine.make_automaton()
        padded = b" " + text.translate(_TERM_BYTES) + b" "
        total, at, found = 0, 0, Counter()
        while at < len(padded) - 1:
            stop = padded.find(b" ", at + SLICE) if at + SLICE < len(padded) else -1
            stop = stop if stop > 0 else len(padded) - 1
            part = padded[at : stop + 1]  # blanks at both ends; the next part begins with this one's last
            total += len(part.split())
            if self.terms:
                found.update(map(_second, self._machine.iter(part.decode("latin-1"))))
            at = stop
        return total, found


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for chunk in text_chunks(batches, "text"):
            found = [automaton.frequencies(t) for t in rows_of(chunk.column("text"))]
            ends = np.concatenate([[0], np.cumsum([len(c) for _, c in found])]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), "n": pa.array([n for n, _ in found], pa.int64()),
                "terms": pa.ListArray.from_arrays(ends, pa.array([t for _, c in found for t in c], pa.int32())),
                "times": pa.ListArray.from_arrays(ends, pa.array([x for _, c in found for x in c.values()], pa.int64())),
            })

    return run


class Scorer:
    """Integer scores of documents for the items of an automaton."""

    def __init__(self, automaton: Automaton, frequency: dict[int, int], documents: int, length: int, top: int):
        self.items, self.starts, self.sizes, self.items_of = automaton.items, automaton.starts, automaton.sizes, automaton.items_of
        self.documents, self.length, self.top = documents, length, top
        self.weights = np.array([self._weight(frequency.get(k, 0)) for k in range(len(self.starts))], np.int64)

    def _weight(self, df: int) -> int:
        return math.floor(WEIGHT_SCALE * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def contributions(self, n: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """What each term adds, in a document of ``n`` terms that holds it ``times`` times."""
        m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * n * self.documents // self.length
        return self.weights[terms] * (TF_SCALE * times // (1000 * times + K_ONE * m))

    def scores(self, row: np.ndarray, terms: np.ndarray, added: np.ndarray, rows: int) -> np.ndarray:
        """(row, item) sums. They are whole numbers below 2^53, which doubles add exactly."""
        sizes = self.sizes[terms]
        ends = np.cumsum(sizes)
        place = np.repeat(self.starts[terms] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        cell = np.repeat(row * len(self.items), sizes) + self.items_of[place]
        return np.bincount(cell, np.repeat(added, sizes), rows * len(self.items)).reshape(rows, -1).astype(np.int64)


def best_rows(item: np.ndarray, score: np.ndarray, unknown: np.ndarray, doc_id: np.ndarray, top: int) -> np.ndarray:
    """Places of each item's ``top`` rows: highest score, then smallest id, null ids last."""
    order = np.lexsort((doc_id, unknown, -score, item))
    grouped = item[order]
    return order[np.arange(len(order)) - np.searchsorted(grouped, grouped) < top]


def _rank(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Scorer = shared.value
        held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        least = np.ones(len(scorer.items), np.int64)  # what a row must score to count
        step = max(1, CELLS // max(1, len(scorer.items)))
        for batch in batches:
            ids = batch.column("doc_id")
            unknown, doc_id = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            n, sizes = batch.column("n").to_numpy(), batch.column("terms").value_lengths().to_numpy()
            terms, times = (batch.column(c).flatten().to_numpy() for c in ("terms", "times"))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            added, ends = scorer.contributions(n[row], terms, times), np.concatenate([[0], np.cumsum(sizes)])
            for at in range(0, batch.num_rows, step):
                stop = min(at + step, batch.num_rows)
                part = slice(ends[at], ends[stop])
                scores = scorer.scores(row[part] - at, terms[part], added[part], stop - at)
                r, item = np.nonzero(scores >= least)
                new = item, scores[r, item], unknown[at + r], doc_id[at + r]
                held = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
                keep = best_rows(*held, scorer.top)
                held = tuple(x[keep] for x in held)
                full = np.flatnonzero(np.bincount(held[0], minlength=len(least)) == scorer.top)
                least[full] = held[1][np.searchsorted(held[0], full, side="right") - 1]
        names = np.array(scorer.items, object)
        yield pa.RecordBatch.from_pydict({
            "item": pa.array(names[held[0]], pa.string()), "doc_id": pa.array(held[3], mask=held[2]), "score": pa.array(held[1]),
        })

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` documents of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    wanted = scratch.cut(item_terms(items), "terms")
    size = wanted.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    found = []
    for block in range(blocks):
        mine = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        automaton = Automaton([(r["item"], r["term"]) for r in mine])
        shared = spark.sparkContext.broadcast(automaton)
        scanned = scratch.cut(texts.mapInArrow(_scan(shared), "doc_id bigint, n bigint, terms array<int>, times array<bigint>"), "scanned")
        shared.destroy()
        documents, length = scanned.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        frequency = {r["term"]: r["count"] for r in scanned.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        scorer = spark.sparkContext.broadcast(Scorer(automaton, frequency, documents, length or 1, top))
        found.append(scratch.cut(scanned.mapInArrow(_rank(scorer), "item string, doc_id bigint, score bigint"), "found"))
        scorer.destroy()
        scratch.drop(scanned)
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # First within slots of an item, so that the last window sees SLOTS * top rows, however many tasks there were.
    for keys in (["item", F.pmod(F.hash("doc_id"), F.lit(SLOTS))], ["item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return best.select(F.col("item").cast(items.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score")
