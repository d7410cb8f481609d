"""Benchmark decontamination with one FM-index per training shard.

A shard is a bounded slice of a task's rows. Its texts become word numbers of the benchmark's vocabulary; only
runs of such words as long as the shortest test phrase can hold an occurrence, so the index is built over
those runs, parted by a separator. All test phrases are searched backwards through wavelet-tree ranks,
occurrences are located by sampled suffix positions, and their spans are merged per document.

No row moves: the only shared data are the test phrases, sent to the tasks in blocks of a bounded size; each
block is a further pass inside the same stage. Any number of documents may hold one passage.

Defined results: null or word-less text has no words and no hits; an item with null or word-less text has no phrase;
an item with a null id is searched like any other, all of them count as one item, null in the list of items and
absent from its digest, as in the SQL; items with equal phrases are all reported; repeated rows are each reported; empty tables give empty or hit-less
results; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import fresh, rows_of, text_chunks
from newsloom.llm.fm_index import FMIndex

WINDOW = 10
#: Text bytes of a shard, and of a block of test phrases.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 8 << 20
FIRST_WORD = 2  # 0 ends a shard, 1 parts runs
_WORD_BYTES = bytes(
    b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
MARK = "struct<words: bigint, spans: array<struct<start: bigint, end: bigint>>, items: array<string>>"
_MARK = pa.struct([
    ("words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: digits, a-z and everything beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


def _null_last(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


class Phrases:
    """Distinct test phrases of a block of items, as numbers of its own vocabulary."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, FIRST_WORD + len(self.vocabulary)) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1)) if ids else ():
                found.setdefault(tuple(ids[at : at + window]), set()).add(item)
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.table = np.zeros((len(found), window), np.int64)
        for row, p in enumerate(found):
            self.table[row, : len(p)] = p
        self.items = [sorted(x, key=_null_last) for x in found.values()]
        self.shortest = int(self.lengths.min()) if found else 0

    def occurrences(self, docs: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Words per document; document, first word and phrase of each occurrence."""
        get, numbers, counts = self.vocabulary.get, [], []
        for text in docs:
            words = words_of(text)
            counts.append(len(words))
            numbers.extend([get(w, 0) for w in words])
            numbers.append(0)
        none = np.zeros(0, np.int64)
        if not self.shortest:
            return counts, none, none, none
        seq = np.array(numbers, np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (seq > 0).view(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return counts, none, none, none
        sizes = ends - starts + 1  # with the separator behind the run
        where = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        symbols = np.concatenate([np.maximum(seq[where], 1), [0]])
        index = FMIndex(symbols, FIRST_WORD + len(self.vocabulary))
        low, high = index.search(self.table, self.lengths)
        hits = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits) + np.arange(hits.sum())
        place = where[index.locate(rows)]
        firsts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
        doc = np.searchsorted(firsts, place, side="right") - 1
        return counts, doc, place - firsts[doc], np.repeat(np.arange(len(hits)), hits)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _mark(text_column: str, mark_column: str, shared, shard_bytes: int, dropped: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for shard in text_chunks(batches, text_column, shard_bytes):
            counts, doc, start, phrase = phrases.occurrences(rows_of(shard.column(text_column)))
            had = shard.column(mark_column).to_pylist()
            marks = [
                {"words": n, "spans": [(s["start"], s["end"]) for s in h["spans"]] if h else [], "items": set(h["items"]) if h else set()}
                for n, h in zip(counts, had, strict=True)
            ]
            length = phrases.lengths[phrase] if len(phrase) else phrase
            for d, s, p, n in zip(doc.tolist(), start.tolist(), phrase.tolist(), length.tolist(), strict=True):
                marks[d]["spans"].append((s, s + n))
                marks[d]["items"].update(phrases.items[p])
            for m in marks:
                m["spans"] = [{"start": a, "end": b} for a, b in merged(m["spans"])]
                m["items"] = sorted(m["items"], key=_null_last)
            columns = {f.name: shard.column(i) for i, f in enumerate(shard.schema) if f.name != dropped}
            yield pa.RecordBatch.from_pydict(columns | {mark_column: pa.array(marks, _MARK)})

    return run


def mark_occurrences(
    docs: DataFrame, benchmark: DataFrame, name: str = "marks", text: str = "text",
    window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, keep_text: bool = True,
) -> DataFrame:
    """``docs`` with a column ``name``: number of words, merged word spans to remove, sorted items found.

    ``keep_text=False`` leaves the text column out of the result.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    # Plain names on the way through Arrow code, whatever the columns are called.
    names, plain = [*docs.columns, name], [f"c{i}" for i in range(len(docs.columns) + 1)]
    out = docs.toDF(*plain[:-1]).withColumn(plain[-1], F.lit(None).cast(MARK))
    found, marked = dict(zip(names, plain, strict=True))[text], plain[-1]
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Phrases([(r["item"], bytes(r["text"])) for r in mine], window))
        dropped = None if keep_text or block < blocks - 1 else found
        schema = T.StructType([f for f in out.schema if f.name != dropped])
        out = out.mapInArrow(_mark(found, marked, shared, shard_bytes, dropped), schema)
    return out.toDF(*[n for n in names if keep_text or n != text])


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    marks = mark_occurrences(docs.select("doc_id", "text"), benchmark, keep_text=False, **options)
    hit = F.coalesce(F.aggregate("marks.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.lit(0).cast("long"))
    return marks.select(
        "doc_id", F.col("marks.words").alias("n_words"), hit.alias("n_hit"), F.size("marks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("marks.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("marks.spans") > 0).alias("contaminated"), F.col("marks.spans").alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a test phrase, columns unchanged."""
    name = fresh(docs, "marks")
    return mark_occurrences(docs, benchmark, name, **options).filter(F.size(F.col(name)["spans"]) == 0).drop(name)

