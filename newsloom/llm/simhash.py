"""SimHash near-duplicates by pivot distance tables.

A document's fingerprint has a bit set if over half of its shingles' hashes (XXH64, seed 42) have it set. Two
fingerprints are linked if ``MAX_BITS`` bits or fewer differ.

The references are the 64 Walsh words (bit i of word r is the parity of ``i & r``), and a fingerprint's table row
holds its Hamming distances to all of them. Between two fingerprints no distance can differ by more than their
own distance; and as the squares of the 64 differences average to the distance, a pair that differs in more than
four bits differs by more than two in some column. Pairs are therefore discarded by their largest column
difference, and the few survivors are verified on the fingerprints.

Only pairs of one cell are looked at. Sums of the distances to some references, with signs, depend on one block of
bits alone (half of an inverse Walsh transform). Two differing bits leave two of four blocks untouched, so one of
six tables, keyed by the sums of two blocks, holds the pair in one cell. Cells with over ``LIMIT`` fingerprints are
dealt again by the four halves of their open blocks, at most twice: then eight bits are open, and a cell holds 256
fingerprints at most. So no cell is capped and none is large, whatever number of texts look alike; equal
fingerprints are one node from the start.

Defined results: null, empty and word-less texts have fingerprint zero and are linked like others; fewer words than
a shingle form one shingle. Repeated rows share their class; a class without any id has a null component. An empty
table gives an empty result. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, rows_of, text_chunks
from newsloom.llm.near_dedup import components
from newsloom.skew import keyed_lookup

WORDS, SEED, BITS = 3, 42, 64
MAX_BITS = 2
LIMIT, LEVELS = 256, 3
#: Bytes of a text that are shingled at once.
SLICE = 1 << 20
#: Rows per key above which a key's rows are spread over several tasks.
HOT_ROWS = 100_000

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_PARITY = (np.bitwise_count(np.arange(BITS)[:, None] & np.arange(BITS)) & 1).astype(np.int64)
WALSH = (_PARITY.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
_MULTIPLIERS = np.random.Generator(np.random.PCG64(13)).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, size: int = WORDS) -> Iterator[list[int]]:
    """Hashes of a text's shingles, repeats included, slice by slice."""
    carry: list[bytes] = []
    at = total = 0
    while at < len(text):
        cut = _SPACE.search(text, at + SLICE) if len(text) - at > SLICE else None
        stop = cut.start() if cut else len(text)
        words = carry + text[at:stop].lower().split()
        total += len(words) - len(carry)
        if len(words) >= size:
            yield [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(size))))]
        carry, at = words[1 - size :] if size > 1 else [], stop
    if 0 < total < size:
        yield [xxhash.xxh64_intdigest(b" ".join(carry), SEED)]


def fingerprints_of(texts: list[bytes], size: int = WORDS) -> np.ndarray:
    """Fingerprint of each text, zero without words."""
    ones, counts = np.zeros((len(texts), BITS)), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    rows: list[int] = []
    sizes: list[int] = []

    def settle() -> None:
        of = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        first, last = rows[0], rows[-1]
        row = np.repeat(np.array(rows) - first, sizes)
        for k in range(8):
            seen = np.bincount(row * 256 + of[:, k], minlength=(last - first + 1) * 256).reshape(-1, 256)
            ones[first : last + 1, 8 * k : 8 * k + 8] += seen @ _OF_BYTE
        hashes.clear(), rows.clear(), sizes.clear()

    for row, text in enumerate(texts):
        for part in shingle_hashes(text, size):
            hashes += part
            rows.append(row)
            sizes.append(len(part))
            counts[row] += len(part)
            if len(hashes) > SLICE // 8 or row - rows[0] > 1000:
                settle()
    if rows:
        settle()
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprint(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            found = fingerprints_of(rows_of(chunk.column("text")), size)
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id"), "fp": pa.array(found.view(np.int64))})

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: doc_id and fp, the fingerprint as a signed number."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint(words), "doc_id bigint, fp bigint")


def distance_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to all references."""
    return np.bitwise_count(fp[:, None] ^ WALSH)


def block_sums(table: np.ndarray, width: int) -> np.ndarray:
    """(fingerprint, block, ``width`` sums): sums of distances that depend on the bits of one block of ``width`` alone."""
    blocks = BITS // width
    sign = (1 - 2 * _PARITY[:blocks, :blocks]).astype(np.float32)
    centred = (BITS - 2 * table.astype(np.float32)).reshape(-1, blocks, width)
    return np.matmul(sign, centred).astype(np.int32) // blocks


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _deal(level: int):
    """Each fingerprint into its six cells: two of the four open blocks (bit mask ``open``, by fours) are the key, the others stay open."""
    width = 16 >> level
    fours = width // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, opened, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            sums = block_sums(distance_table(fp.view(np.uint64)), width)
            codes = (sums.astype(np.int64).view(np.uint64) * _MULTIPLIERS[:width]).sum(axis=2, dtype=np.uint64)
            for mask in np.unique(opened).tolist():
                mine = opened == mask
                blocks = [b for b in range(BITS // width) if mask >> (b * fours) & 1]
                for i, j in combinations(blocks, 2):
                    cell = _mixed(_mixed(key[mine].view(np.uint64) ^ codes[mine, i]) + codes[mine, j] + np.uint64(64 * i + j))
                    left = mask & ~sum(((1 << fours) - 1) << (b * fours) for b in (i, j))
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array(cell.view(np.int64)), "open": pa.array(np.full(len(cell), left, np.int32)), "fp": pa.array(fp[mine]),
                    })

    return run


def pairs_within(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints of the same cell; rows are in order of their key."""
    table = distance_table(fp.view(np.uint64)).astype(np.int8)
    left, right = [], []
    for shift in range(1, len(key)):
        i = np.flatnonzero(key[shift:] == key[:-shift])
        if not len(i):
            break
        for columns in np.split(np.arange(BITS), 8):
            apart = np.abs(table[i[:, None], columns] - table[i[:, None] + shift, columns]).max(axis=1)
            i = i[apart <= MAX_BITS]
        i = i[np.bitwise_count((fp[i] ^ fp[i + shift]).view(np.uint64)) <= MAX_BITS]
        left.append(fp[i])
        right.append(fp[i + shift])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted cells; the last cell of a batch waits for the next one."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def linked(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = pairs_within(key, fp)
        return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    for batch in batches:
        key, fp = (np.concatenate([old, batch.column(i).to_numpy(zero_copy_only=False)]) for i, old in enumerate((key, fp)))
        last = np.searchsorted(key, key[-1]) if len(key) else 0
        yield linked(key[:last], fp[:last])
        key, fp = key[last:], fp[last:]
    yield linked(key, fp)


def link_fingerprints(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Linked pairs (a, b), a < b, of the distinct fingerprints in ``nodes`` (fp)."""
    waiting = nodes.select(F.lit(0).cast("long").alias("key"), F.lit((1 << 16) - 1).alias("open"), "fp")
    found = []
    for level in range(LEVELS):
        dealt = scratch.cut(waiting.mapInArrow(_deal(level), "key bigint, open int, fp bigint"), "dealt")
        sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        cells = scratch.cut(keyed_lookup(dealt, sizes, ["key"], "fp", weight="n", how="inner", hot_rows=HOT_ROWS), "cells")
        scratch.drop(dealt)
        last = level == LEVELS - 1  # eight open bits: no cell is larger than LIMIT
        small = cells.filter(F.lit(last) | (F.col("n") <= LIMIT)).select("key", "fp")
        found.append(scratch.cut(small.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs, "a bigint, b bigint"), "found"))
        waiting = cells.filter(F.col("n") > LIMIT).select("key", "open", "fp")
        if last or waiting.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, fingerprint (hexadecimal), component_id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.cut(fingerprints(docs, words).withColumn("row", F.monotonically_increasing_id()), "rows")
    nodes = scratch.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    links = scratch.cut(link_fingerprints(nodes.select("fp"), scratch), "links")
    linked = links.select("a").union(links.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("comp"))
    comps = components(linked, links, scratch).select(F.col("node").alias("fp"), "comp")
    classes = nodes.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = scratch.cut(classes.join(least, "comp").select("fp", "n", "component_id"), "classes")
    found = keyed_lookup(rows, ids, ["fp"], "row", weight="n", how="inner", hot_rows=HOT_ROWS)
    return found.select("doc_id", _hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def _hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
