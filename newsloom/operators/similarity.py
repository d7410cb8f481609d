"""Exact title similarity over distinct titles.

Candidates come from the chunks of the shorter title: cut into disjoint chunks of ``q`` characters, a title within ``k`` changes
of another one keeps all but ``k`` of them, so any ``k + 1`` (the rarest are taken) hold one that occurs in the other title, at
most ``k`` places away.  ``k`` and ``q`` follow from the threshold and the length, so no similar
pair is lost and no block is capped.  Blocks hold titles of like lengths; an n-gram that is no chunk of any title is left out
before the shuffle by a bitmap of all chunks, and a title that shares no block with another one is left out of them.  Pairs inside a block
are held against a lower bound of their distance, marks that count characters; pairs of long titles against another one, a sketch
of n-gram counts.  So texts are joined and compared for few of them.  Work is on distinct
titles, so copies cost nothing, and blocks are compared against a few leading titles per round
(``expand_round``), never all against all.
"""

from __future__ import annotations

import math
import os
import sys
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsloom.functions.text import bind
from newsloom.session import cut_lineage, drop_spent
from newsloom.skew import keyed_lookup

# Ship the ratio function itself, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The similarity that makes two titles one story, and its date reach.
TITLE_THRESHOLD, REACH_DAYS = 0.92, 7
#: Most characters of a chunk; shorter titles have shorter ones.
CHUNK = {"edit": 8, "sequence": 5}
#: Lengths of a block: up to this many times the smallest one.
WIDE = 1.3
PIVOTS = 1024
#: Titles above ``LONG`` characters have a sketch, counts of 3-grams.
SKETCH_GRAM, SKETCH, LONG = 3, 256, 256
#: Buckets of the n-gram counts that order the chunks; smallest and largest size of the bitmap of all chunks, in words of 64 bits.
BUCKETS, BITMAP = 1 << 16, (1 << 12, 1 << 20)
#: Characters of titles that a task looks at at once.
BATCH = 200_000
#: Marks of the characters of a title; rows of a block from which on they are spread over tasks.
MARKS, HOT_BLOCK = ("m0", "m1", "m2", "m3"), 200_000
#: Rows of blocks that are dealt out at once; more are taken slice by slice, so that the disk holds one slice of them.
SLICE_ROWS = 1 << 24


def sequence_ratio(earlier: Column, later: Column, t: float = TITLE_THRESHOLD) -> Column:
    """Matching-blocks ratio; 0 when a cheap upper bound already rules out a ratio of ``t``."""
    def one(a: str, b: str) -> float:
        m = SequenceMatcher(None, a, b)
        return m.ratio() if m.quick_ratio() >= t else 0.0

    @F.pandas_udf(T.DoubleType())
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return ratios(earlier, later)


def _distance(a: str, b: str) -> int:
    """Edit distance, a column of the table at a time as the bits of a few whole numbers."""
    start = len(os.path.commonprefix([a, b]))
    a, b = a[start:], b[start:]
    end = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, d = full, 0, len(a)
    for c in b:
        equal = places.get(c, 0)
        falls = equal | down
        equal |= ((equal & up) + up) ^ up
        rise, fall = down | ~(equal | up) & full, up & equal
        d += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | ~(falls | rise) & full, rise & falls
    return d


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of long texts; the built-in function steps through all pairs of characters."""
    @F.pandas_udf(T.IntegerType())
    def distances(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_distance(p, q) for p, q in zip(x, y)], dtype="int32")

    return distances(a, b)


def _length_ok(la: Column, lb: Column, measure: str, t: float) -> Column:
    short, long = F.least(la, lb), F.greatest(la, lb)
    if measure == "edit":
        return (long - short) <= long * (1 - t) + 1e-9
    return 2 * short >= t * (la + lb) - 1e-9


def title_ids(df: DataFrame, title: str) -> DataFrame:
    """Add ``low`` (lower title) and ``tid`` (its digest)."""
    return df.withColumn("low", F.lower(title)).withColumn("tid", F.md5("low"))


def _most_changes(la: Column, lb: Column, measure: str, t: float, q: int) -> Column:
    """By how many n-grams, counted with repeats on both sides, similar titles of these lengths can differ.

    A replaced character takes away at most q n-grams and brings q; one put in or left out, 2q - 1 in all.
    """
    if measure == "edit":
        return F.floor(F.greatest(la, lb) * (1 - t) + 1e-9) * (2 * q)
    return F.floor((la + lb) * (1 - t) + 1e-9) * (2 * q - 1)


def sketched(titles: DataFrame) -> DataFrame:
    """(tid, low, sketch): the sketch of a long title counts its n-grams in ``SKETCH`` buckets; short ones have none."""
    def rows(batches):
        for batch in batches:
            found = []
            lows = batch.column(1).to_pylist()
            long = [low is not None and len(low) > LONG for low in lows]
            for low in (x for x, held in zip(lows, long) if held):
                found.append(np.bincount((_hashes(_codes(low), SKETCH_GRAM, 0) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH))
            ends = np.r_[0, np.cumsum(np.array(long, np.int64) * SKETCH)]
            counts = pa.array(np.concatenate([np.empty(0, np.int64), *found]).astype(np.int32))
            sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), counts, mask=pa.array([not x for x in long], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sketch], ["tid", "low", "sketch"])

    return titles.select("tid", "low").mapInArrow(rows, "tid string, low string, sketch array<int>")


def _keeps(length, measure: str, t: float):
    """Most changes between a title and a similar one that is not shorter; each spoils at most one of its disjoint chunks."""
    share = (1 - t) / t if measure == "edit" else 2 * (1 - t) / t
    return np.floor(length * share + 1e-9).astype(np.int64) if isinstance(length, np.ndarray) else F.floor(length * share + 1e-9)


def _chunk_sizes(lengths: np.ndarray, measure: str, t: float, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters of a chunk and class of titles of these lengths; 0 characters if only equal titles are similar."""
    k = _keeps(lengths, measure, t)
    classes = np.floor(np.log(np.maximum(lengths, 1)) / math.log(WIDE)).astype(np.int64)
    return np.where(k > 0, np.minimum(q, lengths // (k + 1)), 0), classes


@lru_cache(maxsize=1 << 16)
def _met_by(length: int, measure: str, t: float, q: int) -> tuple[tuple[int, int], ...]:
    """(characters, class) of the chunks of all titles up to ``length`` that can be similar to one of it."""
    least = length * t if measure == "edit" else length * t / (2 - t)
    sizes, classes = _chunk_sizes(np.arange(max(1, math.ceil(least - 1e-6)), length + 1), measure, t, q)
    return tuple(sorted({(int(s), int(c)) for s, c in set(zip(sizes.tolist(), classes.tolist())) if s}))


def _codes(low: str) -> np.ndarray:
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray, q: int, kind: int) -> np.ndarray:
    """Hashes of all n-grams of ``q`` characters; ``kind`` tells those of unlike classes apart."""
    n = len(codes) - q + 1
    h = np.full(max(n, 0), (q * 0x9E3779B97F4A7C15 + (kind + 7) * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1, dtype=np.uint64)
    for i in range(q if n > 0 else 0):
        h = (h ^ codes[i : i + n]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _slices(lows: list[str]):
    """Titles of about ``BATCH`` characters at a time: (place of the first, their codes one after the other, their lengths)."""
    first, n = 0, 0
    for i, low in enumerate(lows):
        n += len(low)
        if n >= BATCH or i == len(lows) - 1:
            part = lows[first : i + 1]
            yield first, _codes("".join(part)), np.array([len(x) for x in part], np.int64)
            first, n = i + 1, 0


def _grams(codes: np.ndarray, lengths: np.ndarray, who: np.ndarray, size: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(title, place, hash) of all n-grams of ``size`` characters of the titles ``who``."""
    starts = np.cumsum(lengths) - lengths
    each = np.maximum(lengths[who] - size + 1, 0)
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    whose = np.repeat(who, each)
    # Only the stretches of these titles are hashed; n-grams across two titles are never asked for.
    mine = np.zeros(len(lengths), bool)
    mine[who] = True
    held = np.cumsum(np.where(mine, lengths, 0)) - np.where(mine, lengths, 0)
    all_of = _hashes(codes[np.repeat(mine, lengths)] if len(who) < len(lengths) else codes, size, kind)
    return whose, place, all_of[(held if len(who) < len(lengths) else starts)[whose] + place]


def _chosen(codes: np.ndarray, lengths: np.ndarray, counts: np.ndarray | None, measure: str, t: float, q: int):
    """Per (characters, class): (title, place, hash) of the chunks of the titles.

    With ``counts`` only the rarest of each title, one more than similar titles can spoil.
    """
    sizes, kinds = _chunk_sizes(lengths, measure, t, q)
    take = _keeps(lengths, measure, t) + 1
    for size, kind in sorted(set(zip(sizes[sizes > 0].tolist(), kinds[sizes > 0].tolist()))):
        whose, place, grams = _grams(codes, lengths, np.flatnonzero((sizes == size) & (kinds == kind)), size, kind)
        at = place % size == 0
        whose, place, grams = whose[at], place[at], grams[at]
        if counts is not None:
            order = np.lexsort((counts[(grams % np.uint64(BUCKETS)).astype(np.int64)], whose))
            new = np.r_[True, whose[order][1:] != whose[order][:-1]]
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            order = order[rank < take[whose[order]]]
            whose, place, grams = whose[order], place[order], grams[order]
        yield (size, kind), whose, place, grams


def _marks(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Four numbers of 64 bits per title whose unlike bits are never more than the characters that two titles do not share.

    Characters fall into 32 classes; eight bits count those of a class around a ring of 16, so one more changes one bit.
    """
    whose = np.repeat(np.arange(len(lengths)), lengths)
    n = np.bincount(whose * 32 + (codes % np.uint64(32)).astype(np.int64), minlength=32 * len(lengths)) % 16
    ring = np.array([(1 << i) - 1 if i <= 8 else 255 ^ (1 << i - 8) - 1 for i in range(16)], np.uint8)
    return ring[n].reshape(len(lengths), 32).view(np.int64)


def _chunk_counts(titles: DataFrame, measure: str, t: float, q: int) -> np.ndarray:
    """How many chunks of the titles fall into each of ``BUCKETS`` buckets.

    The order of chunks decides only how small the blocks are; the number of buckets is fixed, whatever the titles.
    """
    nothing = np.zeros(BUCKETS, np.int64)

    def count(batches):
        for batch in batches:
            n = nothing.copy()
            for _, codes, lengths in _slices(batch.column(0).to_pylist()):
                for _, _, _, grams in _chosen(codes, lengths, None, measure, t, q):
                    n += np.bincount((grams % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held], pa.int64())], ["bucket", "n"])

    out = titles.select("low").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = nothing.copy()
    counts[out.column("bucket").to_numpy()] = out.column("n").to_numpy()
    return counts


def _chunk_bitmap(titles: DataFrame, counts, measure: str, t: float, q: int) -> np.ndarray:
    """Bitmap of the chosen chunks of all titles, of a bounded size; a full one only leaves more rows to the shuffle."""
    n = int(counts.value.sum())
    words = min(max(1 << (max(n, 1) * 16 // 64).bit_length(), BITMAP[0]), BITMAP[1])

    def mark(batches):
        for batch in batches:
            found = [np.empty(0, np.uint64)]
            for _, codes, lengths in _slices(batch.column(0).to_pylist()):
                found += [grams for _, _, _, grams in _chosen(codes, lengths, counts.value, measure, t, q)]
            place = np.unique(np.concatenate(found) % np.uint64(words * 64)).astype(np.int64)
            word, first = np.unique(place >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), first) if len(place) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int32()), pa.array(bits.view(np.int64), pa.int64())], ["word", "bits"])

    held = titles.select("low").mapInArrow(mark, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(words, np.int64)
    bitmap[held.column("word").to_numpy()] = held.column("bits").to_numpy()
    return bitmap


def prefix_blocks(titles: DataFrame, measure: str, t: float = TITLE_THRESHOLD, q: int | None = None) -> DataFrame:
    """(blk, tid, len, home, lo, hi, m0 to m3, n) for distinct titles (tid, low): a title's place among the titles that hold a chunk.

    A block is a chunk and a class of lengths.  A title is at ``home`` in those of its own chunks and a guest in those of its
    other n-grams; two guests meet at home.  ``lo`` and ``hi`` are the first and last place of the n-gram in the title,
    ``m0`` to ``m3`` the marks of its characters, ``n`` the rows of the block.  Blocks without a pair are left out.
    """
    q = q or CHUNK[measure]
    titles = titles.filter("low is not null")
    context = titles.sparkSession.sparkContext
    counts = context.broadcast(_chunk_counts(titles, measure, t, q))
    bitmap = context.broadcast(_chunk_bitmap(titles, counts, measure, t, q))

    def places(codes: np.ndarray, lengths: np.ndarray):
        """(title, chunk, home, first place, last place) of the n-grams that are some title's chunk, by (characters, class)."""
        bits = bitmap.value.view(np.uint64)
        own = {key: (whose, place) for key, whose, place, _ in _chosen(codes, lengths, counts.value, measure, t, q)}
        meets: dict[tuple[int, int], list[int]] = {}
        for i, length in enumerate(lengths.tolist()):
            for key in _met_by(length, measure, t, q):
                meets.setdefault(key, []).append(i)
        for key, who in meets.items():
            whose, place, grams = _grams(codes, lengths, np.array(who), *key)
            home = np.zeros(len(grams), bool)
            if key in own:
                # All places of a title lie together, so a title and a place give the row.
                first = np.searchsorted(whose, own[key][0])
                home[first + own[key][1]] = True
            slot = grams % np.uint64(len(bits) * 64)
            kept = np.flatnonzero(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
            if not len(kept):
                continue
            kept = kept[np.lexsort((grams[kept], whose[kept]))]
            w, g, p = whose[kept], grams[kept], place[kept]
            new = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (g[1:] != g[:-1])])
            yield w[new], g[new], np.logical_or.reduceat(home[kept], new), p[new], p[np.r_[new[1:] - 1, len(p) - 1]]

    def rows(batches):
        names = ["blk", "tid", "len", "home", "lo", "hi", "m0", "m1", "m2", "m3"]
        for batch in batches:
            tids = batch.column(0)
            for first, codes, lengths in _slices(batch.column(1).to_pylist()):
                marks = _marks(codes, lengths)
                for who, blk, home, lo, hi in places(codes, lengths):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(blk.view(np.int64)), tids.take(pa.array(who + first)), pa.array(lengths[who], pa.int32()),
                        pa.array(home), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), *[pa.array(marks[who, i]) for i in range(4)],
                    ], names)

    found = titles.select("tid", "low").mapInArrow(
        rows, "blk bigint, tid string, len int, home boolean, lo int, hi int, m0 bigint, m1 bigint, m2 bigint, m3 bigint"
    )
    found = cut_lineage(found, "places")
    shared = found.groupBy("blk").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).filter("n > 1 and homes > 0")
    # The rows stay as they are written, a title's next to each other: dealt out by block they are several times as large.
    shared = cut_lineage(shared.select("blk", "n"), "shared")
    out = found.join(shared, "blk")
    out._rows, out._made_of = found.count(), (found, shared)
    return out


def slices(blocks: DataFrame) -> list[DataFrame]:
    """The rows of ``blocks`` in parts of about ``SLICE_ROWS``; a block is whole in one of them."""
    rows = blocks._rows if hasattr(blocks, "_rows") else blocks.count()
    n = 1 + rows // SLICE_ROWS
    return [blocks] if n == 1 else [blocks.filter(F.pmod(F.xxhash64("blk"), F.lit(n)) == i) for i in range(n)]


def _in_slices(blocks: DataFrame, step, names: tuple[str, ...]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Unions of the tables that ``step`` makes of each slice, and the written parts of them; a sole slice is not written."""
    parts = slices(blocks)
    if len(parts) == 1:
        return list(step(blocks)), []
    made = [[cut_lineage(df, name) for df, name in zip(step(part), names, strict=True)] for part in parts]
    return [reduce(DataFrame.unionByName, of) for of in zip(*made, strict=True)], [df for of in made for df in of]


def _side(blocks: DataFrame, end: str) -> DataFrame:
    """Columns of one side of the pairs of a block."""
    return blocks.select("blk", *[F.col(c).alias(f"{c}_{end}") for c in blocks.columns if c in ("tid", "len", "home", "lo", "hi", *MARKS, "n")])


def _may_be_similar(met: DataFrame, a: str, b: str, measure: str, t: float) -> DataFrame:
    """Those of the pairs that met in a block that homes, lengths, places and marks do not rule out."""
    col = lambda c, e: F.col(f"{c}_{e}")
    la, lb = col("len", a), col("len", b)
    shift = _keeps(F.least(la, lb), measure, t)
    near = (col("lo", a) <= col("hi", b) + shift) & (col("lo", b) <= col("hi", a) + shift)
    unlike = reduce(lambda x, y: x + y, [F.bit_count(col(m, a).bitwiseXOR(col(m, b))) for m in MARKS])
    met = met.filter(
        (col("home", a) | col("home", b)) & near & (col("tid", a) != col("tid", b)) & _length_ok(la, lb, measure, t)
        & (unlike <= _most_changes(la, lb, measure, t, 1))
    )
    return met.withColumn("long", F.least(la, lb) > LONG)


def _met(rows: DataFrame, lead: DataFrame, a: str, b: str, measure: str, t: float) -> DataFrame:
    """Pairs (tid_a, tid_b, long) of rows and leads that meet in a block and may be similar."""
    sides = ((rows, a), (lead, b))
    small, large = ([df.filter(F.col(f"n_{e}") <= HOT_BLOCK) for df, e in sides], [df.filter(F.col(f"n_{e}") > HOT_BLOCK) for df, e in sides])
    met = small[0].join(small[1], "blk")
    hot = keyed_lookup(*large, ["blk"], f"tid_{a}", how="inner", hot_rows=HOT_BLOCK)
    kept = (f"tid_{a}", f"tid_{b}", "long")
    return reduce(DataFrame.unionByName, [_may_be_similar(m, a, b, measure, t).select(*kept) for m in (met, hot)])


def _alike(pairs: DataFrame, titles: DataFrame, measure: str, t: float) -> DataFrame:
    """The pairs (tid_l, tid_x) of long titles that their sketches do not rule out."""
    sketch = titles.filter("sketch is not null").select("tid", F.char_length("low").alias("len"), "sketch")
    side = lambda e: sketch.select(*[F.col(c).alias(f"{c}_{e}") for c in sketch.columns])
    long = pairs.filter("long").join(side("l"), "tid_l").join(side("x"), "tid_x")
    apart = F.aggregate(F.zip_with("sketch_l", "sketch_x", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, d: s + d)
    return long.filter(apart <= _most_changes(F.col("len_l"), F.col("len_x"), measure, t, SKETCH_GRAM)).select("tid_l", "tid_x")


def _verify(pairs: DataFrame, titles: DataFrame, measure: str, t: float) -> DataFrame:
    """Keep the (tid_l, tid_x) whose similarity reaches ``t``, with it as score.

    ``pairs`` say whether both titles are ``long``; ``titles`` are ``sketched``.
    """
    pairs = cut_lineage(pairs, "met")
    la, lb = F.char_length("low_l"), F.char_length("low_x")
    longer = F.greatest(la, lb, F.lit(1))
    budget = F.floor((F.greatest(la, lb) if measure == "edit" else la + lb) * (1 - t) + 1e-9).cast("int")

    def texts(of: DataFrame, known: DataFrame) -> DataFrame:
        side = lambda e: known.select(F.col("tid").alias(f"tid_{e}"), F.col("low").alias(f"low_{e}"))
        return of.join(side("l"), "tid_l").join(side("x"), "tid_x")

    # The budget lets the distance stop early on pairs that are far apart.
    short = texts(pairs.filter(~F.col("long")).select("tid_l", "tid_x"), titles).withColumn("_d", F.call_function("levenshtein", F.col("low_l"), F.col("low_x"), budget)).filter("_d >= 0")
    long = texts(_alike(pairs, titles, measure, t), titles.filter("sketch is not null")).withColumn("_d", edit_distance(F.col("low_l"), F.col("low_x"))).filter(F.col("_d") <= budget)
    near = short.unionByName(long)
    scored = near.withColumn("score", 1 - F.col("_d") / longer if measure == "edit" else sequence_ratio("low_l", "low_x"))
    return scored.filter(F.col("score") >= t).select("tid_l", "tid_x", "score")


def expand_round(
    blocks: DataFrame, titles: DataFrame, order: DataFrame | None, measure: str, t: float = TITLE_THRESHOLD, pivots: int = PIVOTS
) -> tuple[DataFrame, DataFrame]:
    """One comparison round: the first ``pivots`` titles of each block against the whole block.

    ``titles`` are ``sketched``, ``order`` gives (tid, first_seq); without it titles come by tid.  Returns verified directed
    pairs and the blocks left once the pivots, whose comparisons are complete, are taken out.  Repeating until no
    block is left compares every pair that shares a block exactly when its first member
    is a pivot.  In a block of at most ``pivots`` titles every title is one, so only larger ones are ranked.  There the
    ``<= pivots`` filter is a window group limit, so each map task sends at most ``pivots`` rows per block.
    """
    w = Window.partitionBy("blk").orderBy("first_seq", "tid")

    def step(part: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs that meet in the blocks of a slice, and what is left of them."""
        seq = part.withColumn("first_seq", F.col("tid")) if order is None else part.join(order, "tid")
        small, large = seq.filter(F.col("n") <= pivots), seq.filter(F.col("n") > pivots)
        lead = large.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= pivots)
        each = _side(small, "o").join(_side(small, "p"), "blk").filter("tid_o < tid_p")
        found = (
            _may_be_similar(each, "o", "p", measure, t).select("tid_o", "tid_p", "long").unionByName(_met(_side(large, "o"), _side(lead, "p"), "o", "p", measure, t))
            .select(F.least("tid_o", "tid_p").alias("a"), F.greatest("tid_o", "tid_p").alias("b"), "long")
            .distinct()
        )
        return found, part.filter(F.col("n") > pivots).join(lead.select("blk", "tid"), ["blk", "tid"], "left_anti")

    (met, left), parts = _in_slices(blocks, step, ("met", "left"))
    if parts:
        met = met.distinct()
    if measure == "edit":
        one_way = _verify(met.select(F.col("a").alias("tid_l"), F.col("b").alias("tid_x"), "long"), titles, measure, t)
        pairs = one_way.unionByName(one_way.select(F.col("tid_x").alias("tid_l"), F.col("tid_l").alias("tid_x"), "score"))
    else:
        both = met.select(F.explode(F.array(
            F.struct(F.col("a").alias("tid_l"), F.col("b").alias("tid_x"), "long"),
            F.struct(F.col("b").alias("tid_l"), F.col("a").alias("tid_x"), "long"),
        )).alias("p")).select("p.*")
        pairs = _verify(both, titles, measure, t)
    # ``_verify`` has written the pairs that met; the caller writes what is left and drops it here.
    drop_spent(*parts[::2])
    left._spent = parts[1::2]
    return pairs, left


def similar_to(
    items: DataFrame, leaders: DataFrame, measure: str, t: float = TITLE_THRESHOLD, q: int | None = None, blocks: DataFrame | None = None,
    titles: DataFrame | None = None,
) -> DataFrame:
    """Verified (tid_l, tid_x, score) between two sets of distinct titles (tid, low).

    ``blocks`` are the prefix blocks and ``titles`` the ``sketched`` titles of a set that holds them all, if they are known already.
    """
    if titles is None:
        titles = cut_lineage(sketched(items.unionByName(leaders).distinct()), "titles")
    if blocks is None:
        blocks = prefix_blocks(titles, measure, t, q)

    def step(part: DataFrame) -> tuple[DataFrame]:
        x = part.join(items.select("tid"), "tid", "left_semi")
        lead = part.join(leaders.select("tid"), "tid", "left_semi")
        return (_met(_side(x, "x"), _side(lead, "l"), "x", "l", measure, t).select("tid_l", "tid_x", "long").distinct(),)

    (met,), parts = _in_slices(blocks, step, ("met",))
    if parts:
        met = met.distinct()
    same = items.select("tid").distinct().join(leaders.select("tid").distinct(), "tid").select(
        F.col("tid").alias("tid_l"), F.col("tid").alias("tid_x"), F.lit(1.0).alias("score")
    )
    found = _verify(met, titles, measure, t).unionByName(same)
    drop_spent(*parts)
    return found


def similar_pairs(titles: DataFrame, measure: str, t: float = TITLE_THRESHOLD, q: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """Verified (tid_l, tid_x, score) within one set of distinct titles (tid, low), in both directions and with itself.

    Blocks are compared with a few pivots per round, until no comparison is open.
    """
    titles = cut_lineage(sketched(titles), "titles")
    blocks = prefix_blocks(titles, measure, t, q)
    out = titles.select(F.col("tid").alias("tid_l"), F.col("tid").alias("tid_x"), F.lit(1.0).alias("score"))
    while not blocks.isEmpty():
        found, left = expand_round(blocks, titles, None, measure, t, pivots)
        out = out.unionByName(cut_lineage(found, "pairs"))
        blocks, spent = cut_lineage(left, "blocks"), blocks
        drop_spent(spent, *left._spent)
    return out.distinct()


def trigrams(c: Column) -> Column:
    """Distinct word trigrams of the lower text, words padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.char_length(w) + 1),
            lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(c: Column, query: str) -> Column:
    """Shared trigrams over all trigrams."""
    b = trigrams(F.lit(query))

    def share(a: Column) -> Column:
        union = F.size(F.array_union(a, b))
        return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)

    return bind(trigrams(c), share)
