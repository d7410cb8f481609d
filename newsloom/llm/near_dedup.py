"""MinHash near-deduplication with tensored banding.

Every distinct shingle set is a node. ``COLLECTIONS`` small collections of ``PER_COLLECTION`` minhashes are
computed once; each pair of collections forms the key of one table, so 24 minhashes give 66 tables of
four-minhash keys. Two sets share a key as soon as two collections agree: at a similarity of 0.8 a pair is
missed with probability 1e-4, at 0.9 with 1e-7.

Candidates are confirmed on the full shingle sets. Within a bucket no pair list is built: members are compared
with a few pivots per round, links are contracted to components, and only buckets that still hold more than
one component go on, without the pivots already compared with all. Rounds end when no bucket is open, so no
candidate is capped. A bucket that stays open with many members holds texts that share a passage but are
unlike otherwise; its members are dealt anew by their rarest shingles (the prefix that every linked pair must
share), which parts them exactly: a shingle's rank in a set bounds the size of the sets that can still be
linked through it, and pivots are those with the widest bound, the texts with the fewest shingles of their own.

Each bucket's keys cross the network twice, as three numbers. Texts never do: the full sets of the nodes that share
a bucket are cut where their texts lie (a bit map of a fixed size tells most other rows apart), and stored by node, so
that a round moves the sets of its own pairs only.

Defined results: A-Z are lower-cased and words are runs without ASCII white space; fewer words than a shingle
form one shingle; a text without words (or null) has no shingle and is linked with nothing. Sets are told
apart by a 128-bit digest of their 64-bit shingle hashes. Repeated rows share their class; a class of null ids
has a null component. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, bytes_of, fresh, text_chunks
from newsloom.llm.exact_dedup import as_files, locator
from newsloom.skew import keyed_lookup

WORDS, COLLECTIONS, PER_COLLECTION = 4, 12, 2
SHARED, UNION = 100, 80  # linked if SHARED * intersection >= UNION * union
PIVOTS, LARGE = 48, 48
#: Bytes of text that are hashed at once, bits of the map of wanted rows, nodes in a stored part of the sets.
SLICE, MAP_BITS, PART_NODES = 1 << 20, 1 << 27, 20_000
#: Rows of one set above which they are spread over several tasks.
HOT_ROWS = 100_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)[_FOLDED]
_BASE, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MULTIPLIERS = _RANDOM.integers(1, 1 << 63, COLLECTIONS * PER_COLLECTION, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RANDOM.integers(1, 1 << 63, COLLECTIONS * PER_COLLECTION, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of every row, and the number of words per row.

    A word's hash is a polynomial of its bytes, taken from prefix sums and shifted back to the first power.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = solid & np.concatenate([[True], ~solid[:-1] | edge[1:-1]])
    last = solid & np.concatenate([~solid[1:] | edge[1:-1], [True]])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers = np.cumprod(np.full(len(data), _BASE))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers)])
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), _INVERSE)]))
    hashes = _mixed((prefix[ends] - prefix[starts]) * back[starts])
    return hashes, np.diff(np.searchsorted(starts, off))


def sliced_word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` in slices that end before white space, if there is one long row."""
    if len(off) != 2 or len(data) <= 2 * SLICE:
        return word_hashes(data, off)
    found, at = [], 0
    while at < len(data):
        stop = at + SLICE
        while stop < len(data) and not _SPACE[data[stop]]:
            ahead = np.flatnonzero(_SPACE[data[stop : stop + SLICE]])
            stop += int(ahead[0]) if len(ahead) else SLICE
        part = data[at:stop]
        found.append(word_hashes(part, np.array([0, len(part)]))[0])
        at += len(part)
    words = np.concatenate(found)
    return words, np.array([len(words)])


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of every row's shingles of ``size`` words."""
    words, counts = sliced_word_hashes(data, off)
    if len(words) >= size:
        grams = words[: len(words) - size + 1]
        for k in range(1, size):
            grams = grams * _BASE + words[k : len(words) - size + 1 + k]
        grams = _mixed(grams)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(grams[at : at + n - size + 1]))
        elif n:
            whole = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[at : at + n]:
                    whole = whole * _MIX1 + w
            out.append(_mixed(np.array([whole])))
        else:
            out.append(words[:0])
        at += n
    return out


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def collections_of(sets: list[np.ndarray]) -> np.ndarray:
    """One row per non-empty set: its collections, each two 32-bit minhashes in a 64-bit number."""
    joined, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.zeros((len(sets), COLLECTIONS), np.uint64)
    for k in range(COLLECTIONS * PER_COLLECTION):
        least = np.minimum.reduceat((joined * _MULTIPLIERS[k] + _ADDENDS[k]) >> np.uint64(32), starts)
        out[:, k // PER_COLLECTION] = out[:, k // PER_COLLECTION] << np.uint64(32) | least
    return out.view(np.int64)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text", SLICE):
            sets = shingle_sets(*bytes_of(chunk.column("text")), size)
            full = [s for s in sets if len(s)]
            signatures = iter(collections_of(full).tolist() if full else [])
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), "place": chunk.column("place"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary()),
                "signature": pa.array([next(signatures) if len(s) else None for s in sets], pa.list_(pa.int64())),
            })

    return run


def _full_sets(size: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("at").to_numpy() % (64 * len(bits))
            wanted = pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))
            for chunk in text_chunks(iter([batch.filter(wanted)]), "text", SLICE):
                sets = [s.view(np.int64) for s in shingle_sets(*bytes_of(chunk.column("text")), size)]
                yield pa.RecordBatch.from_pydict({"place": chunk.column("place"), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    return run


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Words of a map with the bit of each hash (``at``) set; its size follows the rows up to ``MAP_BITS``."""
    size = 1 << 16
    rows = hashes.count()
    while size < MAP_BITS and size < 16 * rows:
        size *= 2
    place = F.pmod("at", F.lit(size))
    words = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("bits"))
    found = words.toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def sorted_side(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join, whatever size Spark expects.

    It counts an exploded row once, however many rows come of it, and a column of places by its packed size on disk; a
    broadcast on such a guess may be a hundred times as large as it allows, and is built by the driver.
    """
    return df.hint("merge")


def table_keys() -> Column:
    """Keys of all tables: each pair of collections, with the table's number."""
    pairs = combinations(range(COLLECTIONS), 2)
    return F.array(*[F.xxhash64(F.lit(t), F.col("signature")[i], F.col("signature")[j]) for t, (i, j) in enumerate(pairs)])


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): ``nodes`` (node, comp) after joining the components that ``links`` (a, b: comps) connect.

    Every component takes its smallest neighbour if that is smaller, chains are halved until flat, and the
    links are contracted, until none is left.
    """
    links, own = scratch.cut(links, "links"), None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).filter("p < a")
        parent, contracted = scratch.cut(parent, "parent"), links
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = scratch.cut(parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "parent")
            scratch.drop(parent)
            parent = jumped
            if jumped.filter("moved").isEmpty():
                break
        parent = parent.drop("moved")
        to = parent.select(F.col("a").alias("comp"), "p")
        nodes, spent = scratch.cut(nodes.join(to, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "nodes"), own
        own = nodes
        a = links.join(parent, "a", "left").select(F.coalesce("p", "a").alias("a"), "b")
        b = a.join(parent.select(F.col("a").alias("b"), "p"), "b", "left").select("a", F.coalesce("p", "b").alias("b"))
        links = scratch.cut(b.filter("a <> b").distinct(), "links")
        scratch.drop(contracted, jumped, *([spent] if spent is not None else []))
    scratch.drop(links)
    return nodes


def _alike(n: Column, m: Column) -> Column:
    """Sizes that allow a link."""
    return SHARED * F.least(n, m) >= UNION * F.greatest(n, m)


def rare_prefixes(sets: DataFrame) -> DataFrame:
    """(key, node, n_shingles, reach): the shingles of each set's prefix, rarest first, that another set has too.

    If the first shingle that two sets share has rank r in one of size n, they share n - r + 1 at most, and a link
    needs UNION / (SHARED + UNION) of both sizes together: ``reach`` is the largest size of the other set.
    A link needs UNION / SHARED of either set, hence a reach of at least that share of the own size.
    """
    each = sets.select("node", F.size("shingles").alias("n_shingles"), F.explode("shingles").alias("key"))
    spread = each.groupBy("key").agg(F.count(F.lit(1)).alias("sets"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("sets", "key"))
    reach = F.floor((F.col("n_shingles") - rank + 1) * (SHARED + UNION) / UNION + 1e-9) - F.col("n_shingles")
    ranked = each.join(sorted_side(spread), "key").withColumn("reach", reach)
    return ranked.filter((SHARED * F.col("reach") >= UNION * F.col("n_shingles")) & (F.col("sets") > 1)).select("key", "node", "n_shingles", "reach")


def _open(members: DataFrame) -> DataFrame:
    """Members (key, node, n_shingles, reach, comp) that can still link with another component of their bucket.

    Such a member reaches the least size of the other components, and one of them reaches its size.  One of a
    pair is the smaller set, which reaches its own size; pivots are such members.
    """
    parts = members.groupBy("key", "comp").agg(F.min("n_shingles").alias("least"), F.max("reach").alias("widest"))
    first = parts.groupBy("key").agg(F.min(F.struct("least", "comp")).alias("l"), F.max(F.struct("widest", "comp")).alias("w"))
    bounds = parts.join(first, "key").groupBy("key").agg(
        F.first("l").alias("l"), F.first("w").alias("w"), F.min(F.when(F.col("comp") != F.col("l.comp"), F.col("least"))).alias("l2"),
        F.max(F.when(F.col("comp") != F.col("w.comp"), F.col("widest"))).alias("w2"),
    )
    least = F.when(F.col("comp") == F.col("l.comp"), F.col("l2")).otherwise(F.col("l.least"))
    widest = F.when(F.col("comp") == F.col("w.comp"), F.col("w2")).otherwise(F.col("w.widest"))
    able = members.join(bounds.filter("l2 is not null"), "key").filter((F.col("reach") >= least) & (F.col("n_shingles") <= widest))
    able = able.select("key", "node", "n_shingles", "reach", "comp")
    going = able.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max((F.col("reach") >= F.col("n_shingles")).cast("int")).alias("pivots"))
    return able.join(going.filter("low < high and pivots = 1").select("key"), "key")


def link_nodes(nodes: DataFrame, sets_of, scratch: Scratch) -> DataFrame:
    """(node, comp) of every node that shares a bucket; ``nodes`` has node, n_shingles, signature.

    ``sets_of(ids)`` gives (node, shingles) of the nodes in ``ids``, stored by node.
    """
    keys = nodes.select("node", F.explode(table_keys()).alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot")).filter("size > 1")
    members = scratch.cut(keys.join(sorted_side(buckets.select("key", "pivot")), "key"), "members")
    ids = members.select("node").distinct()
    sizes = scratch.cut(nodes.select("node", "n_shingles").join(ids, "node"), "sizes")
    comps = scratch.cut(sizes.select("node", F.col("node").alias("comp")), "comps")
    sets = sets_of(sizes.select("node"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Components after linking the pairs (a, b) that the full sets confirm."""
        sized = pairs.distinct().join(sizes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n")), "a")
        sized = sized.join(sizes.select(F.col("node").alias("b"), F.col("n_shingles").alias("m")), "b")
        checked = scratch.cut(sized.filter(_alike(F.col("n"), F.col("m"))), "pairs")
        shared = F.size(F.array_intersect("sa", "sb"))
        sure = (
            checked.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
            .filter(SHARED * shared >= UNION * (F.col("n") + F.col("m") - shared)).select("a", "b")
        )
        of = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        links = sure.join(of[0], "a").join(of[1], "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        out = components(comps, links, scratch)
        scratch.drop(checked, *([comps] if out is not comps else []))
        return out

    comps = linked(members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    any_size = F.lit(2**31 - 1).cast("long").alias("reach")
    pivot, spent = F.col("pivot.node"), members
    members = members.filter("node <> pivot").select("key", "node").join(comps, "node").join(sizes, "node").select("key", "node", "n_shingles", any_size, "comp")
    opened = members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size"))
    opened = scratch.cut(opened.filter("low < high").select("key", "size"), "open")
    large = members.join(opened.filter(F.col("size") > LARGE), "key", "left_semi").select("node").distinct()
    small = members.join(opened.filter(F.col("size") <= LARGE), "key", "left_semi").drop("comp")
    members = scratch.cut(rare_prefixes(sets.join(large, "node", "left_semi")).unionByName(small), "members")
    scratch.drop(opened, spent)
    while True:
        members, spent = scratch.cut(_open(members.join(comps, "node")).select("key", "node", "n_shingles", "reach", "comp"), "members"), members
        scratch.drop(spent)
        if members.isEmpty():
            scratch.drop(members, sizes, sets)
            return comps
        slot = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
        best = F.min(F.struct((-F.col("reach")).alias("order"), "node", "n_shingles", "reach", "comp")).alias("pivot")
        pivots = scratch.cut(members.filter("reach >= n_shingles").groupBy("key", slot.alias("slot")).agg(best).select("key", "pivot"), "pivots")
        pairs = members.join(pivots, "key").filter("comp <> pivot.comp and n_shingles <= pivot.reach and pivot.n_shingles <= reach").select(
            F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")
        )
        comps = linked(pairs)
        rest = scratch.cut(members.join(pivots.select("key", pivot.alias("node")), ["key", "node"], "left_anti").drop("comp"), "rest")
        scratch.drop(members, pivots)
        members = rest


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, place, n_shingles, component_id, kept, comp; shingles have ``words`` words.

    ``comp`` tells components apart, also those whose ids are equal or null; it is null without shingles.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    docs = as_files(docs.select("doc_id", "text"), scratch)
    placed = docs.select("doc_id", F.col("text").cast("binary").alias("text"), locator(docs).alias("place"))
    ddl = "doc_id bigint, place struct<file: string, row: bigint>, n_shingles bigint, digest binary, signature array<bigint>"
    rows = scratch.cut(placed.select(F.col("doc_id").cast("long"), "text", "place").mapInArrow(_sketch(words), ddl), "sketch")
    nodes = rows.filter("digest is not null").groupBy("digest").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.min("doc_id").alias("least"), F.min("place").alias("place"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    nodes = scratch.cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def sets_of(ids: DataFrame) -> DataFrame:
        spark = docs.sparkSession
        wanted = scratch.cut(nodes.join(ids, "node").select("node", "place"), "wanted")
        at = F.pmod(F.xxhash64("place"), F.lit(1 << 62)).alias("at")
        shared = spark.sparkContext.broadcast(bit_map(wanted.select(at)))
        found = placed.select("text", "place", at).mapInArrow(_full_sets(words, shared), "place struct<file: string, row: bigint>, shingles array<bigint>")
        parts = 1 + wanted.count() // PART_NODES
        out = scratch.cut_buckets(found.join(sorted_side(wanted), "place").select("node", "shingles"), "sets", "node", parts)
        shared.destroy()
        scratch.drop(wanted)
        return out

    comps = link_nodes(nodes.select("node", "n_shingles", "signature"), sets_of, scratch)
    linked = nodes.select("digest", "node", "least", "n_rows").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = linked.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = scratch.cut(linked.join(least, "comp").select("digest", "comp", "component_id", "n_rows"), "classes")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    columns = ["doc_id", "place", "n_shingles", "component_id", kept.alias("kept"), "comp"]
    bare = rows.filter("digest is null").withColumns({"component_id": F.col("doc_id"), "comp": F.lit(None).cast("long")})
    full = rows.filter("digest is not null").select("doc_id", "place", "n_shingles", "digest")
    found = keyed_lookup(full, ids, ["digest"], "place", weight="n_rows", how="inner", hot_rows=HOT_ROWS)
    return found.select(*columns).unionByName(bare.select(*columns))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates, columns unchanged."""
    scratch = Scratch(docs.sparkSession, "near-drop")
    docs = as_files(docs, scratch)
    columns, place = [F.col(f"`{c}`") for c in docs.columns], fresh(docs, "place")
    found = scratch.cut(near_duplicates(docs, words), "found")
    # Rows of one id and component: the first place stays. Ids do not tell components apart: they may be null or repeated.
    first = found.filter("kept and n_shingles > 0").groupBy("comp").agg(F.min("place").alias("place"))
    gone = found.filter("n_shingles > 0").join(sorted_side(first), "place", "left_anti").select(F.col("place").alias(place))
    return docs.select(*columns, locator(docs).alias(place)).join(sorted_side(gone), place, "left_anti").select(*columns)
