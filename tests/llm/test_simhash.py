"""SimHash fingerprints and their links against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from newsloom.llm import simhash
from newsloom.llm.common import Scratch


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Component of every row (doc_id, fingerprint)."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    arr = np.array(fps, np.uint64)
    for f in fps:
        for g in arr[np.bitwise_count(arr ^ np.uint64(f)) <= 2].tolist():
            parent[root(f)] = root(g)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return [(d, f"{f:016x}", least.get(root(f))) for d, f in rows]


def key(row):
    return tuple((x is None, x) for x in row)


def check(spark, rows, **columns):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, `a.b` int").repartition(3)
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    want = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def test_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one two"), (5, "ONE  two"), (None, "null id"), (6, "É É É É"), (7, "é é é é")]
    for d in range(10, 60):
        text = rng.choices(words, k=rng.randrange(3, 300))
        rows += [(d, " ".join(text)), (d, " ".join(text)), (d + 1000, "\n".join(text).upper()), (d + 2000, " ".join(text[:-1])), (d + 3000, " ".join([*text, "more"]))]
    got = check(spark, rows)
    assert len({c for *_, c in got}) < len({f for _, f, _ in got})


def test_empty_table_and_long_text(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rng = random.Random(2)
    long = " ".join(rng.choices([f"w{i}" for i in range(50)], k=600_000))
    check(spark, [(1, long), (2, long + " end"), (3, "x" * 3_000_000)])


def test_sliced_texts_give_the_same_shingles(monkeypatch):
    text = (" ".join(f"w{i % 91}" for i in range(5000))).encode()
    whole = [h for part in simhash.shingle_hashes(text) for h in part]
    monkeypatch.setattr(simhash, "SLICE", 100)
    assert [h for part in simhash.shingle_hashes(text) for h in part] == whole
    assert simhash.fingerprints_of([text, b"", text])[[0, 2]].tolist() == [plain_fingerprint(text.decode())] * 2


def test_sums_see_one_block():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    for width in (4, 8, 16):
        for block in range(64 // width):
            mask = np.uint64(((1 << width) - 1) << (block * width))
            one, other = (simhash.block_sums(simhash.distance_table(x), width)[:, block] for x in (fp, fp ^ (rng.integers(0, 1 << 63, 50, dtype=np.uint64) & ~mask)))
            assert (one == other).all()
            changed = simhash.block_sums(simhash.distance_table(fp ^ np.uint64(1 << (block * width))), width)[:, block]
            assert (changed != one).any(axis=1).all()


def test_largest_difference_leaves_at_most_four_bits():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    flips = np.zeros_like(a)
    for _ in range(9):
        flips ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64) * (rng.random(len(a)) < 0.5)
    apart = np.abs(simhash.distance_table(a).astype(int) - simhash.distance_table(a ^ flips)).max(axis=1)
    bits = np.bitwise_count(flips)
    assert (apart[bits <= 2] <= 2).all() and (apart[bits > 4] > 2).all()


@pytest.mark.parametrize("limit", [2, 40])
def test_crowded_cells_are_dealt_again(spark, monkeypatch, limit):
    """3,000 fingerprints within 14 bits, and some that are spread: all links, whatever size a cell may have."""
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rng = np.random.default_rng(6)
    crowd = sum((rng.integers(0, 2, 3000, dtype=np.uint64) << np.uint64(b)) for b in (0, 3, 7, 12, 17, 18, 25, 30, 33, 40, 47, 50, 55, 63))
    spread = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([crowd, spread, spread ^ np.uint64(5)])).view(np.int64)
    nodes = spark.createDataFrame([(int(f),) for f in fps], "fp long").repartition(4)
    got = {(r["a"], r["b"]) for r in simhash.link_fingerprints(nodes, Scratch(spark, "test")).collect()}
    want = {(min(f, g), max(f, g)) for f in fps.tolist() for g in fps[np.bitwise_count((fps ^ f).view(np.uint64)) <= 2].tolist() if f != g}
    assert got == want and len(want) > 10_000
