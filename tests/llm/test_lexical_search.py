"""Aho-Corasick search against a brute-force ranking."""

import math
import random
import re
from collections import Counter

import pytest

from newsloom.llm import lexical_search

TERM = re.compile(lexical_search.TERM)


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    documents, length = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, mine in wanted.items():
        scored = []
        for (d, c), n in zip(counted, sizes):
            if not n:
                continue
            m = 50 + 50 * n * documents // length
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in mine if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if gone else d, -s) for k, (s, gone, d) in enumerate(sorted(scored)[:top])]
    return out


def order(row):
    return tuple((x is None, x) for x in row)


def check(spark, docs, items, top=lexical_search.TOP, **options):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, `n.x` int").repartition(5)
    b = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id string, text string, doc_id int")
    found = lexical_search.search(d, b, top, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=order) == sorted(plain(docs, items, top), key=order)
    return got


DOCS = [
    (0, None), (1, ""), (2, " .,!\n"), (3, "Apple pie"), (4, "apple-pie, APPLE"), (4, "apple-pie, APPLE"), (5, "pineapple apples"), (6, "é É naïve café"),
    (7, "don't won't"), (8, "a a a a b"), (None, "apple"), (None, "apple tart"), (9, "x1 1x 11 x"), (10, "日本 日本 語"), (11, "tab\tapple\x00pie\x7f"),
]
ITEMS = [("i1", "apple pie"), ("i2", "Apple apple"), ("i2", "pie"), ("i3", None), ("i4", "..."), (None, "café"), (None, "1x a"), ("i5", "日本"), ("i6", "absent"), ("i7", "t don won É b x")]


@pytest.mark.parametrize("top", [1, 2, 50])
def test_equals_brute_force(spark, top):
    got = check(spark, DOCS, ITEMS, top)
    assert all(score > 0 for *_, score in got)


def test_blocks_of_items_and_long_texts(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.6)) % 700}" for _ in range(3000)]
    docs = [(i % 150, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randrange(0, 200)))) for i in range(300)]
    docs += [(500, " ".join(rng.choices(words, k=300_000))), (501, "w1" * 100_000)]
    items = [(f"q{i % 40}", " ".join(rng.choices(words, k=12))) for i in range(60)]
    check(spark, docs, items, block_bytes=200)


def test_slices_count_each_term_once(monkeypatch):
    text = b"one two  three,four one-one twoone " * 50
    automaton = lexical_search.Automaton([("i", t) for t in ("one", "two", "three", "four", "absent")])
    whole = automaton.frequencies(text)
    for size in (1, 2, 3, 7, 40):
        monkeypatch.setattr(lexical_search, "SLICE", size)
        assert automaton.frequencies(text) == whole
    assert whole[0] == 350 and {automaton.terms[k]: n for k, n in whole[1].items()} == {"one": 150, "two": 50, "three": 50, "four": 50}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("a", "b")], "item_id string, text string")
    assert lexical_search.search(none, items).collect() == []
    docs = spark.createDataFrame([(1, "b")], "doc_id long, text string")
    assert lexical_search.search(docs, items.limit(0)).collect() == []
    assert lexical_search.search(docs.filter("false"), items.limit(0)).collect() == []
