import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import decontaminate
from newsloom.llm.fm_index import FMIndex


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=8))
def test_index_finds_all_occurrences(text, phrases):
    symbols = np.array([*text, 0])
    index = FMIndex(symbols, 5, sample=4)
    table = np.zeros((len(phrases), 5), np.int64)
    for i, p in enumerate(phrases):
        table[i, : len(p)] = p
    low, high = index.search(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high, strict=True):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            for i in range(max(1, len(b) - 9)) if b else ():
                p = b[i : i + 10]
                for j in range(len(w) - len(p) + 1):
                    if w[j : j + len(p)] == p:
                        hit.update(range(j, j + len(p)))
                        found.add(str(item))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_report_equals_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "short Item"), (10, None), (11, ""), (12, "!!"), (3, " ".join(f"W{i}" for i in range(5, 25)))]
    docs = [
        (1, long), (2, "x " + long.upper() + " y"), (3, "a short, item! SHORT item"), (4, None), (5, ""), (6, "nothing here at all"),
        (7, " ".join(f"w{i}" for i in range(9))), (8, " ".join(f"w{i}" for i in range(10))), (8, " ".join(f"w{i}" for i in range(10))),
        (9, ("z " * 50_000) + long), (None, "über\u00a0short item"), (11, "shortitem"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, marks int")
    for options in ({}, {"block_bytes": 40}, {"shard_bytes": 100}):
        got = decontaminate.mark_occurrences(frame.drop("marks"), benchmark, **options).collect()
        rows = [(r.doc_id, r.marks["words"], sum(s.end - s.start for s in r.marks.spans), r.marks["items"]) for r in got]
        assert sorted(rows, key=repr) == brute(docs, items)
    report = {r.doc_id: r for r in decontaminate.report(frame, benchmark).collect()}
    assert report[3].n_hit == 4 and report[3].contaminated and not report[11].contaminated
    clean = decontaminate.drop_contaminated(frame, benchmark)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {None, 4, 5, 6, 7, 11}


def test_items_with_null_ids_are_searched(spark):
    items = [(None, "first hidden passage"), (None, "second hidden passage"), (7, "named passage"), (None, None)]
    docs = [(1, "a first hidden passage b"), (2, "second hidden passage, named passage"), (3, "clean")]
    benchmark, frame = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for options in ({}, {"block_bytes": 20}):
        got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(frame, benchmark, **options).collect()}
        assert got == {1: (3, 1, True), 2: (5, 2, True), 3: (0, 0, False)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(frame, benchmark).collect()] == [3]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs, none).first().n_hit == 0
    assert decontaminate.report(docs.limit(0), none).count() == 0


def test_spans_are_merged():
    assert decontaminate.merged([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]
