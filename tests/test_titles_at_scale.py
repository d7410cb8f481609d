"""Titles: blocks hold only titles that can meet, and long titles cost no table of all character pairs."""

import random
from collections import Counter
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsloom.operators import dedup, similarity
from newsloom.session import checkpoint_root


def titles(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return similarity.title_ids(df, "t").select("tid", "low")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_of_long_texts_is_the_edit_distance():
    draw = random.Random(5)
    for _ in range(500):
        a, b = ("".join(draw.choices("abé ", k=draw.randrange(15))) for _ in range(2))
        assert similarity._distance(a, b) == levenshtein(a, b)


@pytest.mark.parametrize("measure", ["edit", "sequence"])
def test_blocks_leave_out_titles_that_meet_none(spark, measure):
    texts = ["alpha beta gamma delta one", "alpha beta gamma delta two", "alpha beta gamma " * 9, "zzz qqq xxx"]
    df = titles(spark, texts)
    blocks = similarity.prefix_blocks(df, measure)
    met = {r.low for r in df.join(blocks.select("tid").distinct(), "tid").collect()}
    assert met == set(texts[:2])  # the third title shares n-grams, but no length


def test_pairs_of_short_and_long_titles_are_those_of_all_comparisons(spark):
    draw = random.Random(7)
    words = ["thing", "of", "retion", "and", "queue", "é", "the"]
    texts = []
    for size in (3, 12, 40, 55, 61, 70, 120):
        for _ in range(4):
            base = [draw.choice(words) for _ in range(size)]
            texts += [" ".join(base), " ".join(base[:-1] + ["x"]), " ".join(base[: size // 2] + base[size // 2 + 1 + size // 15 :])]
    texts = sorted(set(texts))
    df = titles(spark, texts)
    names = {r.tid: r.low for r in df.collect()}
    score = lambda a, b: 1 - similarity._distance(a, b) / max(len(a), len(b), 1)  # checked above
    want = {(a, b): score(a, b) for a in texts for b in texts if score(a, b) >= similarity.TITLE_THRESHOLD}
    got = {(names[r.tid_l], names[r.tid_x]): r.score for r in similarity.similar_pairs(df, "edit", pivots=16).collect()}
    assert set(got) == set(want)
    assert all(abs(s - want[k]) < 1e-12 for k, s in got.items())


def test_unlike_long_titles_are_ruled_out_by_their_sketches(spark):
    draw = random.Random(3)
    own = [["".join(draw.choices("abcdefghij", k=5)) for _ in range(6)] for _ in range(8)]
    texts = [" ".join(draw.choices(words, k=400)) for words in own]
    df = similarity.sketched(titles(spark, texts + [texts[0] + "x"]))
    left, right = (df.select(F.col("tid").alias(c)) for c in ("tid_l", "tid_x"))
    pairs = left.join(right, F.col("tid_l") < F.col("tid_x")).withColumn("long", F.lit(True))
    assert similarity._alike(pairs, df, "edit", similarity.TITLE_THRESHOLD).count() == 1


def test_blocks_hold_few_rows_of_unlike_titles_that_share_words(spark):
    draw = random.Random(11)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(draw.choices(words, k=15)) for _ in range(300)]
    blocks = similarity.prefix_blocks(titles(spark, texts), "edit")
    assert blocks.count() < 25 * len(texts)


@pytest.mark.parametrize("measure", ["edit", "sequence"])
def test_changed_titles_share_a_block_at_every_length(spark, measure):
    draw = random.Random(13)
    t, pairs = similarity.TITLE_THRESHOLD, []
    for length in [*range(6, 61), 90, 257, 400]:
        for _ in range(4):
            a = "".join(draw.choices("abcdé ", k=length))
            k = int(length * (1 - t) / t + 1e-9) if measure == "edit" else int(length * 2 * (1 - t) / t + 1e-9)
            b = list(a)
            for at in sorted(draw.sample(range(length), k), reverse=True):
                b.insert(at, draw.choice("xyz"))
            pairs.append((a, "".join(b)))
    pairs = [(a, b) for a, b in pairs if a != b]
    df = titles(spark, sorted({x for p in pairs for x in p}))
    names = {r.tid: r.low for r in df.collect()}
    blocks = similarity.prefix_blocks(df, measure)
    met = similarity._met(similarity._side(blocks, "o"), similarity._side(blocks, "p"), "o", "p", measure, t)
    got = {frozenset((names[r.tid_o], names[r.tid_p])) for r in met.select("tid_o", "tid_p").distinct().collect()}
    assert not [p for p in pairs if frozenset(p) not in got]


@pytest.mark.parametrize("measure", ["edit", "sequence"])
def test_null_and_empty_titles_are_like_themselves_only(spark, measure):
    df = similarity.title_ids(spark.createDataFrame([(None,), ("",), ("a",), ("alpha beta gamma delta one",), ("alpha beta gamma delta seven more",)], "t string"), "t").select("tid", "low")
    pairs = similarity.similar_pairs(df, measure).join(df.withColumnsRenamed({"tid": "tid_l", "low": "a"}), "tid_l").join(df.withColumnsRenamed({"tid": "tid_x", "low": "b"}), "tid_x")
    assert {(r.a, r.b) for r in pairs.collect()} == {(x, x) for x in ("", "a", "alpha beta gamma delta one", "alpha beta gamma delta seven more")}
    assert similarity.sketched(df).filter("low is null and sketch is null").count() == 1


def test_marks_differ_in_no_more_bits_than_characters_not_shared():
    draw = random.Random(17)
    texts = ["", "a", "\U0001f600a"] + ["".join(draw.choices("abcdefghi é\U0001f600", k=draw.randrange(120))) for _ in range(60)]
    marks = [m for _, codes, lengths in similarity._slices(texts) for m in similarity._marks(codes, lengths)]
    bits = lambda a, b: sum(bin(int(x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(a, b))
    unshared = lambda a, b: sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values())
    assert all(bits(marks[i], marks[j]) <= unshared(a, b) for i, a in enumerate(texts) for j, b in enumerate(texts))
    assert bits(marks[0], marks[1]) == 1


@pytest.mark.parametrize("measure", ["edit", "sequence"])
def test_titles_that_share_a_passage_but_not_their_characters_do_not_meet(spark, measure):
    draw = random.Random(19)
    texts = ["breaking news of today " + "".join(draw.choices(own, k=35)) for own in ("abc", "def", "ghi", "jkl", "mno", "pqr") for _ in range(2)]
    texts.append(texts[0][:-1] + "z")
    df = titles(spark, texts)
    names = {r.tid: r.low for r in df.collect()}
    blocks = similarity.prefix_blocks(df, measure)
    met = similarity._met(similarity._side(blocks, "l"), similarity._side(blocks, "x"), "l", "x", measure, similarity.TITLE_THRESHOLD).distinct().collect()
    assert blocks.groupBy("blk").count().filter("count = 13").count() > 0
    # Titles whose ends are of the same three characters may pass, others may not.
    own = lambda tid: set("abc def ghi jkl mno pqr".split()[(ord(names[tid][23]) - ord("a")) // 3])
    assert all(own(r.tid_l) == own(r.tid_x) for r in met)
    assert {(texts[0], texts[-1]), (texts[-1], texts[0])} <= {(names[r.tid_l], names[r.tid_x]) for r in met}


def test_the_cascade_sketches_its_titles_once(spark, monkeypatch):
    calls, sketched = [], similarity.sketched
    monkeypatch.setattr(similarity, "sketched", lambda df: calls.append(1) or sketched(df))
    at = datetime(2025, 1, 1, tzinfo=timezone.utc)
    rows = [(i, f"u{i}", f"h{i}", f"e{i}", t, at, True) for i, t in enumerate(["a title of some length", "another one", None, "a title of some length!"])]
    schema = "arrival_seq bigint, url_key string, hash_key string, event_key string, title string, published_at timestamp, eligible boolean"
    out = dedup.ingest_cascade(spark.createDataFrame(rows, schema), at, "edit")
    assert {r.arrival_seq: (r.outcome, r.leader_seq) for r in out.collect()} == {0: ("new", None), 1: ("new", None), 2: ("new", None), 3: ("duplicate", 0)}
    assert len(calls) == 1


def test_a_cascade_in_slices_decides_alike_and_leaves_no_blocks_on_disk(spark, monkeypatch):
    at = datetime(2025, 3, 1, tzinfo=timezone.utc)
    near = ["ministry opens tender for coastal rail link number " + x for x in ("1", "2", "3", "4", "5")]
    texts = [near[0], "port authority signs agreement with builder", near[1], near[2], "port authority signs agreement with builders", near[3], near[4]]
    rows = [(i, f"u{i}", f"h{i}", f"e{i}", t, at, True) for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "arrival_seq bigint, url_key string, hash_key string, event_key string, title string, published_at timestamp, eligible boolean")
    root = Path(checkpoint_root(spark).removeprefix("file:")) / "newsloom"
    setting, during, cut, parts, sliced = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], dedup.cut_lineage, [], similarity.slices
    monkeypatch.setattr(dedup, "cut_lineage", lambda *a: (during.append(spark.conf.get(setting, None)), cut(*a))[1])
    monkeypatch.setattr(similarity, "slices", lambda blocks: parts.append(sliced(blocks)) or parts[-1])
    monkeypatch.setattr(similarity, "SLICE_ROWS", 30)
    before = set(root.iterdir()) if root.exists() else set()
    out = dedup.ingest_cascade(items, at, "sequence", pivots=2)
    got = {r.arrival_seq: (r.outcome, r.leader_seq) for r in out.collect()}
    assert got == {0: ("new", None), 1: ("new", None), 4: ("duplicate", 1)} | {i: ("duplicate", 0) for i in (2, 3, 5, 6)}
    assert len(parts[0]) > 1 and set(during) == {"true"} and spark.conf.get(setting, None) is None
    left = Counter(p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before)
    assert not {"places", "shared", "left", "components", "settled"} & set(left) and left["blocks"] <= 1 and left["undecided"] <= 2, left
