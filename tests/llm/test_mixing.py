import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.llm import mixing


def corpus():
    rows = [(i, "w " * (1 + (i * 7) % 60), f"s{i % 5}") for i in range(400)]
    rows += [(1000 + i, "same text of five words", "s1") for i in range(2500)]  # more than are ranked together
    rows += [(5000, None, "s0"), (5001, "", None), (5002, "a b", None), (5003, "x" * 50_000, "s2"), (5004, "big " * 3000, "s3"), (5004, "big " * 3000, "s3")]
    return [*rows, (5005, None, "empty"), (None, "no id here", "s4"), (5006, "tiny", "\U00010000"), (5007, "tiny two", "￿")]


def goals(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        rest, free = total - sum(3 * size[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * rest > 3 * size[s] * free}
        if not over:
            return size, {s: 3 * size[s] if s in capped else weight[s] * rest / free for s in order}
        capped |= over


@pytest.fixture(scope="module")
def mixed(spark):
    docs = spark.createDataFrame([(*r, 1) for r in corpus()], "doc_id long, text string, source string, size int")
    return docs, mixing.mix(docs).collect()


def test_sizes_and_targets_equal_brute_force(mixed):
    size, target = goals(corpus())
    assert len(mixed[1]) == len(corpus())
    for r in mixed[1]:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) <= 1e-9 * max(1, target[r.source])


def test_taken_words_come_near_their_targets(mixed):
    taken, target = defaultdict(int), goals(corpus())[1]
    for r in mixed[1]:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 5 + 0.01 * t or s in ("\U00010000", "￿"), (s, taken[s], t)


def test_reruns_agree_whatever_the_partitions(mixed):
    again = mixing.mix(mixed[0].repartition(7)).collect()
    key = lambda rows: sorted(((r.doc_id, r.size, r.copies) for r in rows), key=repr)
    assert key(again) == key(mixed[1])


def test_mixed_documents_carry_the_copies(mixed):
    docs, rows = mixed
    out = mixing.mixed_documents(docs)
    assert out.columns == [*docs.columns, "copies"]
    got = out.collect()
    assert sorted(((r.doc_id, r.copies) for r in got), key=repr) == sorted(((r.doc_id, r.copies) for r in rows if r.copies), key=repr)


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0.0, 0), (0.0, 0)]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_equal_ids_sources_and_sizes_with_unlike_texts_agree_in_reruns(spark):
    rows = [(1, f"t{i} words here", "a") for i in range(9)] + [(i + 10, "x y z " * 30, "b") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted((r.text, r.copies) for r in mixing.mixed_documents(docs.repartition(n)).collect()) for n in (1, 4)]
    assert runs[0] == runs[1] and runs[0]


def test_a_corpus_of_billions_of_words_has_targets_and_copies(spark):
    """Six sources of several hundred million words each, given by their classes of sizes; 5 times the sum passes 32 bits."""
    sizes = {f"s{k}": [(s, 100_000 * (1 + (s + k) % 7)) for s in (1, 40, 700, 9000)] for k in range(6)}
    rows = [(True, src, size, n) for src, held in sizes.items() for size, n in held]
    classes = spark.createDataFrame(rows, "has_src boolean, src string, size long, n long")
    for shrunk in (1, 40):  # the words of all sources together fit 32 bits for the last ones
        words = {src: sum(size * (n // shrunk) for size, n in held) for src, held in sizes.items()}
        of = [(True, src, words[src], sum(n // shrunk for _, n in sizes[src]), (5, 2, 1)[i % 3]) for i, src in enumerate(sorted(sizes))]
        sources = mixing.targets(spark.createDataFrame(of, "has_src boolean, src string, source_size long, docs long, weight int"))
        found = {r.src: r.target for r in sources.collect()}
        total, limit = sum(words.values()), {src: 3 * n for src, n in words.items()}
        assert abs(sum(found.values()) - total) <= 1e-6 * total and all(found[s] <= limit[s] * (1 + 1e-9) for s in found)
        shares = {src: found[src] / w for (_, src, _, _, w) in of if found[src] < limit[src] * (1 - 1e-9)}
        assert max(shares.values()) - min(shares.values()) <= 1e-6 * max(shares.values())
        scratch = mixing.Scratch(spark, "test-mix")
        fewer = classes.withColumn("n", F.floor(F.col("n") / shrunk))
        copies = mixing.class_copies(fewer, mixing.solve_dual(fewer, sources, scratch), scratch).groupBy("src").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        assert all(abs(r.taken - found[r.src]) <= 9000 for r in copies.collect())
        scratch.drop_all()


def test_documents_of_the_mix_have_weights_beyond_32_bits(spark):
    """Weights that are 2**28 times as large pass 32 bits as words of a large corpus do; only their shares count."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(60)], "doc_id long, text string, source string")
    got = [sorted((r.doc_id, r.copies) for r in mixing.mixed_documents(docs, weights=tuple(w << k for w in mixing.WEIGHTS)).collect()) for k in (0, 28)]
    assert got[0] == got[1] and got[0]
