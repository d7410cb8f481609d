import random

import numpy as np

from newsloom.llm import near_dedup


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, size):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def brute(rows, size=4):
    sets = [shingles(t, size) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, out = text(60), []
    for _ in range(70):  # texts that share a long passage and little else
        out.append(passage + text(rng.randrange(20, 50)))
    base = text(200)
    for _ in range(40):  # near copies of one text
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(200)] = rng.choice(vocabulary)
        out.append(copy)
    for n in (1, 2, 3, 4, 5, 30, 400):
        out += [text(n)] * 2
    rows = [(i, " ".join(w)) for i, w in enumerate(out)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "A b\x85c D"), (1004, "a B\x85C d"), (1005, rows[100][1].upper())]
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_components_equal_brute_force(spark):
    rows = corpus()
    assert result(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_large_open_buckets_are_dealt_by_rare_prefixes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LARGE", 3)
    rows = corpus(5)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    assert result(near_dedup.near_duplicates(docs, 5)) == brute(rows, 5)


def test_one_row_of_each_component_stays(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, None), (8, None), (9, "x y"), (None, "q r s t u"), (None, "q r s t u")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, place string")
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted([r.doc_id for r in out.collect()], key=repr) == [3, 7, 8, 9, None]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components_with_null_or_repeated_ids_each_keep_a_row(spark):
    rng = random.Random(11)
    text = lambda n: [rng.choice(["w", "v", "u"]) + str(rng.randrange(9000)) for _ in range(n)]
    base, other = text(60), text(40)
    near = [*base[:-1], "changed"]
    far = [*base[1:], "moved"]
    rows = [(None, None), (None, ""), (None, " ".join(text(20))), (None, " ".join(text(30))), (None, "one two"), (None, "one two"), (None, "ONE  two")]
    rows += [(4, " ".join(base)), (9, " ".join(near)), (None, " ".join(far)), (4, " ".join(other)), (4, " ".join(other)), (4, "short text"), (8, "lone words here")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string")
        kept = [(r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(docs.coalesce(1)).collect()]
        short = [t for i, t in kept if i is None and t and t.lower().split() == ["one", "two"]]
        assert len(short) == 1
        want = [*rows[:4], (4, " ".join(base)), (4, " ".join(other)), (4, "short text"), (8, "lone words here")]
        assert sorted((k for k in kept if k[1] not in short), key=repr) == sorted(want, key=repr)


def test_hashes_do_not_depend_on_the_chunk():
    a, b = b"one two  Three four five", b"x\tONE two three four FIVE"
    data = np.frombuffer(a + b, np.uint8)
    first, second = near_dedup.shingle_sets(data, np.array([0, len(a), len(a) + len(b)]))
    alone = near_dedup.shingle_sets(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
    assert (second == alone).all() and len(first) == 2 and set(first) < set(second) and len(second) == 3


def test_two_equal_collections_share_a_table(spark):
    signature = list(range(near_dedup.COLLECTIONS))
    other = [-x - 1 for x in signature]
    other[3], other[7] = 3, 7
    df = spark.createDataFrame([(signature,), (other,)], "signature array<long>").select(near_dedup.table_keys().alias("k"))
    a, b = (set(r.k) for r in df.collect())
    assert len(a & b) == 1 and len(a) == 66


def test_exploded_rows_and_places_are_never_broadcast_by_a_guess(spark, monkeypatch):
    """Spark counts 66 keys of a node as one row: keys, shingles and places are joined by sorting, at any size."""
    plans, cut, buckets = [], near_dedup.Scratch.cut, near_dedup.Scratch.cut_buckets

    def planned(write):
        def run(self, df, name, *args, **options):
            plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
            return write(self, df, name, *args, **options)

        return run

    monkeypatch.setattr(near_dedup.Scratch, "cut", planned(cut))
    monkeypatch.setattr(near_dedup.Scratch, "cut_buckets", planned(buckets))
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    plans.append(("kept", near_dedup.drop_near_duplicates(docs)._jdf.queryExecution().sparkPlan().toString()))
    first = {}
    for name, plan in plans:
        first.setdefault(name, plan)
    assert {"members", "sets", "kept"} <= set(first)
    for name in ("members", "sets", "kept"):
        assert "SortMergeJoin" in first[name] and "BroadcastHashJoin" not in first[name], (name, first[name])
    ranked = near_dedup.rare_prefixes(spark.createDataFrame([(1, [1, 2]), (2, [2, 3])], "node long, shingles array<long>"))
    assert "BroadcastHashJoin" not in ranked._jdf.queryExecution().sparkPlan().toString()
