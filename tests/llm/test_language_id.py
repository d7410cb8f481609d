from collections import Counter

import numpy as np

from newsloom.llm import language_id


def gram_counts(text):
    data = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").lower().encode())
    out = Counter()
    for word in data.split():
        padded = b" " + word + b" "
        for n in (1, 2, 3):
            out.update(g for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != b" ")
    # a blank between two words is the edge of both
    for a in {w[-1:] + b" " for w in data.split()} | {b" " + w[:1] for w in data.split()}:
        assert a in out
    return out


def ranked(counts, k):
    code = lambda g: int.from_bytes(g, "big")
    return [code(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:k]]


TEXTS = [
    ("de", "Der schnelle Fuchs und das Haus ist über dem Wald, nicht wahr?"), ("de", "Die Katze schläft nicht, und der Hund bellt laut."),
    ("en", "The quick fox and the house is over the hill, is it not?"), ("en", "The cat does not sleep and the dog barks loudly at them."),
    ("fr", "Le renard rapide et la maison est sur la colline, n'est-ce pas?"), (None, "ignored words"), ("fr", None),
]


def test_profiles_and_distances_equal_brute_force(spark):
    learned = language_id.learn_profiles(spark.createDataFrame(TEXTS, "lang string, text string"), 40)
    want = {}
    for lang in ("de", "en", "fr"):
        want[lang] = ranked(sum((gram_counts(t) for x, t in TEXTS if x == lang), Counter()), 40)
    assert learned == want
    ranker = language_id.Ranker(learned, 40)
    texts = ["und der hund ist nicht über", "the dog and the fox", "a", "", "été à la maison"]
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    apart = ranker.distances(data, off)[0]
    for row, text in enumerate(texts):
        own = ranked(gram_counts(text), 40)
        for j, lang in enumerate(ranker.langs):
            assert apart[row, j] == sum(abs(i - want[lang].index(g)) if g in want[lang] else 40 for i, g in enumerate(own))


def test_predictions_and_edge_cases(spark):
    profiles = language_id.learn_profiles(spark.createDataFrame(TEXTS, "lang string, text string"))
    rows = [(1, "Der Hund und die Katze"), (2, None), (3, ""), (4, "123 !?"), (5, "THE DOG AND THE HOUSE"), (None, "la maison est"), (6, "the " * 60_000), (6, "the " * 60_000)]
    docs = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, lang_pred string, readable int")
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs, profiles).collect()}
    assert got == {(1, "de"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (None, "fr"), (6, "en")}
    assert all(0 <= r.score <= 1 for r in language_id.identify(docs, profiles).collect())
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), profiles).count() == 0
    assert language_id.learn_profiles(spark.createDataFrame([], "lang string, text string")) == {}


def test_held_out_accuracy(spark, sf_dir):
    from newsloom.llm.queries import op7_language_id

    told = op7_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = told.filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
