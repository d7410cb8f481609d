import random

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import toxicity


def subsequences(word):
    s, out = toxicity._SYMBOL[np.frombuffer(word, np.uint8)], {}
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, len(s)):
                if k - i < toxicity.SPAN and s[i] and s[j] and s[k]:
                    u = (s[i], s[j], s[k])
                    out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i + 1)
    return out


def plain_kernel(a, b):
    x, y = subsequences(a), subsequences(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) if x and y else 0.0


WORDS = [b"idiot", b"i.d.i.o.t", b"idiooot", b"moron", b"aaaa", b"ab", "pathétique".encode(), b"banana", b"x1y2z3"]


def test_kernel_equals_the_definition():
    got = toxicity.kernel(WORDS, WORDS)
    assert np.allclose(got, [[plain_kernel(a, b) for b in WORDS] for a in WORDS], atol=1e-6)
    assert got[0, 1] > got[0, 3] and got[0, 2] > got[0, 3]


def test_folded_weights_equal_the_landmark_sum():
    alpha = np.linspace(-1, 1, len(WORDS))
    assert np.allclose(toxicity.margins(WORDS, toxicity.fold(WORDS, alpha), 0.25), toxicity.kernel(WORDS, WORDS) @ alpha + 0.25, atol=1e-5)


def test_units_join_spaced_letters_and_window_long_words():
    assert {b"idiot", b"you"} <= toxicity.units_of(b"you i d i o t!") | {b"idiot"}
    assert b"idiot" in toxicity.units_of(b"an i d i o t here")
    assert max(map(len, toxicity.units_of(b"z" * 100))) <= toxicity.UNIT


def test_units_bridge_gaps_in_every_script():
    unit = lambda word: toxicity.units_of(word.encode())
    for word in ("idiot", "pathétique", "blödmann", "дурак"):
        plain = unit(word)
        assert len(plain) == 1 and len(*plain) == len(word)
        for gap in (" ", "  ", "\t", "\n", "\r\n", "\u00a0", " - ", "---", ".", "\u200b"):
            assert plain <= unit("xyzzy " + gap.join(word) + " here!"), (word, gap)
    for text in ("id iot", "i diot", "id  i ot", "id\niot", "i-d iot"):
        assert b"idiot" in unit(f"some {text} there"), text
    assert unit("ду рак") >= unit("дурак") and unit("pathe\u0301tique") == unit("pathetique")
    assert unit("") == unit(" -- ") == set()


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    syllables = ["ba", "ne", "ti", "lo", "sa", "ku", "re", "mi", "don", "gar"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        text, toxic = [word() for _ in range(rng.randrange(5, 60))], i % 4 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["wretch", "buffoon", "vermin", "wretches", "buffoons"]))
        rows.append((i, " ".join(text) + ".", int(toxic)))
    return rows


def test_held_out_texts_and_gapped_insults(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.filter("doc_id < 300"))
    probes = [
        (1, "sane tilo ba.", 0), (2, "sane w.r.e.t.c.h tilo", 1), (3, "you buf-foon!", 1), (4, "ver_min", 1), (5, None, 0), (6, "", 0), (7, "kure " * 30_000, 0),
        (8, "v e r m i n", 1), (None, "WRETCH", 1), (9, "bane " * 9000 + "buffoon", 1), (9, "bane " * 9000 + "buffoon", 1),
    ]
    frame = spark.createDataFrame([(*p[:2], 3) for p in probes], "doc_id long, text string, score int")
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_documents(frame, model).collect()}
    assert {i: p for i, (_, p) in got.items()} == {i: y for i, _, y in probes}
    assert all(0 <= s <= 1 for s, _ in got.values())
    held = toxicity.score_documents(docs.filter("doc_id >= 300"), model).join(labels, "doc_id")
    assert held.filter(F.col("predicted") != F.col("toxic")).count() <= 2
    kept = toxicity.drop_toxic(frame, model)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {1, 5, 6, 7}


def test_without_labels_nothing_is_rejected(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert [(r.score, r.predicted) for r in toxicity.score_documents(docs, model).collect()] == [(0.0, 0)]
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
