import math
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import lattice_lm

PIECES = [b"\xff", b"\xffa", b"a", b"b", b"ab", b"ba", b"\xffab", b"c", b"aba"]


def brute(word, logp):
    text = lattice_lm.START + word
    ways = [0.0] * (len(text) + 1)
    ways[0] = 1.0
    for end in range(1, len(text) + 1):
        ways[end] = sum(ways[end - len(p)] * math.exp(q) for p, q in zip(PIECES, logp, strict=True) if text[:end].endswith(p))
    return math.log(ways[-1]) if ways[-1] else -math.inf


def lattice():
    weights = np.arange(1, len(PIECES) + 1, dtype=float)
    return lattice_lm.Lattice(PIECES, weights / weights.sum())


def test_marginals_equal_brute_force():
    model = lattice()
    words = [bytes(w) for n in range(1, 6) for w in product(b"abc", repeat=n)] + [b"ab" * 300]
    got = model.walk(words)[0]
    assert np.allclose(got[:-1], [brute(w, model.logp) for w in words[:-1]], rtol=1e-9)
    assert np.isfinite(got[-1])


def test_expected_uses_spell_the_word():
    model = lattice()
    words, weights = [b"abab", b"a", b"cb"], np.array([2.0, 1.0, 3.0])
    uses = model.walk(words, weights)[1]
    letters = sum(u * len(p.lstrip(b"\xff")) for u, p in zip(uses, PIECES, strict=True))
    assert math.isclose(letters, 2 * 4 + 1 + 3 * 2, rel_tol=1e-9)


ROWS = [(i, f"The cat {'sat ' * (i % 4)}on Mat{i % 7}. \x85x y") for i in range(60)]
ROWS += [(100, None), (101, ""), (102, " \t\n\x0b\x0c\r"), (103, "ÀB " * 5000), (103, "ÀB " * 5000), (None, "the cat"), (104, "z" * 20_000)]


def test_base_equals_brute_force_and_score_is_a_log_probability(spark, monkeypatch):
    monkeypatch.setattr(lattice_lm, "HEAD", 6)  # so that most words go through the join
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, word int")
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    got = sorted(lattice_lm.score_documents(docs, learn).collect(), key=repr)
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for d, t in ROWS if d is None or d % 3 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (repr(d), len(tokens(t)), sum(1 for w in tokens(t) if counts[w]), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for d, t in ROWS
    )
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in got)


def test_words_sum_to_one_at_most():
    totals = lattice_lm.Totals(tokens=10, distinct=4, ends=2, once=2, twice=1)
    model = lattice()
    words = [bytes(w) for n in range(0, 8) for w in product(b"abc", repeat=n)]
    counts = np.zeros(len(words))
    counts[[1, 2, 3, 4]] = [5, 3, 1, 1]
    with np.errstate(divide="ignore"):
        assert 0 < (10 ** totals.score(counts, model.walk(words)[0])).sum() + totals.p_end <= 1 + 1e-9


def test_without_learning_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lattice_lm.score_documents(docs, F.lit(False)).collect()}
    assert got[2].n_tokens == 1 and got[2].n_known == 0 and math.isfinite(got[1].score) and math.isclose(got[2].score, math.log10(0.5))
    assert lattice_lm.score_documents(docs.limit(0), F.lit(True)).count() == 0
