"""The text index and the dictionary index against plain predicates."""

import random

from pyspark.sql import functions as F

from newsloom.operators import search, similarity, tagging
from newsloom.operators.text_index import TextIndex


def texts(seed, n):
    rng = random.Random(seed)
    words = ["port", "rail", "grid", "tender", "award", "the", "of", "Solar", "park", "café", "数据中心", "x_1"]
    return [(i, " ".join(rng.choices(words, k=rng.randrange(0, 7))), ", ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(n)]


def test_index_answers_like_the_texts(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    assert index.matches("rail").count() == 0
    old, new = texts(1, 60), texts(2, 40)
    frame = lambda rows: spark.createDataFrame(rows, "id long, title string, body string")
    index.add(frame(old), 1, "id", F.col("body"), F.col("title"))
    index.add(frame(new + [(90, None, None)]), 2, "id", F.col("body"), F.col("title"))
    now = frame([r for r in old if r[0] >= 40] + new)
    for query in ("the rail", "Solar", "数据中心 x_1", "absent", "café of", " .,"):
        want = {r.id for r in now.filter(search.has_all_tokens(F.col("body"), query)).collect()}
        assert {r.id for r in index.with_all_tokens(query).collect()} == want, query
        s = similarity.trigram_similarity(F.col("title"), query)
        alike = {r.id: round(r.s, 9) for r in now.select("id", s.alias("s")).filter(F.col("s") > search.TRIGRAM_MIN).collect()}
        assert {r.id: round(r.similarity, 9) for r in index.with_similar_title(query).collect()} == alike, query


def test_query_plan_reads_lists_and_no_text(spark, tmp_path, capsys):
    index = TextIndex(spark, str(tmp_path))
    index.add(spark.createDataFrame(texts(3, 30), "id long, title string, body string"), 1, "id", F.col("body"), F.col("title"))
    index.with_all_tokens("rail tender").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "PushedFilters" in plan and "In(term" in plan and "body" not in plan and "title" not in plan


def test_long_lists_are_cut_into_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("newsloom.operators.text_index.SEGMENT_IDS", 10)
    index = TextIndex(spark, str(tmp_path))
    rows = spark.range(100).select("id", F.lit("t").alias("title"), F.lit("everywhere").alias("body"))
    index.add(rows, 1, "id", F.col("body"), F.col("title"))
    lists = index._read("postings", "term string, segment int, n int, ids array<bigint>, kind string, bucket int").filter("term = 'everywhere'").collect()
    assert len(lists) > 5 and sum(r.n for r in lists) == 100
    assert index.with_all_tokens("Everywhere").count() == 100
    assert {r.documents for r in index.document_counts("token").collect()} == {100}


def test_dictionary_terms_of_any_length_and_case(spark):
    rng = random.Random(4)
    docs = [(i, "".join(rng.choice("abAB é中x") for _ in range(rng.randrange(0, 80)))) for i in range(80)] + [(200, None), (201, "")]
    terms = sorted({"".join(rng.choice("abAB é中x") for _ in range(rng.randrange(1, 9))) for _ in range(60)})
    for fold in (True, False):
        table = spark.createDataFrame([(f"l{i % 7}", t, fold) for i, t in enumerate(terms)], "label string, term string, fold boolean")
        got = {tuple(r) for r in tagging.match_terms(spark.createDataFrame(docs, "doc_id long, text string"), "text", "doc_id", table).collect()}
        key = str.lower if fold else str
        want = {(d, f"l{i % 7}", t) for d, x in docs if x for i, t in enumerate(terms) if key(t) in key(x)}
        assert got == want


def test_seeds_are_the_rarest_grams(spark):
    terms = spark.createDataFrame([("a", "motion"), ("a", "nation"), ("a", "ration"), ("a", "on")], "label string, term string")
    seeds = {r.term: bytes(r._g) for r in tagging.term_seeds(terms).collect()}
    assert seeds["motion"] != b"tion" and seeds["nation"] != b"tion" and seeds["on"] == b"on"
