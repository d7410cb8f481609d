"""Work that must not meet in one task, or run once per character outside compiled code."""

import os

import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import evidence_excerpt, squeeze
from newsloom.operators import tagging, text_index
from newsloom.plans.showcase import search_queries, stream_queries, tag_queries
from newsloom.sources import imports


def test_landed_parts_are_written_by_several_tasks_and_read_as_one_batch_each(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 4).withColumnRenamed("id", "n")
    folder, seen = str(tmp_path / "in"), []

    def start(stream):
        handle = lambda batch, epoch: seen.append((epoch, batch.count()))
        return stream.writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)

    stream_queries.landed_in_batches(spark, rows, "n", folder, start)
    assert [n for _, n in seen] == [1000, 1000, 1000]
    assert [e for e, _ in seen] == [0, 1, 2]
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) > 3


@pytest.mark.parametrize("broadcast", [True, False])
def test_places_of_terms_with_and_without_a_broadcast_dictionary(spark, broadcast, monkeypatch):
    monkeypatch.setattr(tagging, "BROADCAST_ROWS", 50_000 if broadcast else 0)
    texts = [(1, "Ab cdef abCDEF"), (2, None), (3, ""), (4, "é cdé"), (5, "cd")]
    terms = [("a", "abcdef"), ("b", "cdé"), ("c", "cd"), ("d", "cdef a"), ("e", "x")]
    docs = spark.createDataFrame(texts, "id long, text string")
    got = {tuple(r) for r in tagging.match_terms(docs, "text", "id", spark.createDataFrame(terms, "label string, term string")).collect()}
    assert got == {(i, label, term) for i, text in texts if text for label, term in terms if term in text.lower()}


def test_slots_of_texts_and_seeds_agree():
    body = "über den Fluss".encode()
    for width in (1, 3, 4, 9):
        slots = tagging._slots(body, width, 1023)
        assert [int(s) for s in slots] == [int(tagging._slots(body[i : i + width], width, 1023)[0]) for i in range(len(body) - width + 1)]
    assert len(tagging._slots(None, 4, 1023)) == len(tagging._slots(b"abc", 4, 1023)) == 0


def test_json_of_a_file_is_read_once(spark):
    files = spark.createDataFrame([("f", 1, '{"articles":[{"title":"a"}, 3, {"title":"b"}]}'), ("g", 1, "[]"), ("h", 1, '{"url":"u"}'), ("i", 1, None)], "file string, size int, content string")
    rows = imports.json_rows(files)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("$.articles") == 1
    got = {(r.file, r.row_number, tuple(r.row.items())) for r in rows.collect()}
    assert got == {("f", 1, (("title", "a"),)), ("f", 2, (("title", "b"),)), ("h", 1, (("url", "u"),))}


def test_terms_of_a_batch_are_cut_once(spark, tmp_path, monkeypatch):
    plans = []
    seen = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, *a: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or seen(self, *a))
    rows = spark.createDataFrame([(1, "A title", "two words"), (2, None, None)], "id long, title string, body string")
    index = text_index.TextIndex(spark, str(tmp_path))
    index.add(rows, 1, "id", F.col("body"), F.col("title"))
    assert len(plans) == 1 and plans[0].count("Filter ((size(") == plans[0].count("Filter (size(") == 0
    assert {r.term for r in index.document_counts("token").collect()} == {"two", "words"}


def test_evidence_is_analysed_once(spark, sf_dir):
    plan = tag_queries.score_evidence(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter ((size(" not in plan and "Filter (size(" not in plan


def test_excerpt_is_the_beginning_of_the_squeezed_text(spark):
    texts = ["", None, " \n a  b", "x " * 3000, " " * 3000 + "y  z" * 400, "a" + " " * 2500 + "b" * 600, "w" * 499 + " " * 1600 + "v", " " * 10 + "q" * 501]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for n in (500, 600):
        assert df.filter(~evidence_excerpt(F.col("t"), n).eqNullSafe(F.substring(squeeze(F.col("t")), 1, n))).count() == 0


def test_board_rows_are_dealt_out_before_the_analysis(spark, sf_dir, monkeypatch):
    held = []
    monkeypatch.setattr(search_queries, "once", lambda s, d, name, build: build())
    monkeypatch.setattr(search_queries, "cut_lineage", lambda df, name: held.append(df) or df)
    search_queries._board(spark, sf_dir)
    assert "RebalancePartitions" in held[0]._jdf.queryExecution().optimizedPlan().toString()
