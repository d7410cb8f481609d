import corpus_pipeline
import pytest

import __spark_entry__
from newsloom.llm import near_dedup


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The tables after each stage, over a fixture with planted cases beside real documents."""
    sf, out = tmp_path_factory.mktemp("sf"), tmp_path_factory.mktemp("out")
    real = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{real}/documents.parquet"), spark.read.parquet(f"{real}/benchmark.parquet")
    passage = bench.orderBy("item_id").first().text
    text = " ".join(f"plain{i}" for i in range(80))
    planted = [(900_000, text), (900_001, text.upper()), (900_002, text + " one more"), (900_003, f"intro words {passage} outro"), (900_004, None), (900_005, " ".join(f"other{i}" for i in range(50)))]
    extra = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in planted], docs.schema)
    docs.unionByName(extra).write.parquet(f"{sf}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{real}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    tables = [spark.read.parquet(f"{sf}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], str(sf)).write.parquet(f"{out}/{k}")
        tables.append(spark.read.parquet(f"{out}/{k}"))
    return tables


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns_and_only_drop_rows(kept):
    for before, after in zip(kept[:-2], kept[1:-1], strict=True):
        assert after.columns == before.columns and ids(after) <= ids(before)
    assert kept[-1].columns == [*kept[0].columns, "copies"]


def test_planted_cases(kept):
    raw, safe, exact, near, clean, _ = map(ids, kept)
    assert {900_000, 900_001, 900_005} <= safe
    assert 900_000 not in exact and 900_001 in exact
    assert len({900_001, 900_002} & near) == 1
    assert 900_003 in near and 900_003 not in clean
    assert {900_004, 900_005} <= clean


def test_no_equal_texts_are_left(kept):
    norm = [(r.text or "").encode().lower() for r in kept[2].collect()]
    assert len(norm) == len(set(norm))


def test_clashing_and_dotted_names_on_every_stage(spark, tmp_path):
    """Extra columns with the names that stages use themselves, and with dots, come back as they were."""
    real = "/root/testdata/sf0.001"
    names = ["_key", "_at", "key", "at", "place", "marks", "copies", "a.b", "score", "comp", "row"]
    rows = [(i, f"text number {i} " + " ".join(f"w{i}x{k}" for k in range(30)), "s", *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{real}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.columns[: len(docs.columns)] == docs.columns
        docs = after
    got = {tuple(r)[: len(names) + 3] for r in docs.collect()}
    assert got and got <= set(rows)


def test_run_equals_its_stages(spark, kept, tmp_path):
    first = kept[0].inputFiles()[0].rsplit("/", 2)[0]
    assert sorted(map(str, corpus_pipeline.run(spark, first).collect())) == sorted(map(str, kept[-1].collect()))


def test_registered_queries():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def test_the_near_stage_joins_its_exploded_keys_by_sorting(spark, monkeypatch):
    """A broadcast of the keys, which Spark sizes as one row a node, would be built in the driver."""
    plans, cut = {}, near_dedup.Scratch.cut
    monkeypatch.setattr(near_dedup.Scratch, "cut", lambda self, df, name, **o: (plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString()), cut(self, df, name, **o))[1])
    docs = spark.createDataFrame([(i, f"a text of some words {i // 2} and a few more") for i in range(6)], "doc_id long, text string")
    assert corpus_pipeline.near(spark, docs, "").count() == 3
    assert "SortMergeJoin" in plans["members"] and "BroadcastHashJoin" not in plans["members"]
