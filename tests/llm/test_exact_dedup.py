import hashlib

from pyspark.sql import functions as F

from newsloom.llm import exact_dedup
from newsloom.llm.common import Scratch

ROWS = [
    (1, "Same text", "a"), (2, "same TEXT", "b"), (3, "same texté", "a"), (4, "same textÉ", "a"), (5, None, None), (6, "", "a"),
    (7, " same text", "a"), (8, "x" * 200_000, "a"), (9, "X" * 200_000, "a"), (9, "X" * 200_000, "a"), (None, "lone", "a"), (None, "lone", "a"),
]
SCHEMA = "doc_id long, text string, digest string"


def norm(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    out = []
    for i, t, _ in rows:
        same = [r[0] for r in rows if norm(r[1]) == norm(t)]
        ids = [x for x in same if x is not None]
        out.append((i, max(ids) if ids else None, len(same), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()], key=repr)


def test_groups_equal_brute_force_and_one_row_of_each_stays(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = exact_dedup.deduplicate(docs).cache()
    assert found(out) == expected(ROWS)
    assert out.filter("kept").count() == len({norm(t) for _, t, _ in ROWS})
    assert out.filter("kept and doc_id <> keep_id").count() == 0


def test_digest_collisions_are_told_apart_by_full_text(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    weak = exact_dedup.deduplicate(docs, digest=lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1))
    assert found(weak) == expected(ROWS)


def test_state_goes_on_over_batches_and_restarts(spark):
    scratch = Scratch(spark, "test-state")
    where, state = scratch.path("feed"), scratch.path("state")
    record = "struct<doc_id: bigint, locator: struct<file: string, row: bigint>>"

    def feed(*rows):
        spark.createDataFrame([(d, (i, ("f", i))) for d, i in rows], f"digest string, record {record}").coalesce(1).write.mode("append").parquet(where)

    feed(("a", 1), ("b", 2))
    feed(("a", 3))
    with exact_dedup.disk_backed_state(spark):
        stream = lambda: spark.readStream.schema(f"digest string, record {record}").option("maxFilesPerTrigger", 1).parquet(where)
        first = exact_dedup.keyed_state(stream(), state).select("digest", "keep.doc_id", "n").collect()
        feed(("b", 9), ("c", 4))
        second = exact_dedup.keyed_state(stream(), state).select("digest", "keep.doc_id", "n").collect()
    assert sorted(map(tuple, first)) == [("a", 3, 2), ("b", 2, 1)]
    assert sorted(map(tuple, second)) == [("a", 3, 2), ("b", 9, 2), ("c", 4, 1)]


def test_dropping_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(*r, r[0], "z") for r in ROWS], SCHEMA + ", locator long, kept string")
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert out.count() == len({norm(t) for _, t, _ in ROWS})


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.deduplicate(docs).count() == 0
    assert exact_dedup.drop_duplicates(docs).count() == 0


def test_main_path_is_native(spark, sf_dir):
    plan = exact_dedup.deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
