"""Inverted index of body tokens and title trigrams.

Posting lists are stored by hash bucket of the term and in its order, so a query reads the parts that hold its
own terms and no text.  A list is cut into segments of a bounded number of ids, so a word that every text holds is many short
rows.  Each ingest batch appends its segments; an article that comes again is found in its latest batch only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.search import TRIGRAM_MIN, tokens
from newsloom.operators.similarity import trigrams

BUCKETS, SEGMENT_IDS = 16, 20_000
POSTINGS = "term string, segment int, n int, ids array<bigint>, batch bigint, kind string, bucket int"
DOCUMENTS = "id bigint, n_trigrams int, batch bigint"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _listed(kind: str, terms: str) -> Column:
    known = F.coalesce(F.col(terms), F.array().cast("array<string>"))
    return F.transform(known, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))


@dataclass(frozen=True)
class TextIndex:
    """The index tables below ``path``."""

    spark: SparkSession
    path: str

    def add(self, articles: DataFrame, batch: int, row_id: str, body: Column, title: Column) -> None:
        """Append the posting lists of a batch; ``batch`` grows from one to the next, ids are unique within one."""
        rows = articles.select(F.col(row_id).cast("bigint").alias("id"), F.array_distinct(tokens(body)).alias("words"), trigrams(title).alias("grams"))
        segments = 1 + articles.count() // SEGMENT_IDS
        kinds = F.concat(_listed("token", "words"), _listed("trigram", "grams"))
        # Before a plain explode Spark tests for terms first, for which it cuts every text again.
        listed = rows.select("id", F.pmod(F.xxhash64("id"), F.lit(segments)).cast("int").alias("segment"), F.explode_outer(kinds).alias("t")).filter("t is not null")
        lists = listed.groupBy("t.kind", "t.term", "segment").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        lists = lists.select("term", "segment", F.size("ids").alias("n"), "ids", F.lit(batch).cast("bigint").alias("batch"), "kind", _bucket(F.col("term")).alias("bucket"))
        by = lists.repartition("bucket").sortWithinPartitions("bucket", "kind", "term")
        by.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        rows.select("id", F.coalesce(F.size("grams"), F.lit(0)).alias("n_trigrams"), F.lit(batch).cast("bigint").alias("batch")).write.mode("append").parquet(f"{self.path}/documents")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing was added yet
            return self.spark.createDataFrame([], schema)

    def document_counts(self, kind: str) -> DataFrame:
        """(term, documents): the length of every posting list over all batches."""
        lists = self._read("postings", POSTINGS).filter(F.col("kind") == kind)
        return lists.groupBy("term").agg(F.sum("n").alias("documents"))

    def _shared(self, kind: str, terms: list[str], least: int) -> DataFrame:
        """(id, k, n_trigrams): articles whose latest batch holds at least ``least`` of the terms."""
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).distinct().collect()]
        lists = self._read("postings", POSTINGS).filter((F.col("kind") == kind) & F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        hits = lists.select("batch", F.explode("ids").alias("id")).groupBy("id", "batch").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least)
        seen = self._read("documents", DOCUMENTS).groupBy("id").agg(F.max(F.struct("batch", "n_trigrams")).alias("last"))
        return hits.join(seen, "id").filter("batch = last.batch").select("id", "k", "last.n_trigrams")

    def _terms(self, column: Column) -> list[str]:
        """Distinct terms of a query text."""
        return sorted(self.spark.range(1).select(F.array_distinct(column).alias("t")).first()["t"])

    def with_all_tokens(self, query: str) -> DataFrame:
        """C4: ids of the articles that hold every token of the query; none for a query without tokens."""
        wanted = self._terms(tokens(F.lit(query)))
        return self._shared("token", wanted, max(1, len(wanted))).select("id") if wanted else self._read("documents", DOCUMENTS).limit(0).select("id")

    def with_similar_title(self, query: str, least: float = TRIGRAM_MIN) -> DataFrame:
        """(id, similarity) of the articles whose title shares more than ``least`` of all trigrams.

        The union has at least the query's trigrams, so lists that meet in fewer than that share are dropped
        before the titles' sizes are looked up.
        """
        wanted = self._terms(trigrams(F.lit(query)))
        if not wanted:
            return self._read("documents", DOCUMENTS).limit(0).select("id", F.lit(0.0).alias("similarity"))
        hits = self._shared("trigram", wanted, max(1, int(least * len(wanted))))
        similarity = F.col("k") / (F.col("n_trigrams") + len(wanted) - F.col("k"))
        return hits.select("id", similarity.alias("similarity")).filter(F.col("similarity") > least)

    def matches(self, query: str) -> DataFrame:
        """Ids of the full-text search: all tokens in the body, or a title alike."""
        return self.with_all_tokens(query).union(self.with_similar_title(query).select("id")).distinct()
