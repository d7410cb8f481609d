"""Article search, boards, joins and paging (C, F, I, K rows)."""

import uuid

from pyspark.sql import functions as F

from newsloom.operators import joins, search, similarity
from newsloom.operators.dedup import best_per_event
from newsloom.operators.scoring import analyze
from newsloom.operators.text_index import TextIndex
from newsloom.plans.board import board_page, event_board
from newsloom.plans.showcase.base import (
    AS_OF, AS_OF_SQL, CANDIDATE_CTE, DOCS_CTE, GATE_CTE, RELEVANCE as R, article_table, docs, once, table,
)
from newsloom.plans.showcase.tag_queries import _REL_CTE
from newsloom.session import checkpoint_root, cut_lineage

num = lambda c: F.col(c).cast("bigint").alias(c)
day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)


def _articles(spark, sf):
    """Documents in the article schema of the search operators."""
    d = docs(spark, sf)
    return d.withColumns({
        "id": F.col("doc_id"), "summary": F.col("lang"), "content_excerpt": F.col("text"), "country": F.col("source"), "region": F.col("lang"),
        "source_name": F.col("source"), "is_overseas": F.col("doc_id") % 5 != 0, "is_demo": F.col("doc_id") % 50 == 1,
        "confidence_score": (F.col("doc_id") * 7919 % 1000) / 1000,
    })


def rolling_window_search(spark, sf):
    page, _ = search.search_articles(_articles(spark, sf), search.FilterSpec(q="ANTION"), AS_OF, 1, 50)
    return page.select("doc_id", "title", day("published_at"))


def archive_search(spark, sf):
    spec = search.FilterSpec(q="inging", include_archive=True, sort="published_asc")
    page, _ = search.search_articles(_articles(spark, sf), spec, AS_OF, 2, 20)
    return page.select("doc_id", day("published_at"))


def search_total(spark, sf):
    _, total = search.search_articles(_articles(spark, sf), search.FilterSpec(q="retion", reliability="high"), AS_OF)
    return total.select(num("total"))


def date_range_search(spark, sf):
    spec = search.FilterSpec(date_from="2024-03-01", date_to="2024-05-31", source_type="official", from_fetched_at="2024-03-10T00:00:00Z", sort="confidence_desc")
    page, _ = search.search_articles(_articles(spark, sf), spec, AS_OF, 1, 100)
    return page.select("doc_id", day("published_at"), "confidence_score")


def saved_filter_search(spark, sf):
    """A stored filter specification, read back and applied."""
    saved = {"q": "antion", "source_type": "media", "date_from": "2024-06-01", "sort": "published_asc", "colour": "ignored", "region": None}
    hits = search.apply_filters(_articles(spark, sf), search.FilterSpec.from_saved(saved), AS_OF)
    return hits.select("doc_id", day("published_at"))


def text_index(spark, sf):
    """The index of the documents, added in two batches; the second one replaces some of the first."""
    def build():
        index = TextIndex(spark, f"{checkpoint_root(spark)}/newsloom/text-index-{uuid.uuid4().hex}")
        rows = _articles(spark, sf).select("id", "title", "summary", "content_excerpt")
        older = rows.filter("id % 2 = 0 or id % 5 = 0")
        changed = older.withColumn("title", F.when(F.col("id") % 5 == 0, F.reverse("title")).otherwise(F.col("title")))
        index.add(changed, 1, "id", search.fulltext_body(), F.col("title"))
        index.add(rows.filter("id % 2 = 1 or id % 5 = 0"), 2, "id", search.fulltext_body(), F.col("title"))
        return index

    return once(spark, sf, "text-index", build)


def fulltext_search(spark, sf):
    """All tokens in the body, or a title alike, from the index."""
    spec = search.FilterSpec(q="thing on the retion", search="fulltext", include_archive=True)
    return search.apply_filters(_articles(spark, sf), spec, AS_OF, text_index(spark, sf).matches(spec.q)).select("doc_id")


def index_counts(spark, sf):
    """Document counts of the index's tokens, over the batches that hold them."""
    n = text_index(spark, sf).document_counts("token")
    return n.select("term", num("documents"))


def token_search(spark, sf):
    return docs(spark, sf).filter(search.has_all_tokens(F.col("text"), "The antion")).select("doc_id")


def trigram_search(spark, sf):
    """Titles alike, from the index."""
    found = text_index(spark, sf).with_similar_title("thing on the retion")
    return found.select(F.col("id").alias("doc_id"), F.round("similarity", 6).alias("similarity"))


def trigram_scan(spark, sf):
    """Titles alike, computed from the titles themselves."""
    s = similarity.trigram_similarity(F.col("title"), "thing on the retion")
    return docs(spark, sf).select("doc_id", F.round(s, 6).alias("similarity")).filter(F.col("similarity") > search.TRIGRAM_MIN)


def array_filters(spark, sf):
    df = article_table(spark, sf, "doc_id", "labels", "candidates").withColumn("ka", F.transform("candidates", lambda c: c["account"]))
    hit = df.filter(search.like_any(F.col("labels"), "RAI") & search.like_any(F.col("ka"), "ald"))
    family = search.label_family(df, ["company", "leader"], "labels")
    return hit.select("doc_id", F.lit("filters").alias("kind")).unionByName(family.select("doc_id", F.lit("family").alias("kind")))


def _board(spark, sf):
    # The analysis costs far more than the reading: rows are dealt out anew, however large the files' row groups are.
    d = docs(spark, sf).hint("rebalance")
    a = analyze(d, R, "title", "text", "source_type", "reliability_level").withColumn("content_hash", F.md5("text")).drop("text", "url")
    return once(spark, sf, "analysed", lambda: cut_lineage(a, "analysed")).withColumns({
        "id": F.col("doc_id"), "source_name": F.col("source"), "summary": F.col("lang"), "content_excerpt": F.col("evidence_excerpt"),
        "sales_relevance_score": F.col("relevance_score"), "canonical_event_id": F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("ev-"), (F.col("doc_id") % 97).cast("string"))),
        "is_primary_source": F.col("source_type") == "official", "is_demo": F.lit(False),
        "is_relevant": F.size("industry_tags") > 0, "overseas_rank": F.when(F.col("country").isNotNull(), 0).otherwise(1),
        "sales_score_evidence": F.when(F.col("doc_id") % 9 != 0, F.col("score_evidence")), "matched_entities": F.array("entity_id"),
    })


def board_rows(spark, sf):
    sources = table(spark, sf, "documents").select(F.col("source").alias("source_name")).distinct().filter(F.substring("source_name", 4, 9).cast("int") < 12)
    b = event_board(_board(spark, sf), search.BoardSpec(topic="account", band="all"), search.FilterSpec(), AS_OF, sources)
    return b.select("doc_id", "event_identity", num("board_score"), "band", "location_scope")


def board_sorted_page(spark, sf):
    b = event_board(_board(spark, sf), search.BoardSpec(event_type="sign", min_score=30), search.FilterSpec(), AS_OF)
    return board_page(b, "sales_relevance_desc", 1, 25).select("doc_id", num("board_score"), num("overseas_rank"))


def board_entities(spark, sf):
    """The board of some entities: by matched name or by their own sources, in its time order."""
    spec = search.BoardSpec(entity_names=("UNIT-1", "unit-3"), entity_sources=("src3", "src7"), min_score=30)
    b = event_board(_board(spark, sf), spec, search.FilterSpec(), AS_OF)
    return board_page(b, "published_desc", 1, 50).select("doc_id", num("board_score"), num("overseas_rank"))


def board_people(spark, sf):
    rows = search.board_filters(_board(spark, sf), search.BoardSpec(leader="er", band="medium"), "relevance_score")
    return rows.select("doc_id", num("relevance_score"))


def best_event_rows(spark, sf):
    return best_per_event(_board(spark, sf), "doc_id", "relevance_score").select("doc_id", "event_identity", num("relevance_score"))


def flags_join(spark, sf):
    flags = table(spark, sf, "labels").select(
        F.col("doc_id").alias("article_id"), F.when(F.col("doc_id") % 3 == 0, "ann").otherwise("bo").alias("user_id"),
        (F.col("quality") == 1).alias("is_favorite"), (F.col("toxic") == 1).alias("is_read"),
    )
    d = docs(spark, sf).select(F.col("doc_id").alias("article_id"), "source")
    return search.with_flags(d, flags, "ann").select("article_id", "favorite", "read")


def semi_sources(spark, sf):
    d = docs(spark, sf).select("doc_id", "source")
    busy = table(spark, sf, "documents").groupBy("source").count().filter("count >= 50")
    return joins.members_of(d, busy, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def anti_ledger(spark, sf):
    d = docs(spark, sf).select("doc_id")
    return joins.absent_from(d, table(spark, sf, "labels").select(F.col("doc_id").cast("bigint").alias("doc_id")), ["doc_id"])


def label_article_join(spark, sf):
    details = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("article_id"), num("toxic"))
    d = docs(spark, sf).filter("reliability_level = 'high'").withColumn("article_id", F.col("doc_id"))
    return joins.detail_with_article(details, d, ["title", "published_at"]).select("article_id", "toxic", "title", day("published_at"))


def order_page(spark, sf):
    o = table(spark, sf, "orders").withColumns({"published_at": F.col("o_orderdate").cast("timestamp"), "fetched_at": F.col("o_orderdate").cast("timestamp")})
    return search.page(o, search.article_order("published_desc", "o_orderkey"), limit=100, offset=40).select("o_orderkey", day("published_at"))


def supplier_parts(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q")).filter("q >= 90").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey")
    nested, wide = joins.nest_children(s, li, "s_suppkey", ["l_partkey"], "parts")
    listed = nested.select("s_suppkey", F.array_join(F.transform("parts", lambda p: p["l_partkey"].cast("string")), ",").alias("parts"))
    return listed.unionByName(wide.select("s_suppkey", F.col("l_partkey").cast("string").alias("parts")))


def saved_filter_specs(spark, sf):
    n = table(spark, sf, "nation").select(
        "n_nationkey", F.to_json(F.struct(F.col("n_name").alias("country"), F.when(F.col("n_regionkey") == 2, "high").alias("reliability"), F.lit("published_desc").alias("sort"), F.lit("x").alias("unknown_key"))).alias("filters")
    )
    return search.saved_filters(n).select("n_nationkey", F.col("spec.country").alias("country"), F.col("spec.reliability").alias("reliability"), F.col("spec.sort").alias("sort"))


def view_splits(spark, sf):
    df = article_table(spark, sf, "doc_id", "labels")
    has = lambda x: F.array_contains("labels", x)
    v = search.views(df, {
        "market": has("market_project"), "policy": has("tax_policy") | has("foreign_access"), "competitor": has("competitor"), "chamber": has("chamber"), "review": F.col("doc_id") % 3 == 0,
    })
    return v.groupBy("view").agg(F.count(F.lit(1)).alias("n"))


def account_articles(spark, sf):
    df = article_table(spark, sf, "doc_id", "candidates", "published_at").filter("published_at is not null")
    hit = df.filter(F.exists("candidates", lambda c: c["account"] == "Alder"))
    top = hit.orderBy(F.desc("published_at"), "doc_id").limit(200)
    mine = joins.struct_by_name(F.col("candidates"), "account", F.lit("Alder"))
    return top.select("doc_id", mine["matched_entity"].alias("matched_entity"), day("published_at"))


QUERIES = {
    "rolling_window_search": rolling_window_search, "archive_search": archive_search, "search_total": search_total, "date_range_search": date_range_search,
    "saved_filter_search": saved_filter_search, "fulltext_search": fulltext_search, "board_entities": board_entities,
    "token_search": token_search, "trigram_search": trigram_search, "trigram_scan": trigram_scan, "index_counts": index_counts, "array_filters": array_filters, "event_board": board_rows,
    "event_board_page": board_sorted_page, "board_people": board_people, "best_per_event": best_event_rows, "flags_join": flags_join,
    "semi_sources": semi_sources, "anti_ledger": anti_ledger, "detail_join": label_article_join, "order_page": order_page,
    "nested_children": supplier_parts, "saved_filters": saved_filter_specs, "view_splits": view_splits, "account_articles": account_articles,
}

_LIKE = lambda q: "(" + " OR ".join(f"contains(lower({c}), '{q}')" for c in ("title", "lang", "text", "source")) + ")"
_ART = f"WITH {DOCS_CTE}, art AS (SELECT *, (doc_id * 7919 % 1000) / 1000 AS confidence_score FROM d WHERE doc_id % 5 <> 0 AND doc_id % 50 <> 1)"
_IN365 = f"published_at >= {AS_OF_SQL} - INTERVAL 365 DAY AND published_at <= {AS_OF_SQL}"
_TRI = lambda t: f"""(SELECT doc_id, list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''),
    lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM d)"""
_EV = f"WITH {DOCS_CTE}, {GATE_CTE}, {CANDIDATE_CTE}"
_BOARD = f"""WITH {DOCS_CTE}, {_REL_CTE}, b AS (
  SELECT *, coalesce(CASE WHEN doc_id % 4 <> 0 THEN 'ev-' || (doc_id % 97) END, md5(text)) AS event_identity,
    CASE WHEN country IS NOT NULL THEN 0 ELSE 1 END AS overseas_rank,
    CASE reliability_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rel_rank,
    CASE WHEN doc_id % 9 <> 0 THEN score WHEN len(industries) > 0 AND country IS NOT NULL THEN 70 WHEN len(industries) > 0 THEN 55 ELSE 0 END AS board_score
  FROM a)"""
_RANK = lambda s: f"row_number() OVER (PARTITION BY event_identity ORDER BY rel_rank DESC, source_type = 'official' DESC, {s} DESC, coalesce(published_at, fetched_at) DESC, doc_id)"
_BANDSQL = lambda s: f"CASE WHEN {s} >= 70 THEN 'high' WHEN {s} >= 50 THEN 'medium' WHEN {s} >= 30 THEN 'low' END"

ORACLE = {
    "rolling_window_search": f"""{_ART} SELECT doc_id, title, strftime(published_at, '%Y-%m-%d') AS published_at FROM art WHERE {_IN365} AND {_LIKE('antion')}
        ORDER BY coalesce(art.published_at, fetched_at) DESC, doc_id LIMIT 50""",
    "archive_search": f"""{_ART} SELECT doc_id, strftime(published_at, '%Y-%m-%d') AS published_at FROM art WHERE (published_at IS NULL OR published_at <= {AS_OF_SQL}) AND {_LIKE('inging')}
        ORDER BY coalesce(art.published_at, fetched_at), doc_id LIMIT 20 OFFSET 20""",
    "search_total": f"{_ART} SELECT count(*) AS total FROM art WHERE {_IN365} AND reliability_level = 'high' AND {_LIKE('retion')}",
    "date_range_search": f"""{_ART} SELECT doc_id, strftime(published_at, '%Y-%m-%d') AS published_at, confidence_score FROM art WHERE published_at >= TIMESTAMP '2024-03-01' AND published_at < TIMESTAMP '2024-06-01'
        AND source_type = 'official' AND fetched_at >= TIMESTAMP '2024-03-10' ORDER BY confidence_score DESC, doc_id LIMIT 100""",
    "saved_filter_search": f"""{_ART} SELECT doc_id, strftime(published_at, '%Y-%m-%d') AS published_at FROM art WHERE published_at >= TIMESTAMP '2024-06-01' AND published_at <= {AS_OF_SQL}
        AND source_type = 'media' AND {_LIKE('antion')}""",
    "fulltext_search": f"""{_ART}, q AS (SELECT list_distinct(flatten(list_transform(['thing', 'on', 'the', 'retion'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS qg),
        s AS (SELECT doc_id, len(list_intersect(g, qg)) / len(list_distinct(list_concat(g, qg))) AS similarity FROM {_TRI('title')}, q)
        SELECT doc_id FROM art LEFT JOIN s USING (doc_id) WHERE (published_at IS NULL OR published_at <= {AS_OF_SQL})
          AND (list_has_all(string_split_regex(lower(concat_ws(' ', title, lang, text)), '[^\\p{{L}}\\p{{N}}_]+'), ['thing', 'on', 'the', 'retion']) OR similarity > 0.2)""",
    "board_entities": f"""{_BOARD}, f AS (SELECT * FROM b WHERE {_IN365} AND (source IN ('src3', 'src7') OR contains(lower(entity_id), 'unit-1') OR contains(lower(entity_id), 'unit-3')) AND board_score >= 30),
        r AS (SELECT *, {_RANK('board_score')} AS rn FROM f)
        SELECT doc_id, CAST(board_score AS BIGINT) AS board_score, CAST(overseas_rank AS BIGINT) AS overseas_rank FROM r WHERE rn = 1
        ORDER BY r.overseas_rank, coalesce(published_at, fetched_at) DESC, r.board_score DESC, doc_id LIMIT 50""",
    "token_search": """SELECT doc_id FROM documents WHERE list_has_all(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), ['the', 'antion'])""",
    "trigram_search": f"""WITH {DOCS_CTE}, q AS (SELECT list_distinct(flatten(list_transform(['thing', 'on', 'the', 'retion'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS qg),
        s AS (SELECT doc_id, round(len(list_intersect(g, qg)) / len(list_distinct(list_concat(g, qg))), 6) AS similarity FROM {_TRI('title')}, q)
        SELECT doc_id, similarity FROM s WHERE similarity > 0.2""",
    "trigram_scan": f"""WITH {DOCS_CTE}, q AS (SELECT list_distinct(flatten(list_transform(['thing', 'on', 'the', 'retion'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS qg),
        s AS (SELECT doc_id, round(len(list_intersect(g, qg)) / len(list_distinct(list_concat(g, qg))), 6) AS similarity FROM {_TRI('title')}, q)
        SELECT doc_id, similarity FROM s WHERE similarity > 0.2""",
    "index_counts": f"""{_ART.split(', art AS')[0]}, b AS (SELECT doc_id, 1 AS n, concat_ws(' ', CASE WHEN doc_id % 5 = 0 THEN reverse(title) ELSE title END, lang, text) AS body FROM d WHERE doc_id % 2 = 0 OR doc_id % 5 = 0
          UNION ALL SELECT doc_id, 2, concat_ws(' ', title, lang, text) FROM d WHERE doc_id % 2 = 1 OR doc_id % 5 = 0),
        t AS (SELECT n, doc_id, unnest(list_distinct(string_split_regex(lower(body), '[^\\p{{L}}\\p{{N}}_]+'))) AS term FROM b)
        SELECT term, count(*) AS documents FROM t WHERE term <> '' GROUP BY 1""",
    "array_filters": f"""{_EV}, k AS (SELECT doc_id FROM c GROUP BY 1 HAVING bool_or(contains(lower(account), 'ald')))
        SELECT doc_id, 'filters' AS kind FROM g JOIN k USING (doc_id) WHERE len(list_filter(labels, lambda x: contains(lower(x), 'rai'))) > 0
        UNION ALL SELECT doc_id, 'family' FROM g WHERE list_has_any(labels, ['company', 'leader'])""",
    "event_board": f"""{_BOARD}, f AS (SELECT * FROM b WHERE {_IN365} AND (CAST(substr(source, 4) AS INTEGER) < 12 OR len(list_filter(topics, lambda x: contains(x, 'account'))) > 0) AND board_score >= 30),
        r AS (SELECT *, {_RANK('board_score')} AS rn FROM f)
        SELECT doc_id, event_identity, CAST(board_score AS BIGINT) AS board_score, {_BANDSQL('board_score')} AS band, CASE WHEN overseas_rank = 0 THEN 'overseas' ELSE 'domestic' END AS location_scope FROM r WHERE rn = 1""",
    "event_board_page": f"""{_BOARD}, f AS (SELECT * FROM b WHERE {_IN365} AND len(list_filter(event_types, lambda x: contains(x, 'sign'))) > 0 AND board_score >= 30),
        r AS (SELECT *, {_RANK('board_score')} AS rn FROM f)
        SELECT doc_id, CAST(board_score AS BIGINT) AS board_score, CAST(overseas_rank AS BIGINT) AS overseas_rank FROM r WHERE rn = 1
        ORDER BY r.overseas_rank, r.board_score DESC, coalesce(published_at, fetched_at) DESC, doc_id LIMIT 25""",
    "board_people": f"""{_BOARD} SELECT doc_id, CAST(score AS BIGINT) AS relevance_score FROM b WHERE len(list_filter(leaders, lambda p: contains(p.name, 'er'))) > 0 AND score BETWEEN 50 AND 69""",
    "best_per_event": f"""{_BOARD}, r AS (SELECT *, {_RANK('score')} AS rn FROM b) SELECT doc_id, event_identity, CAST(score AS BIGINT) AS relevance_score FROM r WHERE rn = 1""",
    "flags_join": """SELECT d.doc_id AS article_id, coalesce(max(l.quality) = 1, FALSE) AS favorite, coalesce(max(l.toxic) = 1, FALSE) AS read
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.doc_id % 3 = 0 GROUP BY 1""",
    "semi_sources": "SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 50",
    "anti_ledger": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "detail_join": f"""WITH {DOCS_CTE} SELECT l.doc_id AS article_id, CAST(l.toxic AS BIGINT) AS toxic, d.title, strftime(published_at, '%Y-%m-%d') AS published_at
        FROM labels l JOIN d ON d.doc_id = l.doc_id WHERE l.quality = 1 AND reliability_level = 'high'""",
    "order_page": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS published_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 40",
    "nested_children": """WITH c AS (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) >= 90)
        SELECT s_suppkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey), '') AS parts FROM supplier LEFT JOIN c ON l_suppkey = s_suppkey GROUP BY 1""",
    "saved_filters": "SELECT n_nationkey, n_name AS country, CASE WHEN n_regionkey = 2 THEN 'high' END AS reliability, 'published_desc' AS sort FROM nation",
    "view_splits": f"""WITH {DOCS_CTE}, {GATE_CTE}, v AS (SELECT unnest(list_filter([CASE WHEN list_contains(labels, 'market_project') THEN 'market' END,
          CASE WHEN list_has_any(labels, ['tax_policy', 'foreign_access']) THEN 'policy' END, CASE WHEN list_contains(labels, 'competitor') THEN 'competitor' END,
          CASE WHEN list_contains(labels, 'chamber') THEN 'chamber' END, CASE WHEN doc_id % 3 = 0 THEN 'review' END], lambda x: x IS NOT NULL)) AS view FROM g)
        SELECT view, count(*) AS n FROM v GROUP BY 1""",
    "account_articles": f"""{_EV} SELECT doc_id, matched_entity, strftime(published_at, '%Y-%m-%d') AS published_at FROM c JOIN d USING (doc_id) WHERE account = 'Alder' AND d.published_at IS NOT NULL
        ORDER BY d.published_at DESC, doc_id LIMIT 200""",
}
