"""Entities, imports and reviews."""

import uuid

from pyspark.sql import functions as F

from newsloom.operators import entities, reviews
from newsloom.plans.showcase.base import TITLE_SQL, docs, once, table
from newsloom.session import checkpoint_root
from newsloom.sources import imports

num = lambda c: F.col(c).cast("bigint").alias(c)
_FIELDS = ["entity_id", "canonical_name", "short_name", "aliases", "parent_entity_id", "official_url", "verification_status"]


def _master(spark, sf):
    """Suppliers as organisation master; every tenth shares an alias with its neighbour."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    raw = s.select(
        F.concat(F.lit("org-"), k.cast("string")).alias("entity_id"), F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("canonical_name"),
        F.concat(F.lit("S"), k.cast("string")).alias("short_name"),
        F.array(F.concat(F.lit("Works (No) "), k.cast("string")), F.when(k % 10 < 2, F.concat(F.lit("Shared-"), F.floor(k / 10).cast("string"))).otherwise("  ")).alias("aliases"),
        F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("parent_entity_id"), F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example.org")).alias("official_url"),
        F.when(k % 3 == 0, "renamed").when(k % 3 == 1, "verified").otherwise("pending").alias("verification_status"),
    )
    return entities.load_master(raw, _FIELDS)


def entity_resolution(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("SUPPLIER#"), F.lpad(k.cast("string"), 9, "0"))).when(k % 4 == 1, F.concat(F.lit("works no "), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("shared "), k.cast("string"))).otherwise(F.col("c_name"))
    out = entities.resolve_names(c.select("c_custkey", name.alias("name")), "name", _master(spark, sf), "c_custkey")
    return out.select("c_custkey", "entity_id")


def _found(spark, sf):
    s = table(spark, sf, "supplier").filter("s_suppkey % 5 <> 2")
    k = F.col("s_suppkey")
    return s.select(
        F.when(k % 5 == 3, F.concat(F.lit("Newcomer Works "), k.cast("string"))).otherwise(F.col("s_name")).alias("canonical_name"),
        F.when(k % 4 == 1, F.concat(F.lit("https://new"), k.cast("string"), F.lit(".example.org"))).when(k % 4 == 2, F.lit(None)).otherwise(F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example.org"))).alias("official_url"),
    )


def reconcile_entities(spark, sf):
    return entities.reconcile(_found(spark, sf), _master(spark, sf))


def reconcile_counts(spark, sf):
    out = entities.reconcile_counts(entities.reconcile(_found(spark, sf), _master(spark, sf)))
    return out.select(*[num(c) for c in out.columns])


def hierarchy(spark, sf):
    """Supplier, nation and region as one hierarchy, two levels up."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent_entity_id"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_entity_id"))
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("entity_id"), F.lit(None).cast("string").alias("parent_entity_id"))
    return entities.with_parent(s.unionByName(n).unionByName(r), 2).select("entity_id", "ancestor_1", "ancestor_2")


def upsert_entities(spark, sf):
    m = _master(spark, sf).select("entity_id", "canonical_name", "official_url")
    k = F.substring("entity_id", 5, 12).cast("int")
    inc = m.filter(k % 3 == 0).select(F.when(k % 2 == 0, F.col("entity_id")).otherwise(F.concat(F.lit("new-"), "entity_id")).alias("entity_id"), F.upper("canonical_name").alias("canonical_name"), F.lit("https://updated.example.org").alias("official_url"))
    return entities.upsert_master(m, inc)


def account_alias_rows(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = n.groupBy(F.col("r_name").alias("account")).agg(F.collect_list(F.regexp_replace("n_name", "NATION_", "N")).alias("entities"))
    m = m.withColumn("entities", F.concat("entities", F.array("account")))
    return entities.account_aliases(m, ("N3", "N4"), ("N5",), ("N7",))


def secret_scan(spark, sf):
    """Documents (as export rows) with a secret; a planted field makes some sources hit."""
    d = docs(spark, sf)
    body = F.when(F.col("doc_id") % 29 == 3, F.concat("text", F.lit(' cookie: a=b'))).when(F.col("doc_id") % 31 == 4, F.concat("text", F.lit(" https://x.example.org/?id=1&Pass-Ticket=9"))).otherwise(F.col("text"))
    rows = d.select("doc_id", "source", "lang", body.alias("body"))
    return rows.select("doc_id", imports.has_secret(F.col("body"), json_keys=False).alias("secret")).filter("secret")


def rejected_sources(spark, sf):
    d = docs(spark, sf)
    rows = d.select(F.concat_ws("/", "source", "lang", (F.col("doc_id") % 7).cast("string")).alias("file"), F.when(F.col("doc_id") % 29 == 3, F.concat("text", F.lit(' cookie: a=b'))).otherwise(F.col("text")).alias("body"))
    return imports.rejected_files(rows, "file", "body")


def _export_row():
    """One document as an export row, under different field names."""
    k = F.col("doc_id")
    return F.create_map(
        F.when(k % 3 == 0, "title").when(k % 3 == 1, "msg_title").otherwise("name"), F.when(k % 13 == 5, "  ").otherwise(F.col("title")),
        F.when(k % 2 == 0, "link").otherwise("content_url"), F.concat(F.when(k % 7 == 2, "https://other.example.net/").otherwise("http://Posts.example.org/s/"), k.cast("string")),
        F.when(k % 5 == 0, "digest").otherwise("body"), F.col("text"),
        F.lit("publish_time"), F.when(k % 4 == 0, F.unix_seconds("fetched_at").cast("string")).otherwise(F.date_format("fetched_at", "yyyy/MM/dd HH:mm:ss")),
        F.lit("account_name"), F.col("source"), F.lit("doc"), k.cast("string"),
    )


def _export_file():
    """Export file of a document: its source and the thousand ids it lies in, so no file has more records."""
    return F.concat_ws("-", "source", F.floor(F.col("doc_id") / 1000).cast("string"))


def _export_rows(spark, sf):
    """Export files of whole texts: a bare list, an envelope or a single-key map of rows, by source."""
    lines = F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("k"), F.to_json(_export_row()).alias("r"))))
    files = docs(spark, sf).groupBy("source", _export_file().alias("file")).agg(F.concat(F.lit("["), F.array_join(F.transform(lines, lambda x: x["r"]), ","), F.lit("]")).alias("rows"))
    no = F.substring("source", 4, 9).cast("int")
    body = F.when(no % 3 == 0, F.col("rows")).when(no % 3 == 1, F.concat(F.lit('{"items":'), "rows", F.lit("}"))).otherwise(F.concat(F.lit('{"version":1,"data":'), "rows", F.lit("}")))
    return files.select("file", F.octet_length(body).cast("bigint").alias("size"), body.alias("content"))


def import_files(spark, sf):
    """JSON and CSV exports read from disk: limits, secrets, good and bad rows of every file."""
    def build():
        path = f"{checkpoint_root(spark)}/newsloom/exports-{uuid.uuid4().hex}"
        d = docs(spark, sf).withColumn("file", _export_file())
        d = d.withColumn("text", F.when(F.col("doc_id") % 397 == 8, F.concat("text", F.lit(" pass_ticket=1"))).otherwise(F.col("text")))
        by_id = lambda x, y: F.when(x["doc_id"] < y["doc_id"], -1).when(x["doc_id"] > y["doc_id"], 1).otherwise(0)
        rows = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", _export_row().alias("r"))), by_id), lambda x: x["r"])
        d.groupBy("file").agg(rows.alias("articles")).write.partitionBy("file").json(f"{path}/json")
        flat = d.select("file", "doc_id", F.col("title").alias("article_title"), F.concat(F.lit("http://Posts.example.org/s/"), F.col("doc_id").cast("string")).alias("url"), F.regexp_replace("text", r"[\r\n]+", " ").alias("content"))
        flat.filter("doc_id % 4 = 1").repartition("file").sortWithinPartitions("file", "doc_id").drop("doc_id").write.partitionBy("file").option("header", True).option("escape", '"').csv(f"{path}/csv")
        return path

    path, found = once(spark, sf, "exports", build), []
    short = F.regexp_extract("file", "file=([^/]+)/", 1).alias("file")
    for kind in ("json", "csv"):
        files = imports.read_exports(spark, f"{path}/{kind}/*", kind)
        rows = imports.json_rows(files) if kind == "json" else imports.csv_rows(spark, f"{path}/{kind}/*")
        rows, refused = imports.accepted(rows, files)
        _, _, counts = imports.normalize_rows(rows, ("posts.example.org",))
        out = counts.join(refused, "file", "full").select(F.lit(kind).alias("kind"), short, "total_count", "missing_body_count", "invalid_count", "reason")
        found.append(out)
    return found[0].unionByName(found[1])


def import_split(spark, sf):
    good, _, _ = imports.normalize_rows(imports.json_rows(_export_rows(spark, sf)), ("posts.example.org",))
    return good.select("file", num("row_number"), "title", "original_url", "content_text", "summary", "author", "source_name", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


def import_errors(spark, sf):
    _, bad, _ = imports.normalize_rows(imports.json_rows(_export_rows(spark, sf)), ("posts.example.org",))
    return bad.select("file", num("row_number"), "reason")


def import_counts(spark, sf):
    _, _, counts = imports.normalize_rows(imports.json_rows(_export_rows(spark, sf)), ("posts.example.org",))
    return counts


def import_accounting(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 40).alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "new").when(F.col("o_orderstatus") == "O", "duplicate").otherwise("skipped").alias("outcome"), F.col("o_orderkey").alias("k"))
    return imports.batch_accounting(o.filter("batch_id > 3 or outcome <> 'skipped'"), o.filter("k % 100 = 17"))


def import_replay(spark, sf):
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    ledger = o.filter("o_orderkey % 3 <> 0").select(
        (F.col("o_custkey") % 20).alias("requested_by"), F.sha2(F.date_format(day, "yyyy-MM"), 256).alias("file_sha256"), F.col("o_orderpriority").alias("source_name"),
        F.when(F.col("o_orderstatus") == "P", "processing").otherwise("completed").alias("status"), day.alias("created_at"), F.col("o_orderkey").alias("batch_id"),
    )
    req = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 20).alias("requested_by"), F.sha2(F.date_format(day, "yyyy-MM"), 256).alias("file_sha256"), F.col("o_orderpriority").alias("source_name"))
    return imports.replayed(req, ledger).select("k", "earlier_batch_id", "replayed")


def _log(spark, sf):
    lab = table(spark, sf, "labels")
    base = F.lit("2024-01-01").cast("timestamp")
    one = lab.select(F.col("doc_id").cast("bigint").alias("article_id"), F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "approve").otherwise("needs_changes").alias("action"), F.lit(1).alias("n"))
    two = lab.filter("doc_id % 6 = 0").select(F.col("doc_id").cast("bigint").alias("article_id"), F.lit("needs_changes").alias("action"), F.lit(2).alias("n"))
    return one.unionByName(two).withColumns({"review_id": F.col("article_id") * 10 + F.col("n"), "created_at": base + F.make_dt_interval(F.lit(0), F.col("n"))})


def review_state(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("article_id"), F.lit("pending").alias("review_status"))
    out = reviews.fold_reviews(d, _log(spark, sf), "article_id", reviews.ARTICLE_STATES, "review_status")
    return out.groupBy("review_status").agg(F.count(F.lit(1)).alias("n"))


def review_history(spark, sf):
    return reviews.review_history(_log(spark, sf), "article_id", reviews.ARTICLE_STATES).select("review_id", "before_state", "after_state")


def audit_tail(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("audit_id"), F.col("ts").cast("timestamp").alias("created_at"), "event_type")
    return reviews.audit_tail(e, 100).select("audit_id", "event_type")


QUERIES = {
    "entity_resolution": entity_resolution, "reconcile_entities": reconcile_entities, "reconcile_counts": reconcile_counts, "hierarchy": hierarchy, "upsert_entities": upsert_entities,
    "account_aliases": account_alias_rows, "secret_scan": secret_scan, "rejected_files": rejected_sources, "import_split": import_split, "import_files": import_files, "import_errors": import_errors,
    "import_counts": import_counts, "import_accounting": import_accounting, "import_replay": import_replay, "review_state": review_state, "review_history": review_history, "audit_tail": audit_tail,
}

_FOUND = """f AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 3 THEN 'Newcomer Works ' || s_suppkey ELSE s_name END AS name,
  CASE s_suppkey % 4 WHEN 1 THEN 'https://new' || s_suppkey || '.example.org' WHEN 2 THEN NULL ELSE 'https://s' || s_suppkey || '.example.org' END AS url FROM supplier WHERE s_suppkey % 5 <> 2),
rec AS (SELECT CASE WHEN k % 5 = 3 THEN 'discovered-' || substr(sha256(name), 1, 16) ELSE 'org-' || k END AS entity_id, name AS canonical_name,
    CASE WHEN k % 5 = 3 THEN url ELSE coalesce(url, 'https://s' || k || '.example.org') END AS official_url, CASE WHEN k % 5 = 3 THEN 'new_pending' WHEN k % 4 = 1 THEN 'url_changed' ELSE 'matched' END AS status FROM f
  UNION ALL SELECT 'org-' || s_suppkey, s_name, 'https://s' || s_suppkey || '.example.org', CASE WHEN s_suppkey % 3 < 2 THEN 'missing' ELSE 'unlisted' END FROM supplier WHERE s_suppkey % 5 IN (2, 3))"""
_SECRET = r"'(?i)(?:^|[\s,;?&])(?:uin|pass_ticket|appmsg_token|wxtoken|cookie|credentials?|private_?key)\s*[:=]'"
_EXP = f"""x AS (SELECT doc_id, trim(coalesce(text, '')) AS body, source, source || '-' || (doc_id // 1000) AS file, CASE WHEN doc_id % 13 = 5 THEN '' ELSE trim(coalesce({TITLE_SQL}, '')) END AS title,
  row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS row_number, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 AS INTEGER)) + INTERVAL 6 HOUR AS ats FROM documents),
y AS (SELECT *, CASE WHEN title = '' THEN 'missing title' WHEN doc_id % 7 = 2 THEN 'address host is not allowed' END AS reason FROM x)"""
_LOG = """lg AS (SELECT doc_id * 10 + 1 AS review_id, doc_id AS article_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'needs_changes' END AS st FROM labels
  UNION ALL SELECT doc_id * 10 + 2, doc_id, 'needs_changes' FROM labels WHERE doc_id % 6 = 0)"""

ORACLE = {
    "entity_resolution": """WITH n AS (SELECT count(*) AS c FROM supplier) SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey < c THEN 'org-' || c_custkey WHEN c_custkey % 4 = 1 AND c_custkey < c THEN 'org-' || c_custkey
        WHEN c_custkey % 4 = 2 AND c_custkey * 10 + 1 = c THEN 'org-' || (c_custkey * 10) END AS entity_id FROM customer, n""",
    "reconcile_entities": f"WITH {_FOUND} SELECT * FROM rec",
    "reconcile_counts": f"""WITH {_FOUND} SELECT count(*) FILTER (status IN ('matched', 'url_changed')) AS matched, count(*) FILTER (status = 'new_pending') AS new_pending,
        count(*) FILTER (status = 'url_changed') AS url_changes, count(*) FILTER (status = 'missing') AS missing_from_page FROM rec""",
    "hierarchy": """SELECT 's' || s_suppkey AS entity_id, 'n' || s_nationkey AS ancestor_1, 'r' || n_regionkey AS ancestor_2 FROM supplier JOIN nation ON n_nationkey = s_nationkey
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, NULL FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, NULL FROM region""",
    "upsert_entities": """SELECT CASE WHEN s_suppkey % 6 = 3 THEN 'new-org-' || s_suppkey ELSE 'org-' || s_suppkey END AS entity_id, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS canonical_name,
        CASE WHEN s_suppkey % 3 = 0 THEN 'https://updated.example.org' ELSE 'https://s' || s_suppkey || '.example.org' END AS official_url FROM supplier""",
    "account_aliases": """WITH a AS (SELECT DISTINCT r_name AS account, replace(n_name, 'NATION_', 'N') AS alias FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, r_name FROM region)
        SELECT account, alias, CASE WHEN alias IN ('N3', 'N4') THEN 'weak' WHEN alias = 'N5' OR length(alias) >= 6 THEN 'strong' ELSE 'medium' END AS alias_strength, alias = 'N7' AS is_ambiguous FROM a""",
    "secret_scan": f"""SELECT doc_id, TRUE AS secret FROM documents WHERE doc_id % 29 = 3 OR doc_id % 31 = 4 OR regexp_matches(text, {_SECRET}) OR contains(lower(text), '-----begin private key-----') OR contains(replace(lower(text), ' ', '_'), 'begin_private_key')""",
    "rejected_files": f"""SELECT DISTINCT source || '/' || lang || '/' || (doc_id % 7) AS file FROM documents WHERE doc_id % 29 = 3 OR regexp_matches(text, {_SECRET}) OR contains(lower(text), '-----begin private key-----') OR contains(replace(lower(text), ' ', '_'), 'begin_private_key')""",
    "import_split": f"""WITH {_EXP} SELECT file, row_number, title, 'http://Posts.example.org/s/' || doc_id AS original_url, CASE WHEN doc_id % 5 = 0 THEN '' ELSE body END AS content_text,
        CASE WHEN doc_id % 5 = 0 THEN body ELSE '' END AS summary, source AS author, source AS source_name, strftime(ats, '%Y-%m-%d %H:%M:%S') AS published_at FROM y WHERE reason IS NULL""",
    "import_errors": f"WITH {_EXP} SELECT file, row_number, reason FROM y WHERE reason IS NOT NULL",
    "import_counts": f"""WITH {_EXP} SELECT file, count(*) FILTER (reason IS NULL) AS total_count, count(*) FILTER (reason IS NULL AND (doc_id % 5 = 0 OR body = '')) AS missing_body_count,
        count(*) FILTER (reason IS NOT NULL) AS invalid_count FROM y GROUP BY 1""",
    "import_files": f"""WITH {_EXP}, raw AS (SELECT source || '-' || (doc_id // 1000) AS file, doc_id, doc_id % 397 = 8 OR regexp_matches(CAST(to_json(text) AS VARCHAR), {_SECRET}) OR contains(lower(text), '-----begin private key-----')
          OR contains(replace(lower(text), ' ', '_'), 'begin_private_key') AS secret FROM documents),
        hit AS (SELECT 'json' AS kind, file, bool_or(secret) AS secret FROM raw GROUP BY 2 UNION ALL SELECT 'csv', file, bool_or(secret) FROM raw WHERE doc_id % 4 = 1 GROUP BY 2),
        every AS (SELECT 'json' AS kind, file, reason, doc_id % 5 = 0 OR body = '' AS bare FROM y
          UNION ALL SELECT 'csv', file, CASE WHEN trim(coalesce(t, '')) = '' THEN 'missing title' END, trim(regexp_replace(body, '[\\r\\n]+', ' ', 'g')) = '' FROM (SELECT y.*, {TITLE_SQL.replace('text', 'd.text')} AS t FROM y JOIN documents d USING (doc_id)) WHERE doc_id % 4 = 1)
        SELECT kind, file, CASE WHEN NOT secret THEN count(*) FILTER (reason IS NULL) END AS total_count, CASE WHEN NOT secret THEN count(*) FILTER (reason IS NULL AND bare) END AS missing_body_count,
          CASE WHEN NOT secret THEN count(*) FILTER (reason IS NOT NULL) END AS invalid_count, CASE WHEN secret THEN 'secret material' END AS reason
        FROM every JOIN hit USING (kind, file) GROUP BY kind, file, secret""",
    "import_accounting": """WITH o AS (SELECT o_orderkey % 40 AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'new' WHEN 'O' THEN 'duplicate' ELSE 'skipped' END AS outcome, o_orderkey AS k FROM orders),
        e AS (SELECT batch_id, outcome FROM o WHERE batch_id > 3 OR outcome <> 'skipped' UNION ALL SELECT batch_id, 'invalid' FROM o WHERE k % 100 = 17)
        SELECT batch_id, count(*) FILTER (outcome <> 'invalid') AS total_count, count(*) FILTER (outcome = 'new') AS success_count, count(*) FILTER (outcome = 'duplicate') AS duplicate_count,
          count(*) FILTER (outcome IN ('skipped', 'invalid')) AS failure_count, CASE WHEN count(*) FILTER (outcome IN ('skipped', 'invalid')) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM e GROUP BY 1""",
    "import_replay": """WITH l AS (SELECT o_custkey % 20 AS r, strftime(o_orderdate, '%Y-%m') AS m, o_orderpriority AS p, arg_min(o_orderkey, struct_pack(a := -epoch_us(o_orderdate), b := o_orderkey)) AS b
          FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'P' GROUP BY 1, 2, 3)
        SELECT o_orderkey AS k, b AS earlier_batch_id, b IS NOT NULL AS replayed FROM orders LEFT JOIN l ON r = o_custkey % 20 AND m = strftime(o_orderdate, '%Y-%m') AND p = o_orderpriority WHERE o_orderkey % 3 = 0""",
    "review_state": f"""WITH {_LOG}, s AS (SELECT article_id, arg_max(st, review_id) AS st FROM lg GROUP BY 1)
        SELECT coalesce(st, 'pending') AS review_status, count(*) AS n FROM documents LEFT JOIN s ON article_id = doc_id GROUP BY 1""",
    "review_history": f"WITH {_LOG} SELECT review_id, coalesce(lag(st) OVER (PARTITION BY article_id ORDER BY review_id), 'pending') AS before_state, st AS after_state FROM lg",
    "audit_tail": "SELECT event_id AS audit_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
}
