"""Checked import of article exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.dates import parse_export_date
from newsloom.functions.urls import host, url_part
from newsloom.skew import first_per_key

# Limits, accepted field names and what counts as a secret.
MAX_BYTES, MAX_RECORDS = 5_000_000, 1000
ENVELOPES = ("articles", "items", "list", "data")
ALIASES = {
    "title": ("title", "name", "article_title", "msg_title"),
    "original_url": ("original_url", "url", "link", "content_url"),
    "content_text": ("content_text", "content", "body", "article_content"),
    "summary": ("summary", "digest", "description", "excerpt"),
    "published_at": ("published_at", "publish_at", "publish_time", "datetime", "date"),
    "author": ("author", "writer", "account_name"),
    "source_name": ("source_name", "account_name", "nickname", "publisher"),
}
SECRET_KEYS = (
    "uin", "key", "pass_ticket", "appmsg_token", "wxtoken", "cookie", "cookies", "credential", "credentials",
    "private_key", "privatekey",
)
SECRET_TEXT = r"(?i)(?:^|[\s,;?&])(?:uin|pass_ticket|appmsg_token|wxtoken|cookie|credentials?|private_?key)\s*[:=]"
KEY_HEADER = "-----begin private key-----"
# A character class only: an alternation inside a loop overflows the Java stack on long texts.
JSON_KEY = r'"([^"\\\n]{1,200})"\s*:'
REASON_TITLE, REASON_URL = "missing title", "address host is not allowed"
_ROW = T.MapType(T.StringType(), T.StringType())


def read_exports(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A1: one row per export file: ``file``, ``size``, ``file_sha256``, ``content`` (byte-order mark removed).

    The size limit is tested on file metadata, before any content is read.
    """
    if kind not in ("json", "csv"):
        raise ValueError("only JSON and CSV exports are supported")
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path)
        .select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("content").alias("_raw"))
    )
    small = F.col("size") <= MAX_BYTES
    text = F.when(small, F.col("_raw").cast("string"))
    return files.select("file", "size", F.sha2(text, 256).alias("file_sha256"), F.regexp_replace(text, "^﻿+", "").alias("content"))


def json_rows(files: DataFrame) -> DataFrame:
    """A2: article objects of each file: a list, an envelope list, or one object."""
    body = F.col("content")

    def objects(text: Column) -> Column:
        """Object elements of a JSON list; other elements are skipped, text that is no list gives null."""
        parts = F.from_json(text, T.ArrayType(T.StringType()))
        return F.transform(F.filter(parts, lambda x: F.ltrim(x).startswith("{")), lambda x: F.from_json(x, _ROW))

    as_list = objects(body)
    envelope = F.coalesce(*[objects(F.get_json_object(body, f"$.{k}")) for k in ENVELOPES])
    single = F.from_json(body, _ROW)
    known = F.exists(F.map_keys(single), lambda k: k.isin("title", "url", "link", "content_text"))
    rows = F.when(F.ltrim(body).startswith("["), as_list).otherwise(F.coalesce(envelope, F.when(known, F.array(single))))
    kept = F.filter(rows, lambda r: r.isNotNull())
    # Before a plain explode Spark tests for rows first, for which it reads the JSON again.
    found = files.select(*[c for c in files.columns if c != "content"], F.posexplode_outer(kept).alias("_i", "row"))
    return found.filter("_i is not null").withColumn("row_number", F.col("_i") + 1).drop("_i")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A1: rows of CSV files with a header, as maps, numbered from 1 inside each file."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [(c, c.lstrip("﻿")) for c in raw.columns]
    pairs = F.create_map(*[x for c, n in names for x in (F.lit(n), F.col(f"`{c}`"))])
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), pairs.alias("row"), F.monotonically_increasing_id().alias("_i"))
    first = rows.groupBy("file").agg(F.min("_i").alias("_0"))
    # One multi-line CSV file is read by one task, so ids inside a file are consecutive.
    return rows.join(first, "file").withColumn("row_number", (F.col("_i") - F.col("_0") + 1).cast("int")).drop("_i", "_0")


def first_text(row: Column, names: Sequence[str]) -> Column:
    """A3: first non-blank value among alias names, else an empty string."""
    return F.coalesce(*[F.nullif(F.trim(F.element_at(row, n)), F.lit("")) for n in names], F.lit(""))


def normalized_key(c: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))


def has_secret(text: Column, json_keys: bool = True) -> Column:
    """A5: secret field names, secret assignments, key headers or secret address parameters in a whole text."""
    low = F.lower(text)
    hit = low.contains(KEY_HEADER) | F.replace(low, F.lit(" "), F.lit("_")).contains("begin_private_key") | text.rlike(SECRET_TEXT)
    params = F.regexp_extract_all(text, F.lit(r"(?i)https?://[^\s\"']*"), F.lit(0))
    names = F.flatten(F.transform(params, lambda u: F.transform(
        F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p: normalized_key(F.substring_index(p, "=", 1))
    )))
    hit = hit | F.exists(names, lambda n: n.isin(*SECRET_KEYS))
    if json_keys:
        keys = F.transform(F.regexp_extract_all(text, F.lit(JSON_KEY), F.lit(1)), normalized_key)
        hit = hit | F.exists(keys, lambda k: k.isin(*SECRET_KEYS) | k.contains("private_key"))
    return F.coalesce(hit, F.lit(False))


def secret_field(row: Column) -> Column:
    """A5: a secret field name among the decoded keys of one export row."""
    keys = F.transform(F.map_keys(row), lambda k: normalized_key(k))
    return F.coalesce(F.exists(keys, lambda k: k.isin(*SECRET_KEYS) | k.contains("private_key")), F.lit(False))


def rejected_files(rows: DataFrame, file: str, text: str) -> DataFrame:
    """A5: files with at least one hit; one hit rejects the whole file."""
    return rows.filter(has_secret(F.col(text))).select(file).distinct()


def accepted(rows: DataFrame, files: DataFrame, max_records: int = MAX_RECORDS) -> tuple[DataFrame, DataFrame]:
    """A1, A5: rows of files without secrets and inside the limits, and the refused files with a reason."""
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.bool_or(secret_field(F.col("row"))).alias("named"))
    checked = files.join(counts, "file", "left").withColumn(
        "reason",
        F.when(F.col("size") > MAX_BYTES, "file too large")
        .when(has_secret(F.col("content")) | F.coalesce("named", F.lit(False)), "secret material")
        .when(F.col("n").isNull(), "no article list")
        .when(F.col("n") > max_records, "too many records"),
    )
    bad = checked.filter("reason is not null").select("file", "reason")
    return rows.join(bad.select("file"), "file", "left_anti"), bad


def normalize_rows(rows: DataFrame, allowed_hosts: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A4: good rows, bad rows with their 1-based number and reason, and per-file counts."""
    fields = {name: first_text(F.col("row"), keys) for name, keys in ALIASES.items()}
    out = rows.withColumns(fields)
    ok_url = F.lower(url_part(F.col("original_url"), 1)).isin("http", "https") & host(F.col("original_url")).isin(*allowed_hosts)
    reason = F.when(F.col("title") == "", REASON_TITLE).when(~ok_url, REASON_URL)
    out = out.withColumns({"reason": reason, "published_at": parse_export_date(F.nullif("published_at", F.lit("")))}).drop("row")
    good = out.filter("reason is null").drop("reason")
    bad = out.filter("reason is not null").select("file", "row_number", "reason")
    counts = out.groupBy("file").agg(
        F.count_if(F.col("reason").isNull()).alias("total_count"),
        F.count_if(F.col("reason").isNull() & (F.col("content_text") == "")).alias("missing_body_count"),
        F.count_if(F.col("reason").isNotNull()).alias("invalid_count"),
    )
    return good, bad, counts


def batch_accounting(outcomes: DataFrame, invalid: DataFrame, key: str = "batch_id") -> DataFrame:
    """Successes, duplicates, failures and the status of each import batch."""
    bad = invalid.select(key, F.lit("invalid").alias("outcome"))
    every = outcomes.select(key, "outcome").unionByName(bad)
    n = lambda *v: F.count_if(F.col("outcome").isin(*v))
    out = every.groupBy(key).agg(
        F.count_if(F.col("outcome") != "invalid").alias("total_count"), n("new").alias("success_count"),
        n("duplicate", "updated").alias("duplicate_count"), n("skipped", "invalid").alias("failure_count"),
    )
    return out.withColumn("status", F.when(F.col("failure_count") > 0, "completed_with_errors").otherwise("completed"))


def import_errors(outcomes: DataFrame, invalid: DataFrame, key: str = "batch_id") -> DataFrame:
    """Error list as rows (batch, row number, reason)."""
    failed = outcomes.filter(F.col("outcome") == "skipped").select(key, "row_number", F.concat(F.lit("import result: "), "outcome").alias("reason"))
    return invalid.select(key, "row_number", "reason").unionByName(failed)


def replayed(requests: DataFrame, ledger: DataFrame, keys: Sequence[str] = ("requested_by", "file_sha256", "source_name")) -> DataFrame:
    """Each request with the newest completed batch of the same requester, file and source."""
    done = ledger.filter(F.col("status").isin("completed", "completed_with_errors"))
    last = first_per_key(done, list(keys), [-F.unix_micros("created_at"), F.col("batch_id")], ["batch_id"])
    out = requests.join(last.withColumnRenamed("batch_id", "earlier_batch_id"), list(keys), "left")
    return out.withColumn("replayed", F.col("earlier_batch_id").isNotNull())
