"""Shared views of the test tables and the sample dictionaries.

The dictionaries are made-up words that occur in the synthetic prose; they stand in for the
rule tables a user supplies.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import cut_lineage
from newsloom.rules import Alias, EventRule, Gazetteer, RelevanceRules, alias_strength, rule_list

AS_OF = datetime(2025, 2, 4, tzinfo=timezone.utc)
AS_OF_SQL = "TIMESTAMP '2025-02-04'"

# Sample dictionaries.  Places: nation key and its spellings, in priority order.
PLACE_WORDS = (
    (3, ("onbleea", "thintion")), (7, ("edtion",)), (12, ("enlich", "enheit")), (15, ("ciónas", "ciónue")),
    (18, ("oument", "aiment")), (21, ("hetion", "nttion")), (4, ("onouor",)),
)
SIGNALS = ("tionha", "whtion", "erkeit", "ciónado", "queque", "Thing")
LABEL_WORDS = (
    ("rail", ("inging", "atshsh")), ("grid", ("thndly", "thrent")), ("storage", ("onlyhe",)),
    ("factory", ("reedes", "esndha", "erheit")), ("data_center", ("erreth", "thtionnt", "ciónga")),
    ("tax_policy", ("einlich", "eation")), ("foreign_access", ("estion",)), ("leader", ("hation", "queque")),
    ("company", ("ortion", "ciónos")), ("competitor", ("intion",)), ("chamber", ("ndtion", "enkeit")),
)
PROJECT_LABELS = ("rail", "grid", "storage", "factory", "data_center")
POLICY_LABELS = ("tax_policy", "foreign_access", "general_policy")
FALLBACKS = (("policy", "general_policy", POLICY_LABELS), ("competitor", "competitor", ("competitor",)))
ROLLUP = ("market_project", PROJECT_LABELS)
ACTION_WORDS = (
    ("award", ("antion",)), ("contract", ("retion", "ciónción")), ("construction", ("ingble",)), ("meeting", ("hation",)),
    ("appointment", ("ention",)),
)
PRODUCT_WORDS = ((("thindst", "inging"), ("switchgear", "relay")), (("reedes", "enheit"), ("drives",)), (("hation",), ("ups", "cooling", "relay")))
PRODUCT_DEFAULT = ("low voltage", "energy management")
ACCOUNT_WORDS = (
    ("Alder", ("thonea", "theron", "thly")), ("Birch", ("queque", "ement", "tion re")), ("Cedar", ("erkeit", "schung", "heit")),
    ("Doria", ("ciónco", "ado", "thonea")), ("Elm", ("onanshat", "thst", "ntreou")),
)
WEAK, STRONG = ("thly", "heit", "ado", "thst"), ("ement",)
COMPANY_CONTEXT, OVERSEAS_CONTEXT = ("tion", "ung"), ("thing", "licht", "asci")
ALIASES = tuple(Alias(a, w, alias_strength(w, WEAK, STRONG)) for a, ws in ACCOUNT_WORDS for w in ws)

RELEVANCE = RelevanceRules(
    entities=(("thonea", "unit-1"), ("theron", "unit-2"), ("erkeit", "unit-3"), ("queque", "unit-4"), ("thon", "unit-5")),
    places=tuple((w, f"NATION_{k}", f"AREA_{k % 5}") for k, ws in PLACE_WORDS for w in ws),
    party_patterns=(r"^(.{2,45}?) (?:and|und|et|la) ", r" of (.{2,45}?) (?:is|to|in|en) "),
    competitor_names=("onanshat", "ntreou", "ciónll"),
    known_parties=("thhent", "einlich"),
    own_names=("thonea",),
    party_strip=" .,",
    internal_terms=("tiwh", "heha", "oiai"),
    stale_terms=("ndstst", "ouele"),
    business_terms=("antion", "ciónción", "retion"),
    fresh_terms=("inging", "antion"),
    project_terms=("thintion", "ungen"),
    project_suffixes=("ntion", "keit"),
    project_delimiters=r",.;\n",
    generic_project_terms=("the ", "der "),
    contract_terms=("antion", "ciónción"),
    need_terms=("hation", "queque"),
    partner_terms=("ortion", "estion"),
    authority_terms=("erer", "elle"),
    stages=(("talks", ("hation",)), ("tender", ("antion",)), ("design", ("ndtion",)), ("plan", ("eation",))),
    firm_stages=("tender", "design"),
    industries=tuple((n, w) for n, w in LABEL_WORDS[:5]),
    key_industries=("data_center",),
    products=(("rail", ("relay", "switchgear")), ("grid", ("relay", "scada")), ("data_center", ("ups", "cooling"))),
    event_rules=(
        EventRule("state exchange", (("hation", "oument"), ("erer", "elle")), foreign=True, otherwise="client visit"),
        EventRule("executive meeting", (("hation",), ("thing", "ment")), or_terms=("thndly",)),
        EventRule("signing", (("antion", "retion"),)),
        EventRule("turnkey", (("RETION",), ("ortion", "antion")), upper=True),
        EventRule("planning", (("eation",),)),
        EventRule("company formed", (("estion",), ("tion", "ung"))),
    ),
    topics=(("account", ("thonea", "theron", "queque"), False), ("rival", ("INTION",), True), ("chamber", ("ndtion",), False)),
    leader_split=r"[.;\n]",
    leader_pattern=r"((?:the|of) [^.;\n]{2,70}?(?:ing|tion)) ([a-z]{2,4}) (?:of|to|in|on)",
    leader_terms=("ing ", "tion "),
    leader_reject=("the", "of"),
    senior_roles=("ing",),
    lead_roles=("tion",),
    unit_pattern=r"th(?:on|at|is)",
    departments=("ly", "ble", "nt"),
    manual_source_type="media",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles: whole text, title, derived dates, source attributes and address."""
    d = table(spark, sf_dir, "documents")
    no = F.substring("source", 4, 9).cast("int")
    kinds = F.array(*[F.lit(x) for x in ("official", "media", "procurement", "policy", "competitor")])
    levels = F.array(*[F.lit(x) for x in ("low", "medium", "high")])
    day = F.lit("2024-01-01").cast("timestamp")
    shown = F.when(F.col("doc_id") % 11 == 5, F.col("doc_id") - 4).otherwise(F.col("doc_id"))
    return d.select(
        "doc_id", "text", "lang", "source",
        F.regexp_extract(F.substring_index("text", "\n", 1), "^[^.!?|]*", 0).alias("title"),
        F.when(F.col("doc_id") % 37 != 0, day + F.make_dt_interval((F.col("doc_id") % 400).cast("int"))).alias("published_at"),
        (day + F.make_dt_interval((F.col("doc_id") % 400).cast("int"), F.lit(6))).alias("fetched_at"),
        F.get(kinds, no % 5).alias("source_type"),
        F.get(levels, no % 3).alias("reliability_level"),
        F.concat(F.lit("HTTPS://News.Example.org//item/"), shown.cast("string"), F.lit("/?utm_source="), "source", F.lit("#top")).alias("url"),
    )



def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored web pages."""
    return table(spark, sf_dir, "pages")


# The title is the first sentence of the first line.
TITLE_SQL = "regexp_extract(split_part(text, chr(10), 1), '^[^.!?|]*')"

DOCS_CTE = f"""
d AS (
  SELECT doc_id, text, lang, source,
         {TITLE_SQL} AS title,
         CASE WHEN doc_id % 37 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 AS INTEGER)) END AS published_at,
         TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 AS INTEGER)) + INTERVAL 6 HOUR AS fetched_at,
         ['official','media','procurement','policy','competitor'][CAST(substr(source, 4) AS INTEGER) % 5 + 1] AS source_type,
         ['low','medium','high'][CAST(substr(source, 4) AS INTEGER) % 3 + 1] AS reliability_level,
         'https://news.example.org/item/' || CAST(CASE WHEN doc_id % 11 = 5 THEN doc_id - 4 ELSE doc_id END AS VARCHAR) AS url_key,
         sha256(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]+', '', 'g'))) AS hash_key
  FROM documents
)"""


def places(spark: SparkSession, sf_dir: str) -> Gazetteer:
    """Gazetteer of the sample spellings: the rows of the nation and region tables that they name."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    spelled = n.filter(F.col("n_nationkey").isin([k for k, _ in PLACE_WORDS]))
    rows = spelled.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name").collect()
    names = {x.n_nationkey: (x.n_name, x.r_name) for x in rows}
    return Gazetteer(tuple((*names[k], words) for k, words in PLACE_WORDS), SIGNALS)


def labels_column(text, source_type):
    from newsloom.operators.tagging import intelligence_labels

    return intelligence_labels(text, rule_list(LABEL_WORDS), source_type, FALLBACKS, ROLLUP)


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]::VARCHAR[]"


def sql_any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {sql_str(t)})" for t in terms) + ")"


def sql_first(column: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(column, terms)} THEN {sql_str(label)}" for label, terms in rules) + " END"


# Country gate of a document: place key, name, region, evidence and score.
_PLACE_KEY = "CASE " + " ".join(f"WHEN {sql_any('low', words)} THEN {k}" for k, words in PLACE_WORDS) + " END"
_PLACE_WORDS = "CASE place_key " + " ".join(f"WHEN {k} THEN {sql_list(words)}" for k, words in PLACE_WORDS) + " ELSE []::VARCHAR[] END"
_LABELS = "list_filter([" + ", ".join(f"CASE WHEN {sql_any('low', words)} THEN {sql_str(label)} END" for label, words in LABEL_WORDS) + "], lambda x: x IS NOT NULL)"
GATE_CTE = f"""
g0 AS (SELECT *, lower(text) AS low FROM d),
g1 AS (SELECT *, {_PLACE_KEY} AS place_key FROM g0),
g2 AS (
  SELECT g1.*, n.n_name AS country, r.r_name AS region,
         list_filter(list_concat({_PLACE_WORDS}, {sql_list(SIGNALS)}), lambda a: contains(low, lower(a))) AS evidence,
         {_LABELS} AS base_labels
  FROM g1 LEFT JOIN nation n ON n.n_nationkey = place_key LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
),
g3 AS (
  SELECT *,
         least(0.99::DECIMAL(5,2), (CASE WHEN place_key IS NULL THEN 0 ELSE 0.48::DECIMAL(5,2) END + 0.14::DECIMAL(5,2) * least(len(evidence), 3))::DECIMAL(5,2)) AS gate_score,
         list_concat(base_labels,
           list_concat(CASE WHEN source_type = 'policy' AND NOT list_has_any(base_labels, {sql_list(POLICY_LABELS)}) THEN ['general_policy'] ELSE []::VARCHAR[] END,
                       CASE WHEN source_type = 'competitor' AND NOT list_contains(base_labels, 'competitor') THEN ['competitor'] ELSE []::VARCHAR[] END)) AS tagged
  FROM g2
),
g AS (
  SELECT * EXCLUDE (tagged),
         gate_score >= 0.55 AS is_overseas,
         list_concat(tagged, CASE WHEN list_has_any(tagged, {sql_list(PROJECT_LABELS)}) THEN ['market_project'] ELSE []::VARCHAR[] END) AS labels
  FROM g3
)"""


def _alias_sql() -> str:
    rows = []
    for i, a in enumerate(ALIASES):
        hit = f"contains(text, {sql_str(a.alias)})"
        if a.strength == "weak":
            long = "TRUE" if len(a.alias) >= 3 else sql_any("low", OVERSEAS_CONTEXT)
            hit += f" AND {sql_any('text', COMPANY_CONTEXT)} AND {long}"
        weight = {"strong": "0.78", "medium": "0.54", "weak": "0.24"}[a.strength]
        rows.append(f"CASE WHEN {hit} THEN struct_pack(account := {sql_str(a.account)}, alias := {sql_str(a.alias)}, w := {weight}::DECIMAL(10,2), pos := {i}) END")
    return "list_filter([" + ",\n".join(rows) + "], lambda x: x IS NOT NULL)"


# Account candidates: one row per (document, account).
CANDIDATE_CTE = f"""
h AS (SELECT doc_id, unnest({_alias_sql()}) AS a FROM (SELECT doc_id, text, lower(text) AS low FROM d)),
c AS (
  SELECT doc_id, a.account AS account, arg_min(a.alias, a.pos) AS matched_entity, least(0.98, CAST(sum(a.w) AS DECIMAL(10,2)))::DECIMAL(10,2) AS confidence,
         sum(a.w) < 0.65 AS needs_review, string_agg(a.alias, '|' ORDER BY a.pos) AS evidence
  FROM h GROUP BY 1, 2
)"""


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    from newsloom.operators.tagging import account_candidates

    return account_candidates(df, text, ALIASES, COMPANY_CONTEXT, OVERSEAS_CONTEXT)


_BUILT: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build):
    """What an ingest of the folder leaves behind: built by the first query that reads it, kept for the session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def tagged_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article table: documents with gate, labels, candidates and keys, the input of search, board and cascade."""
    return once(spark, sf_dir, "articles", lambda: cut_lineage(tag_documents(spark, sf_dir), "articles"))


def tag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, labels, candidates and keys of every document, as the ingest computes them."""
    from newsloom.functions.text import content_digest
    from newsloom.functions.urls import canonical_url
    from newsloom.operators.events import event_fingerprint
    from newsloom.operators.tagging import country_gate, first_label, top_confidence

    df = country_gate(docs(spark, sf_dir), "text", places(spark, sf_dir))
    df = with_candidates(df)
    df = df.withColumns({
        "labels": labels_column(F.col("text"), F.col("source_type")),
        "url_key": canonical_url(F.col("url")),
        "hash_key": content_digest(F.col("text"), F.lit("")),
    })
    key = event_fingerprint(
        F.col("title"), F.col("published_at"), F.col("country"), F.col("candidates"), F.col("labels"), PROJECT_LABELS,
        first_label(F.col("title"), rule_list(ACTION_WORDS)),
    )
    return df.withColumns({"event_key": key, "confidence": F.least(F.lit(0.98), F.greatest("overseas_confidence", top_confidence(F.col("candidates"))))})


def article_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the article table.

    Tags are computed once at ingest; queries filter and aggregate the stored columns.
    """
    return tagged_docs(spark, sf_dir).select(*columns)


MONEY_SQL = "(?:usd|eur|rmb|cny|sar|aed|美元|欧元|人民币)?\\s*\\d+(?:[.,]\\d+)?\\s*(?:亿|万|million|billion)?"
_ACTION = sql_first("lower(title)", ACTION_WORDS)
EVENT_CTE = f"""
cg AS (
  SELECT doc_id, string_agg(account, ',' ORDER BY account) FILTER (confidence >= 0.5) AS accounts, max(confidence) AS top_conf,
         arg_min(matched_entity, struct_pack(c := -confidence, n := account)) AS top_entity FROM c GROUP BY 1
),
e0 AS (
  SELECT g.*, coalesce(cg.accounts, '') AS accounts, coalesce(cg.top_conf, 0.35)::DOUBLE AS top_conf, cg.top_entity,
         array_to_string(list_sort(list_filter(g.labels, lambda x: list_contains({sql_list(PROJECT_LABELS)}, x))), ',') AS ptypes,
         coalesce({_ACTION}, 'event') AS act0,
         array_to_string(list_slice(regexp_extract_all(lower(title), {sql_str(MONEY_SQL)}), 1, 2), ',') AS money,
         coalesce(strftime(published_at, '%Y-%m'), 'date-unverified') AS month,
         regexp_replace(lower(title), '[^a-z0-9一-鿿]+', '', 'g') AS stable
  FROM g LEFT JOIN cg USING (doc_id)
),
e AS (
  SELECT *, sha256(CASE WHEN accounts <> '' AND country IS NOT NULL AND ptypes <> '' THEN concat_ws('|', accounts, country, ptypes, act, money, month)
                        ELSE concat_ws('|', stable, coalesce(country, ''), act, month) END) AS event_key,
         sha256(CASE WHEN accounts = '' THEN concat_ws('|', coalesce(country, ''), accounts, ptypes, money, substr(stable, 1, 160))
                     ELSE concat_ws('|', coalesce(country, ''), accounts, ptypes, money) END) AS project_key,
         least(0.98, greatest(gate_score::DOUBLE, top_conf)) AS confidence
  FROM (SELECT *, CASE WHEN act0 IN ('award', 'contract') THEN 'award_contract' ELSE act0 END AS act FROM e0)
)"""
