"""Gate, accounts, labels, governance and score on texts of our own."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import governance, scoring, tagging
from newsloom.rules import Alias, EventRule, Gazetteer, RelevanceRules, rule_list

PLACES = Gazetteer((("Kenya", "Africa", ("Kenya", "Nairobi")), ("Chile", "Latin America", ("Chile",))), ("overseas", "EPC"))


def one(df):
    return df.collect()[0]


def texts(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "text string")


def test_country_gate(spark):
    rows = tagging.country_gate(texts(spark, "Nairobi line in KENYA, EPC deal in Chile", "overseas EPC talk", "local news"), "text", PLACES).collect()
    assert (rows[0].country, rows[0].region, rows[0].is_overseas, rows[0].overseas_confidence) == ("Kenya", "Africa", True, 0.9)
    assert rows[0].overseas_evidence == ["Kenya", "Nairobi", "EPC"]
    assert not rows[1].is_overseas and rows[1].overseas_confidence == 0.28 and rows[1].country is None
    assert rows[2].overseas_confidence == 0.0


ALIASES = [Alias("Alpha", "Alpha Build", "strong"), Alias("Alpha", "AB", "weak"), Alias("Beta", "Beta", "medium"), Alias("Beta", "betaworks", "strong", "english", True)]


def test_account_candidates(spark):
    df = tagging.account_candidates(texts(spark, "BetaWorks and Beta with AB", "AB company project overseas", "Alpha Build AB Beta company contract"), "text", ALIASES, ("company",), ("overseas", "contract"))
    a, b, c = [r.candidates for r in df.collect()]
    assert [(x.account, x.confidence) for x in a] == [("Beta", 0.98)]
    assert [(x.account, x.confidence, x.needs_review) for x in b] == [("Alpha", 0.24, True)]
    assert [(x.account, x.matched_entity) for x in c] == [("Alpha", "Alpha Build"), ("Beta", "Beta")]


def test_shared_alias_is_capped(spark):
    al = [Alias("Alpha", "Shared Electric", "strong"), Alias("Beta", "Shared Electric", "strong"), Alias("Gamma", "Gamma", "medium")]
    df = tagging.account_candidates(texts(spark, "Shared Electric and Gamma"), "text", al, (), (), "Shared Electric", ("Alpha", "Beta"))
    got = one(df).candidates
    assert [(x.account, x.confidence, x.needs_review) for x in got] == [("Alpha", 0.68, True), ("Beta", 0.68, True), ("Gamma", 0.54, True)]


def test_labels_and_actions(spark):
    rules = rule_list([("rail", ("rail", "metro")), ("port", ("port",)), ("tax", ("tax",))])
    df = texts(spark, "Annual REPORT on metro", "plain")
    lab = df.select(tagging.intelligence_labels(F.col("text"), rules, F.lit("policy"), (("policy", "general", ("tax", "general")),), ("project", ("rail", "port"))).alias("l")).collect()
    assert lab[0].l == ["rail", "port", "general", "project"] and lab[1].l == ["general"]
    word = df.select(tagging.intelligence_labels(F.col("text"), rules, match="word").alias("l")).collect()
    assert word[0].l == ["rail"]
    act = df.select(tagging.first_label(F.col("text"), rule_list([("a", ("metro",)), ("b", ("annual",))])).alias("x")).collect()
    assert [r.x for r in act] == ["a", None]


def test_policy_percentage_goes_to_its_column(spark):
    df = spark.createDataFrame([("duty falls to 5% from 8%", ["tariff", "rail"], "Chile"), ("none", ["rail"], None)], "text string, labels array<string>, country string")
    got = tagging.policy_dimensions(df, "text", "labels", ("tariff", "tax"), ("Duty",), {"tariff_rate": "tariff", "tax_rate": "tax"}).collect()
    assert len(got) == 1 and (got[0].tariff_rate, got[0].tax_rate, got[0].tax_type, got[0].affected_countries) == ("5%", None, "Duty", ["Chile"])


def test_dictionary_terms_of_any_length(spark):
    docs = spark.createDataFrame([(1, "The quick Brown fox"), (2, "ox and cart"), (3, "x")], "id int, text string")
    terms = spark.createDataFrame([("a", "Quick"), ("a", "brown f"), ("b", "ox"), ("c", "cart"), ("d", "missing")], "label string, term string")
    long = {tuple(r) for r in tagging.match_terms(docs, "text", "id", terms, gram=9).collect()}
    short = {tuple(r) for r in tagging.match_terms(docs, "text", "id", terms, gram=1).collect()}
    usual = tagging.match_terms(docs, "text", "id", terms)
    assert "NestedLoop" not in usual._jdf.queryExecution().toString()
    assert tagging.match_terms(docs, "text", "id", terms.limit(0)).count() == 0
    assert {tuple(r) for r in usual.collect()} == long == short == {(1, "a", "Quick"), (1, "a", "brown f"), (1, "b", "ox"), (2, "b", "ox"), (2, "c", "cart")}


R = RelevanceRules(
    entities=(("Acme Second", "acme-2"), ("Acme", "acme")), places=(("Kenya", "Kenya", "Africa"),),
    party_patterns=(r"^(.{2,45}?) visits Acme",), own_names=("Acme",), internal_terms=("union picnic",), stale_terms=("anniversary",),
    business_terms=("project", "contract"), fresh_terms=("tender", "signed"), project_terms=("project",), project_suffixes=("hydro project",), project_delimiters=r",.;\n",
    contract_terms=("signed",), partner_terms=("cooperation",), authority_terms=("Ministry",), stages=(("tender", ("tender",)), ("signing", ("signed",))), firm_stages=("tender",),
    industries=(("power", ("hydro",)), ("data", ("data hall",))), key_industries=("data",), products=(("power", ("switchgear", "relay")),),
    event_rules=(EventRule("state exchange", (("visits",), ("Ministry",)), foreign=True, otherwise="client visit"), EventRule("signing", (("signed",),))),
    leader_split=r"[.;\n]", leader_pattern=r"(Acme [^.;\n]{2,40}?(?:chairman|manager)) ([A-Z][a-z]{2,9}) (?:met|said)", senior_roles=("chairman",), lead_roles=("chairman",),
    unit_pattern="Acme (?:First|Second)", departments=(" Overseas Office",), manual_source_type="manual",
)


def score(spark, title, content, kind="official", level="high"):
    df = spark.createDataFrame([(title, content, kind, level)], "title string, content string, k string, l string")
    return one(scoring.analyze(df, R, "title", "content", "k", "l"))


def test_flagship_score(spark):
    r = score(spark, "Kenya Ministry of Energy visits Acme", "Cooperation and cooperation on the Tana hydro project. Acme Group chairman Odhiambo met guests. Acme Second Overseas Office joins; signed terms in Kenya")
    assert r.external_parties == ["Kenya Ministry of Energy"] and r.country == "Kenya" and r.entity_id == "acme-2"
    assert [p.name for p in r.involved_leaders] == ["Odhiambo"] and r.involved_departments == ["Acme Second Overseas Office"]
    assert (r.score_project, r.score_relationship, r.score_fit, r.score_decision, r.score_reliability) == (30, 25, 15, 15, 10)
    assert r.relevance_score == 95 and r.event_types == ["state exchange", "signing"]
    assert r.score_evidence["business_fit"].matched == ["power", "switchgear", "relay"]
    assert not r.requires_review


def test_excluded_texts_stay_low(spark):
    inside = score(spark, "Union day", "a union picnic")
    assert inside.exclusion_reason == "internal: union picnic" and inside.relevance_score == 10
    stale = score(spark, "Kenya Ministry visits Acme", "anniversary of the old project, cooperation, Acme Group chairman Odhiambo met guests, hydro")
    assert stale.exclusion_reason.startswith("retrospective") and stale.relevance_score <= 29
    assert score(spark, "x", "hydro", "manual", "low").requires_review


@pytest.mark.parametrize("value,band", [(70, "high"), (69, "medium"), (50, "medium"), (49, "low"), (30, "low"), (29, None)])
def test_bands(spark, value, band):
    assert one(spark.range(1).select(scoring.score_band(F.lit(value)).alias("b"))).b == band


GOV = governance.GovernanceRules(
    roles=("总经理", "董事长", "董事"), appointments=(("resignation", ("辞任",)), ("appointment", ("任命", "聘任"))), activities=(("inspection", ("调研",)),),
    person_patterns=(r"(?:任命|聘任)\s*([一-鿿]{2,4}?)(?:为|任|担任)", r"(?:董事长|总经理)([一-鿿]{2,4}?)(?=调研|辞任|$)"), surnames=("王", "李"), name_stopwords=("股东", "任何"),
    org_changes=(("renamed", ("更名",)),), org_fallbacks=(("established", ("组建",)),), org_subjects=("公司",),
)


def test_leadership(spark):
    df = texts(spark, "集团任命王小明为总经理", "总经理李四方调研项目", "公司聘任任何股东为董事", "没有人事")
    a, b, c, d = governance.leadership(df, "text", GOV).collect()
    assert (a.person_name, a.appointment_type, a.title_after, a.role_change, a.leadership_confidence) == ("王小明", "appointment", "总经理", True, 0.86)
    assert (b.person_name, b.appointment_type, b.role_change, b.title_after) == ("李四方", "inspection", False, None)
    assert c.person_name is None and d.appointment_type is None


def test_org_change(spark):
    df = texts(spark, "公司更名公告", "组建新公司", "组建团队")
    assert [r.c for r in df.select(governance.org_change(F.col("text"), GOV).alias("c")).collect()] == ["renamed", "established", None]
