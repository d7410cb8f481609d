"""Rule tables: dictionaries, gazetteers and weights supplied by the user.

A rule table has the columns of ``schemas.RULES``.  The first match wins by
``priority`` then ``rule_id``; a label may own several terms.  Rules given as ``Rule`` lists become literals
inside one stage; rule tables of any size are joined (``rule_labels``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas


@dataclass(frozen=True)
class Rule:
    label: str
    terms: tuple[str, ...]
    all_of: tuple[tuple[str, ...], ...] = ()


def rule_list(pairs: Iterable[tuple[str, Sequence[str]]]) -> list[Rule]:
    return [Rule(label, tuple(terms)) for label, terms in pairs]


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Read a rule table (JSON lines) and reject rows without label or term."""
    df = spark.read.schema(schemas.RULES).json(path)
    bad = df.filter(F.col("label").isNull() | (F.trim("term") == "") | F.col("term").isNull())
    if bad.limit(1).count():
        raise ValueError("rule rows need a label and a term")
    return df


def rule_labels(docs: DataFrame, text: str, doc_id: str, rules: DataFrame, rule_set: str) -> DataFrame:
    """(doc, label, priority) of every label of a rule set with a term inside the text."""
    from newsloom.operators.tagging import match_terms

    mine = rules.filter(F.col("rule_set") == rule_set)
    hits = match_terms(docs, text, doc_id, mine.select("label", "term"))
    order = mine.groupBy("label").agg(F.min("priority").alias("priority"))
    return hits.select(doc_id, "label").distinct().join(order, "label").select(doc_id, "label", "priority")


@dataclass(frozen=True)
class Alias:
    """One spelling of an account, in table order."""

    account: str
    alias: str
    strength: str
    context: str = "text"
    lower: bool = False


def alias_strength(alias: str, weak: Sequence[str], strong: Sequence[str]) -> str:
    """Weak list, then strong list or six characters, else medium."""
    if alias in weak:
        return "weak"
    return "strong" if alias in strong or len(alias) >= 6 else "medium"


@dataclass(frozen=True)
class Gazetteer:
    """Places in priority order: (country, region, aliases)."""

    places: tuple[tuple[str, str, tuple[str, ...]], ...]
    signals: tuple[str, ...] = ()


@dataclass(frozen=True)
class RelevanceRules:
    """Vocabulary of the relevance score (D11-D26).  Every list is user data."""

    entities: tuple[tuple[str, str], ...] = ()
    places: tuple[tuple[str, str, str], ...] = ()
    party_patterns: tuple[str, ...] = ()
    known_parties: tuple[str, ...] = ()
    competitor_names: tuple[str, ...] = ()
    own_names: tuple[str, ...] = ()
    party_strip: str = " "
    internal_terms: tuple[str, ...] = ()
    stale_terms: tuple[str, ...] = ()
    business_terms: tuple[str, ...] = ()
    fresh_terms: tuple[str, ...] = ()
    project_terms: tuple[str, ...] = ()
    project_suffixes: tuple[str, ...] = ()
    project_delimiters: str = r"，。；\n"
    generic_project_terms: tuple[str, ...] = ()
    contract_terms: tuple[str, ...] = ()
    need_terms: tuple[str, ...] = ()
    partner_terms: tuple[str, ...] = ()
    authority_terms: tuple[str, ...] = ()
    stages: tuple[tuple[str, tuple[str, ...]], ...] = ()
    firm_stages: tuple[str, ...] = ()
    industries: tuple[tuple[str, tuple[str, ...]], ...] = ()
    key_industries: tuple[str, ...] = ()
    products: tuple[tuple[str, tuple[str, ...]], ...] = ()
    event_rules: tuple["EventRule", ...] = ()
    topics: tuple[tuple[str, tuple[str, ...], bool], ...] = ()
    leader_split: str = r"[，。；\n]"
    leader_pattern: str = ""
    leader_terms: tuple[str, ...] = ()
    leader_reject: tuple[str, ...] = ()
    senior_roles: tuple[str, ...] = ()
    lead_roles: tuple[str, ...] = ()
    lead_role_label: str = "lead participant"
    role_label: str = "participant"
    unit_pattern: str = ""
    departments: tuple[str, ...] = ()
    manual_source_type: str = "manual"
    templates: dict = field(default_factory=dict)


@dataclass(frozen=True)
class EventRule:
    """``label`` when every term group has a hit (and, if asked, a foreign party).

    ``otherwise`` names the label used when the groups after the first have no hit.
    """

    label: str
    groups: tuple[tuple[str, ...], ...]
    foreign: bool = False
    otherwise: str | None = None
    upper: bool = False
    or_terms: tuple[str, ...] = ()
