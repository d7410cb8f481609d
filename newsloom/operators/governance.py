"""Leadership and organisation changes read from text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import PERSON_SHAPE, bind, clean_entity_name, contains_any, plausible_person_name, squeeze


@dataclass(frozen=True)
class GovernanceRules:
    """Vocabulary of the governance operators.  Patterns capture the person in group 1."""

    roles: tuple[str, ...]
    appointments: tuple[tuple[str, tuple[str, ...]], ...]
    activities: tuple[tuple[str, tuple[str, ...]], ...]
    person_patterns: tuple[str, ...]
    surnames: tuple[str, ...] = ()
    compound_surnames: tuple[str, ...] = ()
    name_stopwords: tuple[str, ...] = ()
    name_shape: str = PERSON_SHAPE
    leaving: tuple[str, ...] = ("resignation", "retirement", "removal")
    moving: tuple[str, ...] = ("resignation", "retirement", "removal", "transfer")
    org_changes: tuple[tuple[str, tuple[str, ...]], ...] = ()
    org_fallbacks: tuple[tuple[str, tuple[str, ...]], ...] = ()
    org_subjects: tuple[str, ...] = ()


def _first(c: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    return F.coalesce(*[F.when(contains_any(c, words), F.lit(label)) for label, words in rules]) if rules else F.lit(None).cast("string")


def _plausible(c: Column, r: GovernanceRules) -> Column:
    return plausible_person_name(c, r.surnames, r.compound_surnames, r.name_stopwords, r.name_shape)


def leadership(df: DataFrame, text: str, r: GovernanceRules) -> DataFrame:
    """Person, kind of change, title before or after and confidence; NULL without a match.

    Appointment rules are tried before activity rules; the person comes from the first
    pattern whose first match is a plausible name; the title is the role within twelve
    characters of the name, else the first role of the text.
    """
    out = df.withColumn("_c", F.regexp_replace(text, r"(?U)\s+", " "))
    appoint = _first(F.col("_c"), r.appointments)
    kind = F.coalesce(appoint, _first(F.col("_c"), r.activities))

    def capture(p: str) -> Column:
        # Without a match the name is empty, which is no name.
        return bind(F.regexp_extract(F.col("_c"), p, 1), lambda name: F.when((name != "") & _plausible(name, r), name))

    person = F.coalesce(*[capture(p) for p in r.person_patterns])
    out = out.withColumns({"_kind": F.when(contains_any(F.col("_c"), r.roles), kind), "_change": appoint.isNotNull(), "_p": person})
    roles = "|".join(sorted(r.roles, key=len, reverse=True))
    # The name becomes a mark of its own length, so that one constant pattern finds the role beside it.
    marked = F.replace("_c", F.col("_p"), F.concat(F.lit("\x01"), F.repeat(F.lit("\x02"), F.char_length("_p") - 1)))
    near = rf"({roles}).{{0,12}}\x01|\x01\x02*+.{{0,12}}({roles})"
    hit = lambda g: F.nullif(F.regexp_extract("_m", near, g), F.lit(""))
    out = out.withColumn("_m", F.when(F.col("_kind").isNotNull() & F.col("_p").isNotNull(), marked))
    title = F.coalesce(hit(1), hit(2), F.nullif(F.regexp_extract(F.col("_c"), f"({roles})", 1), F.lit("")))
    ok = F.col("_kind").isNotNull() & F.col("_p").isNotNull()
    out = out.withColumn("_t", F.when(ok, title))
    return out.withColumns({
        "person_name": F.when(ok, F.col("_p")),
        "appointment_type": F.when(ok, F.col("_kind")),
        "role_change": F.when(ok, F.col("_change")),
        "title_before": F.when(F.col("_kind").isin(*r.moving), F.col("_t")),
        "title_after": F.when(F.col("_change") & ~F.col("_kind").isin(*r.leaving), F.col("_t")),
        "leadership_confidence": F.when(ok, F.when(F.col("_change"), 0.86).otherwise(0.72)),
        "leadership_excerpt": F.when(ok, F.substring("_c", 1, 1200)),
    }).drop("_c", "_kind", "_change", "_p", "_m", "_t")


def org_change(text: Column, r: GovernanceRules, fallback: bool = True) -> Column:
    """First change rule; the fallback rules also ask for a subject word."""
    primary = _first(F.regexp_replace(text, r"(?U)\s+", " "), r.org_changes)
    if not (fallback and r.org_fallbacks):
        return primary
    subject = contains_any(text, r.org_subjects)
    second = F.coalesce(*[F.when(contains_any(text, w) & subject, F.lit(label)) for label, w in r.org_fallbacks])
    return F.coalesce(primary, second)


def new_entity_name(text: Column, change: Column, pattern: str, kinds: Sequence[str]) -> Column:
    """Entity named by an establishment text."""
    return F.when(change.isin(*kinds), F.nullif(clean_entity_name(F.regexp_extract(text, pattern, 1)), F.lit("")))


def org_headline(
    display_title: Column, change: Column, before: Column, after: Column, evidence: Column, labels: dict[str, str],
    place_pattern: str, subject_pattern: str, missing: str = "organisation change to verify",
) -> Column:
    """Stored headline, rename arrow, established-in, subject, then a fallback."""
    names = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    label = F.coalesce(F.element_at(names, change), change)
    text = squeeze(F.coalesce(evidence, F.lit("")))
    full = lambda c: F.concat(label, F.lit(": "), c)
    renamed = (before != "") & (after != "") & (before != after)
    fallback = clean_entity_name(F.coalesce(F.nullif(after, F.lit("")), F.nullif(before, F.lit("")), F.substring(text, 1, 32)))
    return F.coalesce(
        F.nullif(F.trim(display_title), F.lit("")),
        F.when(renamed, full(F.concat(before, F.lit(" → "), after))),
        F.when(text.rlike(place_pattern), full(clean_entity_name(F.concat(F.regexp_extract(text, place_pattern, 1), F.regexp_extract(text, place_pattern, 2))))),
        F.when(text.rlike(subject_pattern), full(clean_entity_name(F.regexp_extract(text, subject_pattern, 1)))),
        full(F.when(fallback != "", fallback).otherwise(missing)),
    )


def leader_event(
    df: DataFrame, text: str, labels: str, action: str, after_title: str, before_title: str, title_pattern: str,
    gate_label: str, gate_actions: Sequence[str],
) -> DataFrame:
    """Person, title and leading account of an item about a leader."""
    person = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    top = F.get("candidates", F.lit(0))
    return (
        df.filter(F.array_contains(labels, gate_label) & F.col(action).isin(*gate_actions))
        .withColumns({
            "person_name": F.coalesce(person(after_title), person(before_title)),
            "person_title": F.nullif(F.regexp_extract(text, title_pattern, 1), F.lit("")),
            "organization": top["account"],
            "matched_entity": top["matched_entity"],
            "leader_confidence": F.coalesce(top["confidence"], F.lit(0.45)),
            "leader_excerpt": F.substring(text, 1, 600),
        })
    )


def feed_route(is_overseas: Column, tags: Column, governed_tag: str, governance_hit: Column, manual: Column) -> Column:
    """Overseas feed, governance record, manual review or skipped."""
    return (
        F.when(is_overseas, "overseas")
        .when(F.array_contains(tags, governed_tag) & governance_hit, "governance")
        .when(manual, "manual_review")
        .otherwise("skipped")
    )


def drop_implausible_people(events: DataFrame, person: str, r: GovernanceRules) -> DataFrame:
    """Keep rows whose person is a plausible name."""
    return events.filter(_plausible(F.col(person), r))


def first_party(source_type: Column, link_only: Column, own_types: Sequence[str]) -> Column:
    """Trusted source type, unless the item is a bare link lead."""
    return ~F.coalesce(link_only, F.lit(False)) & source_type.isin(*own_types)


def effective_source(df: DataFrame, lead_type: str) -> DataFrame:
    """Link-only leads are low trust and of the manual type."""
    lead = F.coalesce("link_only", F.lit(False))
    return df.withColumns({
        "effective_type": F.when(lead, lead_type).otherwise(F.col("source_type")),
        "effective_reliability": F.when(lead, "low").otherwise(F.col("reliability_level")),
    })
