"""Dictionary tagging over whole tables."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import bind, contains_any, labels_where, percent_tokens, terms_found
from newsloom.rules import Alias, Gazetteer, Rule
from newsloom.session import cut_lineage
from newsloom.skew import BROADCAST_ROWS, keyed_lookup

# Ship the functions themselves, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Evidence weights and thresholds of the gates.
COUNTRY_WEIGHT, SIGNAL_WEIGHT, GATE_CAP, GATE_MIN = "0.48", "0.14", "0.99", "0.55"
ALIAS_WEIGHTS = {"strong": "0.78", "medium": "0.54", "weak": "0.24"}
ALIAS_CAP, REVIEW_BELOW, AMBIGUOUS_CAP = "0.98", "0.65", "0.68"
ACCOUNT_BASE, ACCOUNT_STEP, ACCOUNT_CAP, ACCOUNT_NONE = "0.62", "0.09", "0.97", "0.35"
#: Bytes of a dictionary term's seed, and the largest size of the filter of all seeds.
SEED_BYTES, SLOTS = 4, 1 << 20


def _dec(value: str) -> Column:
    return F.lit(value).cast("decimal(5,2)")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def country_gate(df: DataFrame, text: str, gazetteer: Gazetteer, lowered: str | None = None) -> DataFrame:
    """First place in priority order plus general signals decide relevance.

    Adds ``is_overseas``, ``overseas_confidence``, ``country``, ``region`` and
    ``overseas_evidence`` (at most eight, in order, distinct).
    """
    # A column of its own, so that no rewrite of the plan lowers the text once per place.
    lower = df.withColumn("_low", F.col(lowered) if lowered else F.lower(text))
    low = F.col("_low")
    place = F.lit(None).cast("struct<country:string,region:string,aliases:array<string>>")
    for country, region, aliases in reversed(gazetteer.places):
        hit = contains_any(low, [a.lower() for a in aliases])
        entry = F.struct(F.lit(country).alias("country"), F.lit(region).alias("region"), _strings(aliases).alias("aliases"))
        place = F.when(hit, entry).otherwise(place)
    out = lower.withColumn("_place", place)
    aliases = F.coalesce(F.col("_place.aliases"), F.array().cast("array<string>"))
    hits = F.filter(F.concat(aliases, _strings(gazetteer.signals)), lambda a: F.contains(F.col("_low"), F.lower(a)))
    out = out.withColumn("_ev", F.array_distinct(hits))
    country_part = F.when(F.col("_place").isNotNull(), _dec(COUNTRY_WEIGHT)).otherwise(_dec("0"))
    score = F.least(
        _dec(GATE_CAP),
        (country_part + _dec(SIGNAL_WEIGHT) * F.least(F.size("_ev"), F.lit(3)).cast("decimal(2,0)")).cast("decimal(5,2)"),
    )
    return out.select(
        *df.columns,
        (score >= _dec(GATE_MIN)).alias("is_overseas"),
        score.cast("double").alias("overseas_confidence"),
        F.col("_place.country").alias("country"),
        F.col("_place.region").alias("region"),
        F.slice("_ev", 1, 8).alias("overseas_evidence"),
    )


def account_hits(
    df: DataFrame, text: str, accounts: Sequence[tuple[str, Sequence[str]]], ambiguous: Sequence[str] = (),
    context: Sequence[str] = (), shared: tuple[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Account names with their matched keywords and a confidence.

    Short ambiguous words count only beside one of ``context``; ``shared`` is a keyword
    claimed by several accounts whose presence fixes the confidence.
    """
    t = F.col(text)
    no_context = ~contains_any(t, context) if context else F.lit(False)
    usable = lambda k: ~(F.array_contains(_strings(ambiguous), k) & no_context)
    per = F.array(*[
        F.struct(F.lit(name).alias("name"), F.filter(terms_found(t, words), usable).alias("hits"))
        for name, words in accounts
    ])
    kept = F.filter(per, lambda a: F.size(a["hits"]) > 0)
    out = df.withColumn("_acc", kept)
    names = F.transform("_acc", lambda a: a["name"])
    matched = F.array_distinct(F.flatten(F.transform("_acc", lambda a: a["hits"])))
    n = F.size(matched)
    conf = F.when(
        F.size("_acc") > 0,
        F.least(_dec(ACCOUNT_CAP), (_dec(ACCOUNT_BASE) + _dec(ACCOUNT_STEP) * n.cast("decimal(3,0)")).cast("decimal(5,2)")),
    ).otherwise(_dec(ACCOUNT_NONE))
    if shared:
        word, owners = shared
        both = F.size(F.array_intersect(names, _strings(owners))) == len(owners)
        conf = F.when(F.array_contains(matched, word) & both, _dec(AMBIGUOUS_CAP)).otherwise(conf)
    return out.select(
        *df.columns, names.alias("accounts"), matched.alias("matched_keywords"), conf.cast("double").alias("account_confidence")
    )


def rule_labels(text_low: Column, rules: Sequence[Rule], match: str = "substring") -> Column:
    """Labels whose terms occur, in rule order.  ``match='word'`` asks for whole words."""
    def hit(rule: Rule) -> Column:
        terms = [t.lower() for t in rule.terms]
        if match == "word":
            import re

            return text_low.rlike(r"(?<![\p{L}\p{N}_])(?:" + "|".join(re.escape(t) for t in terms) + r")(?![\p{L}\p{N}_])")
        return contains_any(text_low, terms)

    return labels_where([(r.label, hit(r)) for r in rules])


def intelligence_labels(
    text: Column, rules: Sequence[Rule], source_type: Column | None = None,
    fallbacks: Sequence[tuple[str, str, Sequence[str]]] = (), rollup: tuple[str, Sequence[str]] | None = None,
    match: str = "substring",
) -> Column:
    """D3: multi-label tags.

    ``fallbacks`` are (source type, label, labels that make it unnecessary); ``rollup``
    is a label added when any of its member labels is present.
    """
    labels = bind(F.lower(text), lambda low: rule_labels(low, rules, match))
    none = F.array().cast("array<string>")

    def extend(base: Column) -> Column:
        parts = [base]
        for kind, label, enough in fallbacks:
            need = (source_type == kind) & ~F.arrays_overlap(base, _strings(enough))
            parts.append(F.when(F.coalesce(need, F.lit(False)), _strings([label])).otherwise(none))
        return F.concat(*parts)

    def roll(base: Column) -> Column:
        label, members = rollup
        return F.concat(base, F.when(F.arrays_overlap(base, _strings(members)), _strings([label])).otherwise(none))

    if fallbacks:
        labels = bind(labels, extend)
    if rollup:
        labels = bind(labels, roll)
    return F.array_distinct(labels)


def first_label(text: Column, rules: Sequence[Rule]) -> Column:
    """Label of the first rule with a hit, NULL when none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(contains_any(low, [t.lower() for t in r.terms]), F.lit(r.label)) for r in rules])


def first_list(text: Column, rules: Sequence[tuple[Sequence[str], Sequence[str]]], default: Sequence[str]) -> Column:
    """Value list of the first rule with a hit, else the default list."""
    return F.coalesce(*[F.when(contains_any(text, keys), _strings(vals)) for keys, vals in rules], _strings(default))


def account_candidates(
    df: DataFrame, text: str, aliases: Sequence[Alias], company_context: Sequence[str], overseas_context: Sequence[str],
    ambiguous_alias: str | None = None, ambiguous_accounts: Sequence[str] = (),
) -> DataFrame:
    """Accounts named in a text with summed alias evidence.

    Adds ``candidates``: array of (account, matched_entity, confidence, needs_review,
    evidence).  The whole match runs inside the row, so there is no shuffle.  Order is by
    confidence before the ambiguity cap, then name.
    """
    rows = F.array(*[
        F.struct(
            F.lit(a.account).alias("account"), F.lit(a.alias).alias("alias"), F.lit(a.strength).alias("strength"),
            F.lit(a.context).alias("context"), F.lit(a.lower).alias("lower"), _dec(ALIAS_WEIGHTS[a.strength]).alias("w"),
        )
        for a in aliases
    ])
    raw = F.col(text)

    def hits(v: Column) -> Column:
        def usable(a: Column) -> Column:
            named = F.when(a["lower"], F.contains(v["low"], a["alias"])).otherwise(F.contains(raw, a["alias"]))
            backed = v["company"] & (v["abroad"] | (F.char_length(a["alias"]) >= 3))
            return named & ((a["strength"] != "weak") | backed)

        return F.filter(rows, usable)

    def candidate(found: Column, name: Column) -> Column:
        mine = F.filter(found, lambda a: a["account"] == name)
        total = F.aggregate(mine, F.lit(0).cast("decimal(10,2)"), lambda s, a: (s + a["w"]).cast("decimal(10,2)"))
        conf = F.least(_dec(ALIAS_CAP).cast("decimal(10,2)"), total)
        shared = F.lit(False)
        if ambiguous_alias:
            shared = F.contains(raw, F.lit(ambiguous_alias)) & F.array_contains(_strings(ambiguous_accounts), name)
        return F.struct(
            (-conf).alias("_rank"),
            name.alias("account"),
            F.get(mine, F.lit(0))["alias"].alias("matched_entity"),
            F.when(shared, F.least(conf, _dec(AMBIGUOUS_CAP).cast("decimal(10,2)"))).otherwise(conf).cast("double").alias("confidence"),
            (shared | (total < _dec(REVIEW_BELOW))).alias("needs_review"),
            F.transform(mine, lambda a: F.struct(a["alias"].alias("alias"), a["strength"].alias("strength"), a["context"].alias("context"))).alias("evidence"),
        )

    def build(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda a: a["account"]))
        return F.array_sort(F.transform(names, lambda n: candidate(found, n)))

    # Bound step by step, so that no rewrite of the plan repeats a step for every account.
    facts = bind(F.lower(text), lambda low: F.struct(
        low.alias("low"), contains_any(raw, company_context).alias("company"), contains_any(low, overseas_context).alias("abroad")
    ))
    ordered = bind(facts, lambda v: bind(hits(v), build))
    keep = ("account", "matched_entity", "confidence", "needs_review", "evidence")
    return df.withColumn("candidates", F.transform(ordered, lambda c: F.struct(*[c[k].alias(k) for k in keep])))


def top_confidence(candidates: Column, default: float = 0.35) -> Column:
    """Best candidate confidence."""
    return F.coalesce(F.array_max(F.transform(candidates, lambda c: c["confidence"])), F.lit(default))


def evidence_aliases(candidates: Column) -> Column:
    """K2: every evidence alias, distinct, in order."""
    return F.array_distinct(F.flatten(F.transform(candidates, lambda c: F.transform(c["evidence"], lambda e: e["alias"]))))


def article_confidence(overseas: Column, candidates: Column) -> Column:
    """min(.98, max(gate, account))."""
    return F.least(F.lit(0.98), F.greatest(overseas, top_confidence(candidates)))


def policy_dimensions(
    df: DataFrame, text: str, labels: str, policy_labels: Sequence[str], tax_terms: Sequence[str],
    routes: dict[str, str], country: str = "country",
) -> DataFrame:
    """Rows with a policy label only; the first percentage goes to each routed column.

    ``routes`` maps an output column to the label that fills it.
    """
    types = F.filter(F.col(labels), lambda x: x.isin(*policy_labels))
    out = df.withColumn("policy_types", types).filter(F.size("policy_types") > 0)
    low = F.lower(text)
    first_pct = F.get(percent_tokens(F.col(text)), F.lit(0))
    cols = {c: F.when(F.array_contains("policy_types", label), first_pct) for c, label in routes.items()}
    tax = F.coalesce(*[F.when(low.contains(t.lower()), F.lit(t)) for t in tax_terms]) if tax_terms else F.lit(None)
    affected = F.when(F.col(country).isNotNull(), F.array(country)).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"tax_type": tax, "affected_countries": affected, **cols})


def source_role(source_type: Column, source_name: Column, language: Column, official: Sequence[str], manual: str) -> Column:
    """Official, manual, domestic media or overseas media."""
    domestic = (language == "zh") | source_name.rlike("[一-鿿]")
    return (
        F.when(source_type.isin(*official), "official")
        .when(source_type == manual, "manual")
        .when(domestic, "domestic_media")
        .otherwise("overseas_media")
    )


def products_for(industries: Column, table: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Products of each industry, flattened, distinct."""
    if not table:
        return F.array().cast("array<string>")
    lookup = F.create_map(*[x for name, vals in table for x in (F.lit(name), _strings(vals))])
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(industries, lambda i: F.coalesce(F.element_at(lookup, i), empty))))


def term_seeds(terms: DataFrame, gram: int = SEED_BYTES) -> DataFrame:
    """The dictionary index: label, term, ``_t`` (its bytes), ``_g`` (its seed) and ``_o`` (bytes before the seed).

    A term's seed is the n-gram of its bytes that the fewest terms have (a shorter term is its own seed), so one
    n-gram leads to few terms.  ``terms``: label, term, and optionally ``fold`` (match without case, the default).
    """
    fold = F.col("fold") if "fold" in terms.columns else F.lit(True)
    kept = terms.select("label", "term", fold.alias("fold")).filter(F.col("term") != "").distinct()
    kept = kept.withColumn("_t", F.when(F.col("fold"), F.lower("term")).otherwise(F.col("term")).cast("binary"))
    width = F.least(F.lit(gram), F.octet_length("_t"))
    places = F.transform(F.sequence(F.lit(1), F.octet_length("_t") - width + 1), lambda i: F.struct(F.substring(F.col("_t"), i, width).alias("g"), (i - 1).alias("o")))
    each = kept.select("label", "term", "fold", "_t", F.explode(places).alias("p")).select("label", "term", "fold", "_t", "p.g", "p.o")
    spread = each.groupBy("fold", "g").agg(F.count_distinct("_t").alias("n"))
    ranked = each.join(spread, ["fold", "g"]).groupBy("label", "term", "fold", "_t").agg(F.min(F.struct("n", "g", "o")).alias("s"))
    return ranked.select("label", "term", "fold", "_t", F.col("s.g").alias("_g"), F.col("s.o").alias("_o"))


def _slots(data: bytes | None, width: int, slots: int) -> np.ndarray:
    """Slot of each n-gram of ``width`` bytes, in order."""
    body = np.frombuffer(data or b"", np.uint8).astype(np.int64)
    out = np.zeros(max(0, len(body) - width + 1), np.int64)
    for i in range(width):
        out = (out * 257 + body[i : i + len(out)]) % slots
    return out


def _sieve(seeds: DataFrame, width: int) -> Callable[[Column], Column]:
    """Places (from 1) of the n-grams of a text that may be a seed: those in slots that some seed has (a Bloom filter of at most ``SLOTS``)."""
    count, slots = seeds.count(), 1 << 10
    while slots < SLOTS and slots < 16 * count:
        slots *= 2
    slots -= 1  # odd, so that every byte of an n-gram counts

    @F.pandas_udf(T.IntegerType())
    def slot(grams: pd.Series) -> pd.Series:
        return pd.Series([int(_slots(g, width, slots)[0]) for g in grams], dtype="int32")

    held = np.zeros(slots, bool)
    for row in seeds.select(slot("_g").alias("slot")).distinct().toLocalIterator():
        held[row["slot"]] = True

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(bodies: pd.Series) -> pd.Series:
        return pd.Series([(np.flatnonzero(held[_slots(b, width, slots)]) + 1).astype(np.int32) for b in bodies], dtype=object)

    return places


def match_terms(docs: DataFrame, text: str, doc_id: str, terms: DataFrame, gram: int = SEED_BYTES) -> DataFrame:
    """(doc, label, term) for every dictionary term inside a text, for a dictionary of any size.

    The n-grams of a text are tested against a Bloom filter of the dictionary's seeds inside its row; only places
    that pass become rows, each with the bytes around it that the longest term can cover.  They are joined with the
    terms of their seed and verified there, so no text moves.  A dictionary that can be broadcast is, in the same pass.
    """
    index = cut_lineage(term_seeds(terms, gram), "dictionary")
    shapes = index.groupBy("fold", F.octet_length("_g").alias("w")).agg(F.max("_o").cast("int").alias("before"), F.max(F.octet_length("_t") - F.col("_o")).cast("int").alias("after")).orderBy("fold", "w").collect()
    found = docs.select(doc_id, F.lit(None).cast("binary").alias("_g"), F.lit(None).cast("binary").alias("_x"), F.lit(0).alias("_at"), F.lit(True).alias("fold")).limit(0)
    for s in shapes:  # at most two times the seed's length
        places = _sieve(index.filter((F.col("fold") == s["fold"]) & (F.octet_length("_g") == s["w"])).select("_g"), s["w"])
        body = docs.select(doc_id, F.encode(F.lower(text) if s["fold"] else F.col(text), "utf-8").alias("_b")).filter(F.octet_length("_b") >= s["w"])
        at = body.select(doc_id, "_b", F.explode(places(F.col("_b"))).alias("_p")).withColumn("_from", F.greatest(F.lit(1), F.col("_p") - s["before"]))
        found = found.unionByName(at.select(
            doc_id, F.substring(F.col("_b"), F.col("_p"), F.lit(s["w"])).alias("_g"),
            F.substring(F.col("_b"), F.col("_from"), F.col("_p") - F.col("_from") + s["after"]).alias("_x"), (F.col("_p") - F.col("_from")).alias("_at"), F.lit(s["fold"]).alias("fold"),
        ))
    if index.count() <= BROADCAST_ROWS:
        met = found.join(F.broadcast(index), ["fold", "_g"])
    else:  # hot seeds are counted, so the places are kept
        met = keyed_lookup(cut_lineage(found, "places"), index, ["fold", "_g"], "_x", how="inner")
    inside = F.substring(F.col("_x"), F.col("_at") - F.col("_o") + 1, F.octet_length("_t")) == F.col("_t")
    return met.filter((F.col("_at") >= F.col("_o")) & inside).select(doc_id, "label", "term").distinct()


def candidates_by_table(
    docs: DataFrame, text: str, doc_id: str, aliases: DataFrame, company_context: Sequence[str], overseas_context: Sequence[str],
) -> DataFrame:
    """D4 with the aliases as a table of any size: (doc, account, matched_entity, confidence, needs_review, evidence).

    ``aliases``: position, account, alias, strength, lower.  A weak alias needs a company word and, if it is short, an
    overseas word beside it in the text.
    """
    lower = aliases.select(F.col("position").cast("string").alias("label"), F.col("alias").alias("term"), F.col("lower").alias("fold"))
    hits = match_terms(docs, text, doc_id, lower).select(doc_id, F.col("label").cast("int").alias("position"))
    raw = F.col(text)
    backing = docs.select(doc_id, contains_any(raw, company_context).alias("_company"), bind(F.lower(raw), lambda low: contains_any(low, overseas_context)).alias("_abroad"))
    weight = F.coalesce(*[F.when(F.col("strength") == k, _dec(v)) for k, v in ALIAS_WEIGHTS.items()])
    known = hits.join(aliases.withColumn("w", weight), "position").join(backing.filter("_company"), doc_id, "left")
    backed = F.coalesce(F.col("_company") & (F.col("_abroad") | (F.char_length("alias") >= 3)), F.lit(False))
    usable = known.filter((F.col("strength") != "weak") | backed)
    total = F.sum("w").cast("decimal(10,2)")
    out = usable.groupBy(doc_id, "account").agg(
        F.min_by("alias", "position").alias("matched_entity"), F.least(_dec(ALIAS_CAP).cast("decimal(10,2)"), total).cast("double").alias("confidence"),
        (total < _dec(REVIEW_BELOW)).alias("needs_review"), F.sort_array(F.collect_list(F.struct("position", "alias"))).alias("evidence"),
    )
    return out.withColumn("evidence", F.transform("evidence", lambda e: e["alias"]))
