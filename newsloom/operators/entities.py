"""Organisation master: checks, exact resolution, reconciliation, hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import clean_entity_name, name_key
from newsloom.skew import counted_broadcast, keyed_lookup


def load_master(raw: DataFrame, required: Sequence[str], key: str = "entity_id") -> DataFrame:
    """Field check, duplicate-id check and name cleaning."""
    missing = sorted(set(required) - set(raw.columns))
    if missing:
        raise ValueError(f"entity master lacks fields: {missing}")
    twice = raw.groupBy(key).count().filter("count > 1").select(key).limit(5).collect()
    if twice:
        raise ValueError(f"duplicate ids: {[r[0] for r in twice]}")
    cleaned = F.filter(F.transform(F.coalesce("aliases", F.array()), clean_entity_name), lambda a: a != "")
    return raw.select(*required).withColumns({
        "canonical_name": clean_entity_name(F.col("canonical_name")),
        "short_name": F.nullif(clean_entity_name(F.coalesce("short_name", F.lit(""))), F.lit("")),
        "aliases": cleaned,
    })


def alias_table(master: DataFrame, key: str = "entity_id") -> DataFrame:
    """(alias_key, entity_id) for every name key owned by exactly one entity."""
    names = F.concat(F.array("canonical_name", "short_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    pairs = master.select(key, F.explode(names).alias("_n")).filter(F.col("_n").isNotNull())
    pairs = pairs.select(key, name_key(F.col("_n")).alias("alias_key")).filter("alias_key <> ''").distinct()
    return pairs.groupBy("alias_key").agg(F.count(F.lit(1)).alias("_o"), F.min(key).alias(key)).filter("_o = 1").drop("_o")


def resolve_names(names: DataFrame, name: str, master: DataFrame, row_id: str, key: str = "entity_id") -> DataFrame:
    """Exact match on the name key; ambiguous or unknown names stay NULL."""
    aliases = alias_table(master, key)
    keyed = names.withColumn("alias_key", name_key(F.col(name)))
    return keyed_lookup(keyed, aliases, ["alias_key"], row_id).drop("alias_key")


def parse_links_as_entities(links: DataFrame, markers: Sequence[str], label: str = "label", url: str = "url") -> DataFrame:
    """Organisation page anchors that look like entity names, one row per (name, address)."""
    named = links.withColumn("canonical_name", clean_entity_name(F.col(label)))
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.col("canonical_name").contains(m)
    usable = ~F.lower(F.trim(url)).rlike("^(javascript:|#)") & (F.trim(url) != "")
    return (
        named.filter((F.char_length("canonical_name") >= 4) & hit)
        .select("canonical_name", F.when(usable, F.col(url)).alias("official_url"))
        .distinct()
    )


def reconcile(discovered: DataFrame, master: DataFrame, known: Sequence[str] = ("verified", "renamed")) -> DataFrame:
    """Full outer comparison of a discovered list with the master.

    ``status`` is matched, url_changed, new_pending or missing; new rows get a stable id.
    """
    found = resolve_names(discovered, "canonical_name", master, "canonical_name")
    m = master.select(
        F.col("entity_id"), F.col("canonical_name").alias("m_name"), F.col("official_url").alias("m_url"), "verification_status"
    )
    listed = found.select("entity_id", F.col("canonical_name").alias("d_name"), F.col("official_url").alias("d_url"))
    # Unresolved names have no id to join on; as NULL keys they would all meet in one partition.
    joined = listed.filter("entity_id is not null").join(m, "entity_id", "full_outer").unionByName(
        listed.filter("entity_id is null"), allowMissingColumns=True
    )
    status = (
        F.when(F.col("entity_id").isNull(), "new_pending")
        .when(F.col("d_name").isNull(), F.when(F.col("verification_status").isin(*known), "missing").otherwise("unlisted"))
        .when(F.col("d_url").isNotNull() & ~F.col("d_url").eqNullSafe(F.col("m_url")), "url_changed")
        .otherwise("matched")
    )
    made = F.concat(F.lit("discovered-"), F.substring(F.sha2(clean_entity_name(F.col("d_name")), 256), 1, 16))
    return joined.select(
        F.coalesce("entity_id", made).alias("entity_id"),
        F.coalesce("d_name", "m_name").alias("canonical_name"),
        F.coalesce("d_url", "m_url").alias("official_url"),
        status.alias("status"),
    )


def reconcile_counts(rows: DataFrame) -> DataFrame:
    """The four counters (a changed address is also a match)."""
    return rows.agg(
        F.count_if(F.col("status").isin("matched", "url_changed")).alias("matched"),
        F.count_if(F.col("status") == "new_pending").alias("new_pending"),
        F.count_if(F.col("status") == "url_changed").alias("url_changes"),
        F.count_if(F.col("status") == "missing").alias("missing_from_page"),
    )


def upsert_master(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Update by id, else by name key, else insert; incoming values win."""
    inc = incoming.withColumn("_k", name_key(F.col("canonical_name")))
    old = stored.withColumn("_k", name_key(F.col("canonical_name"))).select(F.col("entity_id").alias("old_id"), "_k")
    by_id = inc.join(old.select("old_id").withColumn("_hit", F.lit(True)), inc["entity_id"] == F.col("old_id"), "left")
    by_id = by_id.select(*inc.columns, F.col("_hit"))
    by_name = by_id.join(old.select(F.col("_k"), F.col("old_id").alias("name_id")), "_k", "left")
    replaced = by_name.select(
        F.when(F.col("_hit"), F.col("entity_id")).otherwise(F.coalesce("name_id", "entity_id")).alias("_gone")
    )
    kept = stored.join(replaced, stored["entity_id"] == F.col("_gone"), "left_anti")
    return kept.unionByName(incoming.select(stored.columns))


def with_parent(entities: DataFrame, levels: int = 1, key: str = "entity_id", parent: str = "parent_entity_id") -> DataFrame:
    """join each entity to its parents, one step per level (``ancestor_1`` is the parent)."""
    up = entities.select(F.col(key).alias("_id"), F.col(parent).alias("_up"))
    out = entities.withColumn("ancestor_1", F.col(parent))
    for i in range(2, levels + 1):
        step = counted_broadcast(up)
        out = out.join(step, F.col(f"ancestor_{i - 1}") == F.col("_id"), "left").withColumn(f"ancestor_{i}", F.col("_up")).drop("_id", "_up")
    return out


def account_aliases(mapping: DataFrame, weak: Sequence[str], strong: Sequence[str], ambiguous: Sequence[str] = ()) -> DataFrame:
    """One alias row per account and entity, with strength and ambiguity."""
    e = F.col("alias")
    isin = lambda values: e.isin(*values) if values else F.lit(False)
    strength = F.when(isin(weak), "weak").when(isin(strong) | (F.char_length(e) >= 6), "strong").otherwise("medium")
    return (
        mapping.select(F.col("account"), F.explode("entities").alias("alias")).distinct()
        .withColumns({"alias_strength": strength, "is_ambiguous": isin(ambiguous)})
    )
