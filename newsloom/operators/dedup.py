"""The ingest cascade and its ledgers.

The semantics are sequential: in arrival order an item is compared, stage by
stage (URL, content hash, title, relevance gate, event), with the items accepted before
it; only accepted items ("leaders") block later ones.  That is the greedy, arrival-ordered
independent set of the match graph, and it is computed in rounds:

* exact keys need no pairs: an item can lead only if it is the first undecided item of its
  URL, hash and event groups, found with map-side combined minima;
* titles are compared on distinct titles against a few pivots per block and round;
* each new leader closes its groups at once, so copies and near copies disappear early;
* what the first round leaves is contracted to conflict components; small ones are folded in
  arrival order inside one row, so further rounds see only the large ones.

Items without a conflict are decided by the first round, so input without conflicts writes a
fixed number of tables.  A round drops the tables that only it needed, a query its shuffle files when it ends.  Every round either decides the earliest undecided item or takes pivots
out of every block, so it ends; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.operators import graph
from newsloom.operators import similarity as sim
from newsloom.operators.reach import earliest_in_reach
from newsloom.session import cut_lineage, drop_spent, shuffles_dropped
from newsloom.skew import counted_broadcast, first_per_key, keyed_lookup

EXACT_KEYS = ("url_key", "hash_key", "event_key")
EVENT_SCORE_MIN = 0.65
#: Items of a conflict component that is decided inside one row.
COMPONENT = 64


def _since(as_of: datetime, days: int) -> Column:
    return F.coalesce("published_at", F.lit(as_of)) - F.make_dt_interval(F.lit(days))


def _keys(rows: DataFrame, *columns: str) -> DataFrame:
    """(kind, key, ...) of each row's exact keys; rows lack those that are null."""
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("key")) for i, k in enumerate(EXACT_KEYS)])
    return rows.select(F.explode(kinds).alias("_k"), *columns).select("_k.kind", "_k.key", *columns).filter("key is not null")


def select_leaders(
    items: DataFrame, as_of: datetime, measure: str = "edit", threshold: float = sim.TITLE_THRESHOLD,
    reach_days: int = sim.REACH_DAYS, pivots: int = sim.PIVOTS, blocks: DataFrame | None = None, component: int = COMPONENT,
    sketched: DataFrame | None = None,
) -> DataFrame:
    """Arrival numbers of the eligible items that the sequential order would accept.

    ``items``: arrival_seq (unique), url_key, hash_key, event_key, title, published_at, eligible.  ``blocks`` are the
    prefix blocks and ``sketched`` the sketched titles of all items, if they are known.
    """
    undecided = cut_lineage(
        sim.title_ids(items.filter("eligible"), "title")
        .withColumn("since", _since(as_of, reach_days))
        .select("arrival_seq", *EXACT_KEYS, "tid", "low", "published_at", "since"),
        "undecided",
    )
    own = undecided.select("tid", "low").distinct()
    titles = cut_lineage(sim.sketched(own), "titles") if sketched is None else sketched
    undecided = undecided.drop("low")
    if blocks is None:
        blocks = sim.prefix_blocks(titles, measure, threshold)
    given = blocks
    pairs = cut_lineage(own.select(F.col("tid").alias("tid_l"), F.col("tid").alias("tid_x"), F.lit(1.0).alias("score")), "same-titles")
    leaders: DataFrame | None = None
    open_blocks, done = True, 0
    while True:
        done += 1
        if done % 16 == 0:
            # Many small tables become one, so that the plan does not grow with the rounds.
            pairs, leaders = cut_lineage(pairs, "pairs"), cut_lineage(leaders, "leaders")
        if open_blocks:
            order = undecided.groupBy("tid").agg(F.min("arrival_seq").alias("first_seq"))
            found, rest = sim.expand_round(blocks, titles, order, measure, threshold, pivots)
            pairs = pairs.unionByName(cut_lineage(found, "pairs"))
            blocks, spent = cut_lineage(rest.join(order.select("tid"), "tid", "left_semi"), "blocks"), blocks
            drop_spent(*rest._spent, *([spent] if spent is not given else []))
            open_blocks = not blocks.isEmpty()
        waiting = blocks if open_blocks else None
        fresh = cut_lineage(_ready(undecided, pairs, waiting), "leaders")
        leaders = fresh.select("arrival_seq") if leaders is None else leaders.unionByName(fresh.select("arrival_seq"))
        undecided, spent = cut_lineage(_close(undecided, fresh, pairs), "undecided"), undecided
        drop_spent(spent)
        if undecided.isEmpty():
            return leaders
        if done & (done - 1) == 0:  # after 1, 2, 4, 8, ... rounds, as what is left falls apart
            comps = cut_lineage(conflict_components(undecided, pairs, waiting), "components")
            small = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.max("waits").alias("waits")).filter((F.col("n") <= component) & ~F.col("waits"))
            settled = cut_lineage(comps.join(small, "comp", "left_semi").select("arrival_seq", "comp"), "settled")
            leaders = leaders.unionByName(cut_lineage(_decide_within(undecided, pairs, settled), "leaders"))
            undecided, spent = cut_lineage(undecided.join(settled, "arrival_seq", "left_anti"), "undecided"), undecided
            drop_spent(spent, comps, settled)
            if undecided.isEmpty():
                return leaders


def conflict_components(undecided: DataFrame, pairs: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(arrival_seq, comp, waits): items that a chain of shared keys or similar titles connects.

    Groups become stars around their first item, so a group of any size is one edge per item.  ``waits`` marks items
    whose title has comparisons open in ``blocks``.
    """
    keyed = _keys(undecided, "arrival_seq")
    heads = keyed.groupBy("kind", "key").agg(F.min("arrival_seq").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    by_key = keyed.join(heads, ["kind", "key"]).select(F.col("arrival_seq").alias("a"), "b")
    first = undecided.groupBy("tid").agg(F.min("arrival_seq").alias("b"))
    by_title = undecided.join(first, "tid").select(F.col("arrival_seq").alias("a"), "b")
    similar = (
        pairs.filter("tid_l < tid_x").join(first.select(F.col("tid").alias("tid_l"), F.col("b").alias("a")), "tid_l")
        .join(first.select(F.col("tid").alias("tid_x"), "b"), "tid_x").select("a", "b")
    )
    comps = graph.connected(by_key.unionByName(by_title).unionByName(similar))
    out = undecided.select("arrival_seq", "tid").join(comps.withColumnRenamed("id", "arrival_seq"), "arrival_seq", "left")
    out = out.withColumn("comp", F.coalesce("comp", "arrival_seq"))
    if blocks is None:
        return out.select("arrival_seq", "comp", F.lit(False).alias("waits"))
    open_titles = blocks.select("tid").distinct().withColumn("waits", F.lit(True))
    return out.join(open_titles, "tid", "left").select("arrival_seq", "comp", F.coalesce("waits", F.lit(False)).alias("waits"))


def _decide_within(undecided: DataFrame, pairs: DataFrame, settled: DataFrame) -> DataFrame:
    """Leaders of small components: each is folded in arrival order inside one row.

    A component has at most ``COMPONENT`` items, so the row and the fold are bounded.
    """
    mine = undecided.join(settled, "arrival_seq")
    tids = mine.select(F.col("tid").alias("tid_x")).distinct()
    near = pairs.join(tids, "tid_x").join(tids.withColumnRenamed("tid_x", "tid_l"), "tid_l", "left_semi")
    near = near.groupBy(F.col("tid_x").alias("tid")).agg(F.collect_set("tid_l").alias("near"))
    columns = ("arrival_seq", *EXACT_KEYS, "tid", "published_at")
    rows = mine.join(near, "tid").groupBy("comp").agg(F.sort_array(F.collect_list(F.struct(*columns, "since", "near"))).alias("items"))
    kind = "array<struct<" + ",".join(f"{c}:{undecided.schema[c].dataType.simpleString()}" for c in columns) + ">>"

    def accept(chosen: Column, x: Column) -> Column:
        def blocks(leader: Column) -> Column:
            same = [F.coalesce(leader[k] == x[k], F.lit(False)) for k in EXACT_KEYS]
            similar = F.array_contains(x["near"], leader["tid"]) & (leader["published_at"] >= x["since"])
            return reduce(lambda a, b: a | b, same) | F.coalesce(similar, F.lit(False))

        return F.when(F.exists(chosen, blocks), chosen).otherwise(F.concat(chosen, F.array(F.struct(*[x[c].alias(c) for c in columns]))))

    chosen = F.aggregate("items", F.array().cast(kind), accept)
    return rows.select(F.explode(F.transform(chosen, lambda c: c["arrival_seq"])).alias("arrival_seq"))


def _ready(undecided: DataFrame, pairs: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """Items first in each exact group, with no open comparison and no earlier similar item in reach."""
    firsts = _keys(undecided, "arrival_seq").groupBy("kind", "key").agg(F.min("arrival_seq").alias("arrival_seq"))
    leading = firsts.groupBy("arrival_seq").agg(F.count(F.lit(1)).alias("_led"))
    has = reduce(lambda a, b: a + b, [F.col(k).isNotNull().cast("int") for k in EXACT_KEYS])
    cand = undecided.join(leading, "arrival_seq", "left").filter(F.coalesce("_led", F.lit(0)) == has).drop("_led")
    if blocks is not None:
        cand = cand.join(blocks.select("tid").distinct(), "tid", "left_anti")
    # Earliest undecided arrival per title and publication day: at most one row per day and title.
    by_day = (
        undecided.filter("published_at is not null")
        .groupBy(F.col("tid").alias("tid_l"), F.to_date("published_at").alias("day"))
        .agg(F.min("arrival_seq").alias("seq_l"))
    )
    # Of each title's days, the smallest arrival on that day or later.
    later = Window.partitionBy("tid_l").orderBy(F.desc("day"))
    by_day = by_day.withColumn("seq_l", F.min("seq_l").over(later))
    blocked = (
        cand.select("arrival_seq", F.col("tid").alias("tid_x"), F.to_date("since").alias("since_day"))
        .join(pairs.select("tid_l", "tid_x"), "tid_x")
        .join(by_day, "tid_l")
        .filter((F.col("seq_l") < F.col("arrival_seq")) & (F.col("day") >= F.col("since_day")))
        .select("arrival_seq")
    )
    return cand.join(blocked, "arrival_seq", "left_anti")


def _close(undecided: DataFrame, fresh: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drop the new leaders and everything they match."""
    keyed = _keys(undecided, "arrival_seq").join(_keys(fresh), ["kind", "key"], "left_semi").select("arrival_seq")
    reach = pairs.join(fresh.select(F.col("tid").alias("tid_l"), F.col("arrival_seq").alias("seq_l"), F.col("published_at").alias("pub_l")), "tid_l")
    reach = reach.select(F.col("tid_x").alias("tid"), "seq_l", "pub_l")
    similar = earliest_in_reach(undecided, reach, "arrival_seq", "tid", "since", "seq_l", "pub_l").select("arrival_seq")
    gone = fresh.select("arrival_seq").unionByName(keyed).unionByName(similar)
    return undecided.join(gone, "arrival_seq", "left_anti")


def ingest_cascade(
    items: DataFrame, as_of: datetime, measure: str = "edit", threshold: float = sim.TITLE_THRESHOLD,
    reach_days: int = sim.REACH_DAYS, existing: DataFrame | None = None, pivots: int = sim.PIVOTS,
) -> DataFrame:
    """Outcome of every item.

    Adds ``outcome`` (new, updated, duplicate, skipped), ``match_method``, ``leader_seq``
    and ``match_score``.  ``existing`` holds accepted articles of earlier batches in the
    same columns; their arrival numbers must be lower.  ``confidence`` is optional and
    feeds the score of event duplicates.
    """
    with shuffles_dropped(items.sparkSession):
        return _cascade(items, as_of, measure, threshold, reach_days, existing, pivots)


def _cascade(
    items: DataFrame, as_of: datetime, measure: str, threshold: float, reach_days: int, existing: DataFrame | None, pivots: int
) -> DataFrame:
    if "confidence" not in items.columns:
        items = items.withColumn("confidence", F.lit(0.0))
    slim = cut_lineage(
        sim.title_ids(items.select("arrival_seq", *EXACT_KEYS, "title", "published_at", "eligible", "confidence"), "title")
        .withColumn("since", _since(as_of, reach_days)),
        "items",
    )
    if existing is not None:
        old = existing.select("arrival_seq", *EXACT_KEYS, "title", "published_at", "confidence").withColumn("eligible", F.lit(True))
        old = sim.title_ids(_relevant(old, slim), "title").withColumn("since", _since(as_of, reach_days))
        old = cut_lineage(old, "existing")
        titles, blocks = _title_blocks(slim.select("tid", "low").unionByName(old.select("tid", "low")), measure, threshold)
        outside = _attribute(slim, old, measure, threshold, titles, blocks)
        known = cut_lineage(outside, "known")
        free = slim.join(known.filter("stage is not null").select("arrival_seq"), "arrival_seq", "left_anti")
    else:
        old, free = None, slim
        titles, blocks = _title_blocks(slim.select("tid", "low"), measure, threshold)
    chosen = select_leaders(free, as_of, measure, threshold, reach_days, pivots, blocks, sketched=titles)
    leaders = cut_lineage(slim.join(chosen, "arrival_seq", "left_semi"), "accepted")
    against = leaders if old is None else leaders.unionByName(old)
    rest = slim.join(chosen, "arrival_seq", "left_anti")
    matched = _attribute(rest, against, measure, threshold, titles, blocks).select("arrival_seq", "stage", "leader_seq", "match_score")
    drop_spent(blocks)
    method = F.element_at(F.array(*[F.lit(m) for m in ("canonical_url", "content_hash", "title_similarity", "canonical_event")]), F.col("stage"))
    decided = matched.select(
        "arrival_seq",
        F.when(F.col("stage") == 1, "updated").when(F.col("stage").isNotNull(), "duplicate").otherwise("skipped").alias("outcome"),
        F.when(F.col("stage").isNotNull(), method).alias("match_method"),
        "leader_seq",
        "match_score",
    )
    fresh = leaders.select(
        "arrival_seq", F.lit("new").alias("outcome"), F.lit(None).cast("string").alias("match_method"),
        F.lit(None).cast("bigint").alias("leader_seq"), F.lit(None).cast("double").alias("match_score"),
    )
    return items.join(decided.unionByName(fresh), "arrival_seq")


def _relevant(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored articles that can match a batch: recent enough for its titles, or sharing a key.

    A batch is small beside the stored articles, so its keys are broadcast when their count allows
    and the stored side is filtered where it lies instead of being shuffled.
    """
    first = batch.agg(F.min("since")).first()[0]
    if first is None:
        return existing.limit(0)
    recent = F.coalesce(F.col("published_at") >= F.lit(first), F.lit(False))
    older = existing.filter(~recent)
    parts = existing.filter(recent)
    for key in EXACT_KEYS:
        parts = parts.unionByName(older.join(counted_broadcast(batch.select(key).distinct()), key, "left_semi").select(existing.columns))
    return parts.dropDuplicates(["arrival_seq"])


def _title_blocks(titles: DataFrame, measure: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Sketched titles and prefix blocks of all titles of a run; every comparison of the run reads them."""
    titles = cut_lineage(sim.sketched(titles.distinct()), "titles")
    return titles, sim.prefix_blocks(titles, measure, threshold)


def _attribute(rest: DataFrame, leaders: DataFrame, measure: str, threshold: float, titles: DataFrame, blocks: DataFrame) -> DataFrame:
    """First stage, earliest leader and score for each item; stage is NULL without a match."""
    first = _keys(leaders, "arrival_seq", "confidence").groupBy("kind", "key").agg(F.min(F.struct(F.col("arrival_seq").alias("l"), F.col("confidence").alias("c"))).alias("_m"))
    met = keyed_lookup(_keys(rest, "arrival_seq"), first, ["kind", "key"], "arrival_seq", how="inner").filter(F.col("_m.l") < F.col("arrival_seq"))
    of = lambda i, f: F.max(F.when(F.col("kind") == i, F.col(f"_m.{f}"))).alias(f"{f}{i}")
    exact = met.groupBy("arrival_seq").agg(of(0, "l"), of(1, "l"), of(2, "l"), of(2, "c"))
    out = rest.join(exact, "arrival_seq", "left").withColumn("l2", F.when(F.col("eligible"), F.col("l2")))
    out = cut_lineage(out, "exact")
    open_items = out.filter("l0 is null and l1 is null")
    pairs = cut_lineage(
        sim.similar_to(open_items.select("tid", "low").distinct(), leaders.select("tid", "low").distinct(), measure, threshold, blocks=blocks, titles=titles),
        "title-pairs",
    )
    reach = pairs.join(
        leaders.select(F.col("tid").alias("tid_l"), F.col("arrival_seq").alias("lt"), F.col("published_at").alias("pub_l")), "tid_l"
    ).select(F.col("tid_x").alias("tid"), "lt", "pub_l", F.col("score").alias("st"))
    titled = earliest_in_reach(open_items, reach, "arrival_seq", "tid", "since", "lt", "pub_l", ["st"])
    full = out.join(titled, "arrival_seq", "left")
    stage = (
        F.when(F.col("l0").isNotNull(), 1).when(F.col("l1").isNotNull(), 2).when(F.col("lt").isNotNull(), 3)
        .when(F.col("l2").isNotNull(), 4)
    )
    score = (
        F.when(stage == 2, 1.0).when(stage == 3, F.col("st"))
        .when(stage == 4, F.greatest(F.lit(EVENT_SCORE_MIN), F.col("c2")))
    )
    return full.select(
        *rest.columns,
        stage.alias("stage"),
        F.when(stage.isNotNull(), F.coalesce("l0", "l1", "lt", "l2")).alias("leader_seq"),
        score.alias("match_score"),
    )


def exact_duplicates(items: DataFrame, key: str, seq: str, seen: str | None = None) -> DataFrame:
    """First arrival per key with copy count and, if given, the latest sighting."""
    aggs = [F.min(seq).alias("leader_seq"), F.count(F.lit(1)).alias("copies")]
    if seen:
        aggs.append(F.max(seen).alias("last_seen_at"))
    return items.groupBy(key).agg(*aggs)


def duplicate_ledger(outcomes: DataFrame, url: str) -> DataFrame:
    """One row per duplicate address: leader, method and score of its first arrival."""
    losers = outcomes.filter(F.col("outcome") == "duplicate")
    return first_per_key(losers, [url], [F.col("arrival_seq")], ["leader_seq", "match_method", "match_score"])


def attach_sources(evidence: DataFrame) -> DataFrame:
    """One evidence row per (article, address), from the first arrival."""
    cols = [c for c in evidence.columns if c not in ("article_id", "url")]
    return first_per_key(evidence, ["article_id", "url"], [F.col("arrival_seq")], cols)


def promote_primary(articles: DataFrame, evidence: DataFrame) -> DataFrame:
    """First-party sources replace the identity of an article in arrival order.

    The first first-party source takes over unless the article is already a high-trust
    primary; after that the article is one, so later sources change nothing.  ``evidence``:
    article_id, arrival_seq, source_name, source_type, url, first_party.
    """
    first = first_per_key(
        evidence.filter("first_party"), ["article_id"], [F.col("arrival_seq")], ["source_name", "source_type", "url"]
    ).select("article_id", *[F.col(c).alias(f"_{c}") for c in ("source_name", "source_type", "url")])
    out = articles.join(first, "article_id", "left")
    settled = F.coalesce((F.col("reliability_level") == "high") & F.col("is_primary_source"), F.lit(False))
    take = F.col("_source_name").isNotNull() & ~settled
    changed = {c: F.when(take, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("source_name", "source_type", "url")}
    changed["reliability_level"] = F.when(take, "high").otherwise(F.col("reliability_level"))
    changed["is_primary_source"] = F.when(take, True).otherwise(F.col("is_primary_source"))
    changed["verification_status"] = F.when(take, "source_verified").otherwise(F.col("verification_status"))
    return out.withColumns(changed).select(articles.columns)


def last_content_first_position(items: DataFrame, key: str, position: str, columns: Sequence[str]) -> DataFrame:
    """Per key the content of its last row at the position of its first."""
    return items.groupBy(key).agg(
        F.min(position).alias("position"), F.max_by(F.struct(*columns), position).alias("_c")
    ).select(key, "position", *[F.col(f"_c.{c}").alias(c) for c in columns])


def best_per_event(df: DataFrame, row_id: str, score: str) -> DataFrame:
    """Best row per event by reliability, primary flag and score; first in order wins ties.

    Ties follow the list order of the board: publication or fetch time, newest first, then id.
    The choice is one aggregation on ids, so a hot event costs one combined row per map task.
    """
    rank = F.coalesce(F.element_at(F.create_map(F.lit("high"), F.lit(3), F.lit("medium"), F.lit(2), F.lit("low"), F.lit(1)), F.col("reliability_level")), F.lit(0))
    key = F.coalesce(F.col("canonical_event_id"), F.col("content_hash"), F.col(row_id).cast("string"))
    order = F.struct(
        -rank, -F.col("is_primary_source").cast("int"), -F.col(score),
        -F.unix_micros(F.coalesce("published_at", "fetched_at")), F.col(row_id),
    )
    keyed = df.withColumn("event_identity", key)
    best = keyed.groupBy("event_identity").agg(F.min_by(row_id, order).alias(row_id)).select(row_id)
    return keyed.join(best, row_id, "left_semi")


