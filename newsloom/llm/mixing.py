"""Mixing sources to target weights by entropy balancing.

Documents are counted by (source, size). Every source gets the rates that are closest to 1 in the bounded
entropy (rates between 0 and ``CAP``) under its token constraint: the rate of a document of size x is
``CAP / (1 + (CAP - 1) * exp(-lambda * x / mean))``, an exponential tilt of x. The convex dual is solved for all
sources at once by distributed Newton steps, kept inside a bracket; only one summary row per step reaches the
driver. Rates become whole copies by systematic rounding along falling size, so a source misses its target by
less than one document, and a few greedy steps then fill or trim what is left.

Nothing depends on the order in which rows are summed, so reruns agree.

Defined results: null text has size 0; sources are weighed in code-point order, null last; a source without
words gets target 0 and nothing is taken; of equal (source, size) the copies go by a hash of ``doc_id``;
repeated rows count as documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, fresh

# Fixed values of the mix.
WEIGHTS, CAP = (5, 2, 1), 3
MAX_STEPS, TOLERANCE, FILL_STEPS = 80, 1e-9, 16
#: Documents of one (source, size) that are ranked together.
RANKED_ROWS = 1000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _exact_sum(x: Column) -> Column:
    """A sum that does not depend on the order of its terms."""
    return F.sum(x.cast("decimal(38,9)")).cast("double")


def source_weights(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(src, has_src, source_size, docs, weight): the weights go round along the sources' order.

    The rank of a source is its rank in its range of sources plus the sources of earlier ranges.
    """
    totals = sizes.groupBy("has_src", "src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranged = scratch.cut(totals.repartitionByRange(F.desc("has_src"), "src").withColumn("part", F.spark_partition_id()), "sources")
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.desc("has_src"), "src")) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    return scratch.cut(
        ranged.join(before.select("part", "before"), "part")
        .withColumn("weight", F.element_at(cycle, (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
        .drop("part", "before"),
        "weights",
    )


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Add ``target``: shares by weight, none above ``cap`` times its source, the excess shared again by weight."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit = F.lit(cap) * F.col("source_size")
    rest, free = total, None
    while True:
        # The weights are 32-bit numbers, as are small Python numbers: only products of 64 bits hold the words of a large corpus.
        over = F.lit(False) if free is None else F.col("weight").cast("long") * F.lit(rest).cast("long") > limit * F.lit(free)
        row = sources.agg(F.sum(F.when(over, limit).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        taken, weight = row[0] or 0, row[1] or 0
        if (total - taken, weight) == (rest, free) or not weight:
            break
        rest, free = total - taken, weight
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(free or 1))
    return sources.withColumn("target", F.least(share, limit.cast("double")))


def tilt(lam: Column, x: Column, cap: int = CAP) -> Column:
    return F.lit(float(cap)) / (1.0 + F.lit(float(cap - 1)) * F.exp(-lam * x))


def solve_dual(classes: DataFrame, sources: DataFrame, scratch: Scratch, cap: int = CAP) -> DataFrame:
    """``sources`` with ``lam``: Newton steps on the dual of each source's token constraint.

    A source whose target is its limit has no finite solution; its ``lam`` is null and its rate the cap.
    """
    mean = F.col("source_size") / F.col("docs")
    state = sources.select(
        "has_src", "src", "source_size", "docs", "target", mean.alias("mean"),
        F.when((F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size")), F.lit(0.0)).alias("lam"),
        F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"),
    )
    keep = [c for c in state.columns]
    state, previous = scratch.cut(state, "dual"), None
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("mean")
        r = tilt(F.col("lam"), x, cap)
        joined = classes.filter("size > 0").join(state, ["has_src", "src"])
        sums = joined.groupBy("has_src", "src").agg(
            _exact_sum(F.col("n") * F.col("size") * r).alias("got"), _exact_sum(F.col("n") * F.col("size") * x * r * (1 - r / cap)).alias("slope")
        )
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.greatest("low", "lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.least("high", "lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / F.col("slope")
        bounded = (
            F.when((newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - F.col("lam")) <= 8), newton)
            .when(F.col("low") == float("-inf"), F.col("lam") - 4).when(F.col("high") == float("inf"), F.col("lam") + 4)
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        done = F.abs(gap) <= TOLERANCE * F.col("target")
        step = (
            state.join(sums, ["has_src", "src"], "left").withColumn("low", low).withColumn("high", high)
            .withColumn("open", F.coalesce(F.col("lam").isNotNull() & ~done, F.lit(False)))
            .withColumn("lam", F.when(F.col("open"), bounded).otherwise(F.col("lam")))
        )
        step = scratch.cut(step.select(*keep, "open"), "dual")
        if previous is not None:
            scratch.drop(previous)
        previous, state = state, step.drop("open")
        state._scratch_path = step._scratch_path
        if not step.agg(F.max(F.col("open").cast("int"))).first()[0]:
            break
    return state


def class_copies(classes: DataFrame, solved: DataFrame, scratch: Scratch, cap: int = CAP) -> DataFrame:
    """``copies`` that the documents of each (source, size) take together."""
    joined = classes.join(solved, ["has_src", "src"])
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lam").isNull(), float(cap)).otherwise(tilt(F.col("lam"), F.col("size") / F.col("mean"), cap))
    along = Window.partitionBy("has_src", "src").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.round(F.sum(F.col("n") * F.col("rate")).over(along), 6)
    counted = joined.withColumn("rate", rate).withColumn("upto", F.floor(upto + 0.5))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("has_src", "src").orderBy(F.desc("size"))), F.lit(0))
    copies = F.least(F.greatest(F.col("upto") - before, F.lit(0)), cap * F.col("n"))
    out = scratch.cut(counted.withColumn("copies", copies).select("has_src", "src", "size", "n", "target", "copies"), "copies")
    for _ in range(FILL_STEPS):
        left = out.groupBy("has_src", "src").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
        both = out.join(left, ["has_src", "src"])
        room = F.when(F.col("left") >= F.col("size"), cap * F.col("n") - F.col("copies")).when(-F.col("left") >= F.col("size"), F.col("copies")).otherwise(0)
        pick = (
            both.withColumn("room", room).filter("size > 0 and room > 0").groupBy("has_src", "src")
            .agg(F.max(F.struct("size", "room", "left")).alias("pick"))
            .select("has_src", "src", "pick.size", (F.signum("pick.left") * F.least(F.col("pick.room"), F.floor(F.abs("pick.left") / F.col("pick.size")))).cast("long").alias("move"))
        )
        pick = scratch.cut(pick, "fill")
        if pick.isEmpty():
            break
        moved = out.join(pick, ["has_src", "src", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("move")
        out = scratch.cut(moved, "copies")
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies, taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.cut(
        docs.select("doc_id", F.col("source").isNotNull().alias("has_src"), F.coalesce("source", F.lit("")).alias("src"), size_of(F.col("text")).alias("size")),
        "sizes",
    )
    classes = scratch.cut(sizes.groupBy("has_src", "src", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    sources = scratch.cut(targets(source_weights(sizes, scratch, weights), cap), "targets")
    copies = class_copies(classes, solve_dual(classes, sources, scratch, cap), scratch, cap)
    key = ["has_src", "src", "size"]
    bucket = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / RANKED_ROWS)).cast("long")
    placed = sizes.join(copies.select(*key, "n", "copies"), key).withColumn("bucket", bucket)
    counts = placed.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("here"))
    earlier = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*key, "bucket", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*key, "bucket").orderBy(F.xxhash64("doc_id"), "doc_id"))
    own = F.floor(F.col("copies") / F.col("n")) + (rank <= F.col("copies") % F.col("n")).cast("long")
    taken = placed.join(before, [*key, "bucket"]).withColumn("own", own.cast("long"))
    return taken.join(sources.select("has_src", "src", "source_size", "target"), ["has_src", "src"]).select(
        "doc_id", F.when(F.col("has_src"), F.col("src")).alias("source"), "size", "source_size", "target", F.col("own").alias("copies"),
        (F.col("own") * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with the number of copies in a further column ``copies``.

    Rows are matched by ``doc_id``; rows that share id, source and size share its copies, the largest number goes to the
    text that is first by its digest. Other columns may have any name and are passed through.
    """
    name, key, at = (fresh(docs, n) for n in ("copies", "key", "at"))
    picked = mix(docs, **options).filter("copies > 0")
    order = Window.partitionBy("doc_id", "source", "size").orderBy(F.desc("copies"))
    picked = picked.select(F.struct("doc_id", "source", "size").alias(key), F.col("copies").alias(name), F.row_number().over(order).alias(at))
    mine = docs.withColumn(key, F.struct("doc_id", "source", size_of(F.col("text")).alias("size")))
    mine = mine.withColumn(at, F.row_number().over(Window.partitionBy(key).orderBy(F.sha2("text", 256))))
    return mine.join(picked, [key, at]).select(*[F.col(f"`{c}`") for c in docs.columns], name)
