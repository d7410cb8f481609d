"""Quotation linking for conversations (native).

Lines that start with '>' marks are quotations; the number of marks is their level. Neighbouring lines of one
level form a passage. A passage is normalised (lower case, letters and digits only, single blanks) and hashed,
and so are the unquoted text of every message, its paragraphs, its lines, and the runs of neighbouring lines or
paragraphs that lie around a quotation's longest one as in the quotation, so a trimmed quotation is found whatever it
leaves out before or behind; one that begins or ends within a line is not. A passage is linked to the first earlier message of its
conversation that has the same hash. A message answers the message behind its outermost
linked passage, the last one among equals; without a link it answers the turn before it.

The conversation is then built without quotes: messages in reply order (a message comes after the one it
answers), each with its own text, its position and the thread it belongs to: the first message that its chain
of linked quotations leads to.

Originals are reduced to one row per (conversation, hash) before any join, and the previous turn and position
are found block by block, so one conversation or one repeated text may hold a third of all rows.

Defined results: null text is empty; empty passages are not linked; a message of a null conversation or turn has
no parent, its own thread and position 1; repeated (conversation, turn) rows get the same parent and consecutive
positions; an empty table gives an empty result. Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import bind
from newsloom.llm.common import Scratch

PARAGRAPH = r"\n\s*\n"
KINDS = (("line", "\n"), ("paragraph", PARAGRAPH))
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: Turns that are ranked together.
BLOCK = 1000


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passage_hash(text: Column) -> Column:
    """Digest of a normalised passage; null for an empty one."""
    form = normalised(text)
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def parts_of(text: Column, separator: str) -> Column:
    """Normalised parts of a text in order, without empty ones."""
    return F.filter(F.transform(F.split(text, separator), normalised), lambda x: x != "")


def _counted(parts: Column, kind: str) -> Column:
    return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), F.xxhash64(x).alias("part"), i.alias("at")))


def _longest(parts: Column) -> Column:
    """Place of the longest part, the first among equals."""
    return -F.array_max(F.transform(parts, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("back"))))["back"]


def anchors(passages: DataFrame) -> DataFrame:
    """(conv_id, kind, part, before, size): how a trimmed quotation of several lines or paragraphs lies around its longest one."""
    kinds = []
    for kind, separator in KINDS:
        parts = passages.select("conv_id", parts_of(F.col("passage"), separator).alias("parts")).filter(F.size("parts") > 1)
        longest = parts.withColumn("before", _longest(F.col("parts")).cast("int"))
        kinds.append(longest.select("conv_id", F.lit(kind).alias("kind"), F.xxhash64(F.get("parts", F.col("before"))).alias("part"), "before", F.size("parts").alias("size")))
    return kinds[0].unionByName(kinds[1]).distinct()


def runs(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(msg, runs): for each message the runs of neighbouring lines or paragraphs that some quotation may be.

    A line meets the quotations that have it as their longest one, so a message gives as many runs as it has such
    meetings, however many quotations of whatever length its conversation holds.
    """
    asked = keyed.join(wanted.select("conv_id").distinct(), "conv_id", "left_semi")
    parts = F.concat(*[_counted(parts_of(F.col("body"), separator), kind) for kind, separator in KINDS])
    met = asked.select("conv_id", "msg", F.explode(parts).alias("p")).select("conv_id", "msg", "p.*").join(wanted, ["conv_id", "kind", "part"])
    starts = met.select("msg", "kind", (F.col("at") - F.col("before")).alias("start"), "size").filter("start >= 0")
    return starts.groupBy("msg").agg(F.collect_set(F.struct("kind", "start", "size")).alias("runs"))


def run_texts(body: Column, found: Column) -> Column:
    """Texts of the runs that lie within the message."""
    def of(kind: str, separator: str) -> Column:
        def cut(parts: Column) -> Column:
            inside = F.filter(found, lambda r: (r["kind"] == kind) & (r["start"] + r["size"] <= F.size(parts)))
            return F.transform(inside, lambda r: F.array_join(F.slice(parts, r["start"] + 1, r["size"]), " "))

        return bind(parts_of(body, separator), cut)

    return F.concat(*[of(kind, separator) for kind, separator in KINDS])


def split_lines(messages: DataFrame) -> DataFrame:
    """(msg, no, level, content): the lines of every message that has a quotation."""
    line = F.regexp_replace(F.col("line"), MARKS, "")
    marks = F.regexp_replace(F.regexp_extract("line", MARKS, 1), r"[ \t]", "")
    quoted = messages.filter(F.col("text").rlike(r"(?m)^[ \t]*>"))
    return quoted.select("msg", F.posexplode(F.split("text", "\n")).alias("no", "line")).select("msg", "no", F.length(marks).alias("level"), line.alias("content"))


def passages(lines: DataFrame) -> DataFrame:
    """(msg, first, level, passage): neighbouring lines of one level, quoted ones only."""
    along = Window.partitionBy("msg").orderBy("no")
    starts = lines.withColumn("first", F.when(F.lag("level").over(along).eqNullSafe(F.col("level")), F.lit(None)).otherwise(F.col("no")))
    runs = starts.withColumn("first", F.last("first", ignorenulls=True).over(along)).filter("level > 0")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "content"))), lambda x: x["content"]), "\n")
    return runs.groupBy("msg", "first", "level").agg(texts.alias("passage"))


def _blocked_position(keyed: DataFrame) -> DataFrame:
    """Position of each row in its conversation by turn: rows of earlier blocks of turns plus the rank in its own."""
    blocks = keyed.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("here"), F.max("turn").alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("block")
    blocks = blocks.select(
        "conv_id", "block", F.coalesce(F.sum("here").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("last").over(earlier).alias("last_before")
    )
    own = Window.partitionBy("conv_id", "block").orderBy("turn", "msg")
    turns = Window.partitionBy("conv_id", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return keyed.join(blocks, ["conv_id", "block"]).select(
        "msg", (F.col("before") + F.row_number().over(own)).alias("position"), F.coalesce(F.max("turn").over(turns), "last_before").alias("previous")
    )


def link_quotes(conversations: DataFrame) -> DataFrame:
    """Per row: conv_id, turn, role, n_quotes, max_level, parent_turn, linked, thread, position, body."""
    scratch = Scratch(conversations.sparkSession, "quotes")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", text.alias("text"))
    landed = scratch.cut(rows, "messages")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = landed.select("*", place.alias("msg"))
    lines = split_lines(rows)
    found = scratch.cut(passages(lines).withColumn("hash", passage_hash(F.col("passage"))), "passages")
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("no", "content")))), lambda x: x["content"]), "\n")
    bodies = lines.groupBy("msg").agg(F.trim(F.regexp_replace(own, r"^\s+|\s+$", "")).alias("own"))
    counts = found.groupBy("msg").agg(F.count(F.lit(1)).alias("n_quotes"), F.max("level").alias("max_level"))
    told = rows.join(bodies, "msg", "left").join(counts, "msg", "left").withColumn("body", F.coalesce("own", "text"))

    keyed = told.filter("conv_id is not null and turn is not null").select("conv_id", "turn", "msg", "body")
    quoting = found.filter("hash is not null").join(keyed.select("msg", "conv_id", "turn"), "msg")
    quoted = keyed.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi").join(runs(keyed, anchors(quoting)), "msg", "left")
    trimmed = F.coalesce(run_texts(F.col("body"), F.col("runs")), F.array().cast("array<string>"))
    units = F.concat(F.array("body"), F.split("body", PARAGRAPH), F.split("body", "\n"), trimmed)
    originals = (
        quoted.select("conv_id", "turn", F.explode(F.array_distinct(units)).alias("unit")).withColumn("hash", passage_hash(F.col("unit")))
        .filter("hash is not null").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    )
    links = (
        quoting.join(originals, ["conv_id", "hash"]).filter("source < turn")
        .groupBy("msg", "conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "first", "source")).alias("best"))
        .select("msg", "conv_id", "turn", F.col("best.source").alias("quoted_turn"))
    )
    links = scratch.cut(links, "links")

    # Threads: chains of quotations are halved until each leads to its first message.
    chain = scratch.cut(links.groupBy("conv_id", "turn").agg(F.min("quoted_turn").alias("up")), "chain")
    while True:
        above = chain.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("upper"))
        step = scratch.cut(chain.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")), "chain")
        chain = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    places = _blocked_position(keyed.withColumn("block", F.floor(F.col("turn") / BLOCK)))
    out = (
        told.join(links.select("msg", "quoted_turn"), "msg", "left").join(places, "msg", "left")
        .join(chain.select("conv_id", "turn", "up"), ["conv_id", "turn"], "left")
    )
    return out.select(
        "conv_id", "turn", "role", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"),
        F.coalesce("quoted_turn", "previous").alias("parent_turn"), F.col("quoted_turn").isNotNull().alias("linked"), F.coalesce("up", "turn").alias("thread"),
        F.coalesce("position", F.lit(1)).cast("long").alias("position"), "body",
    )


ORACLE_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text FROM conversations),
l AS (SELECT rid, conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS no, unnest(string_split(text, chr(10))) AS line FROM m WHERE regexp_matches(text, '(?m)^[ \t]*>')),
q AS (SELECT rid, conv_id, turn, no, len(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1), '[ \t]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*((?:>[ \t]?)+)', '') AS content FROM l),
r AS (SELECT *, no - row_number() OVER (PARTITION BY rid, level ORDER BY no) AS run FROM q),
g AS (SELECT rid, conv_id, turn, level, min(no) AS first, string_agg(content, chr(10) ORDER BY no) AS raw FROM r WHERE level > 0 GROUP BY rid, conv_id, turn, level, run),
p AS (SELECT rid, conv_id, turn, level, first, trim(regexp_replace(lower(raw), '[^\p{L}\p{N}]+', ' ', 'g')) AS form,
      array_to_string([x FOR x IN [trim(regexp_replace(lower(v), '[^\p{L}\p{N}]+', ' ', 'g')) FOR v IN string_split(raw, chr(10))] IF x <> ''], chr(10)) AS by_line,
      array_to_string([x FOR x IN [trim(regexp_replace(lower(v), '[^\p{L}\p{N}]+', ' ', 'g')) FOR v IN regexp_split_to_array(raw, '\n\s*\n')] IF x <> ''], chr(10)) AS by_paragraph FROM g),
o AS (SELECT rid, trim(regexp_replace(coalesce(string_agg(content, chr(10) ORDER BY no) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g')) AS own FROM q GROUP BY rid),
t AS (SELECT m.*, coalesce(own, text) AS body FROM m LEFT JOIN o USING (rid)),
z AS (SELECT conv_id, turn, body, string_split(body, chr(10)) AS ls, regexp_split_to_array(body, '\n\s*\n') AS ps FROM t WHERE conv_id IN (SELECT conv_id FROM p)),
y AS (SELECT conv_id, turn, body, ls, ps, [x FOR x IN [trim(regexp_replace(lower(v), '[^\p{L}\p{N}]+', ' ', 'g')) FOR v IN ls] IF x <> ''] AS nl,
      [x FOR x IN [trim(regexp_replace(lower(v), '[^\p{L}\p{N}]+', ' ', 'g')) FOR v IN ps] IF x <> ''] AS np FROM z),
u AS (SELECT conv_id, turn, 0 AS kind, trim(regexp_replace(lower(unit), '[^\p{L}\p{N}]+', ' ', 'g')) AS form FROM (SELECT conv_id, turn, unnest(list_distinct(list_concat([body], ps, ls))) AS unit FROM y)
      UNION ALL SELECT conv_id, turn, 1, unnest(flatten([[array_to_string(nl[i : j], chr(10)) FOR j IN range(i, len(nl) + 1)] FOR i IN range(1, len(nl) + 1)])) FROM y
      UNION ALL SELECT conv_id, turn, 2, unnest(flatten([[array_to_string(np[i : j], chr(10)) FOR j IN range(i, len(np) + 1)] FOR i IN range(1, len(np) + 1)])) FROM y),
s AS (SELECT conv_id, kind, form, min(turn) AS source FROM u WHERE form <> '' GROUP BY conv_id, kind, form),
f AS (SELECT rid, p.conv_id, p.turn, level, first, min(source) AS source FROM p JOIN s ON s.conv_id = p.conv_id AND source < p.turn
      AND s.form = CASE kind WHEN 0 THEN p.form WHEN 1 THEN by_line ELSE by_paragraph END GROUP BY rid, p.conv_id, p.turn, level, first),
k AS (SELECT rid, conv_id, turn, arg_max(source, struct_pack(a := -level, b := first)) AS quoted FROM f GROUP BY rid, conv_id, turn),
c AS (SELECT conv_id, turn, min(quoted) AS up FROM k GROUP BY conv_id, turn),
w AS (SELECT conv_id, turn, up FROM c UNION SELECT w.conv_id, w.turn, c.up FROM w JOIN c ON c.conv_id = w.conv_id AND c.turn = w.up),
h AS (SELECT conv_id, turn, min(up) AS thread FROM w GROUP BY conv_id, turn),
n AS (SELECT rid, count(*) AS n_quotes, max(level) AS max_level FROM p GROUP BY rid)
SELECT t.conv_id, t.turn, t.role, coalesce(n_quotes, 0) AS n_quotes, coalesce(max_level, 0) AS max_level,
       coalesce(quoted, lag(t.turn) OVER (PARTITION BY t.conv_id ORDER BY t.turn)) AS parent_turn, quoted IS NOT NULL AS linked, coalesce(thread, t.turn) AS thread,
       row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn) AS position, body
FROM t LEFT JOIN n USING (rid) LEFT JOIN k USING (rid) LEFT JOIN h ON h.conv_id = t.conv_id AND h.turn = t.turn
"""
