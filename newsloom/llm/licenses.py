"""Canonical licence digests (native).

A text is brought to a canonical form (lower case, copyright lines dropped, equivalent spellings unified,
punctuation and white space folded) and looked up by digest in a table of known licences. A document is looked
up as a whole and, since notices are texts of one line, line by line.

Known licences are a table (license_id, text): the full texts packaged in ``license_texts.jsonl`` (with and without
title, appendix and the usual differences between copies) and one-line notices that name a licence. The driver
reads the file, so tasks need no path; the table is digested by the same expressions as the documents and joined by
hash. It is broadcast only after its rows are counted, so the lines meet it where they are read.

Whole texts are found as wholes: a licence followed by other text, or one whose line breaks put "copyright" first
in a line where no packaged copy does, is not. Notices of several lines count as texts.

Defined results: null, empty and punctuation-only texts have the empty canonical form, which matches nothing;
equal texts of two licences report both ids, sorted; repeated rows are each reported; an empty table gives an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.skew import counted_broadcast

# Public licence texts and one-line notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
# Names of licences in notices, the identifier first.
_VERSIONED = [
    ("Apache", "Apache License", ("1.1", "2.0")), ("GPL", "GNU General Public License", ("1.0", "2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")),
    ("LGPL", "GNU Library General Public License", ("2.0",)), ("AGPL", "GNU Affero General Public License", ("3.0",)), ("MPL", "Mozilla Public License", ("1.0", "1.1", "2.0")),
    ("EPL", "Eclipse Public License", ("1.0", "2.0")), ("GFDL", "GNU Free Documentation License", ("1.1", "1.2", "1.3")), ("CDDL", "Common Development and Distribution License", ("1.0", "1.1")),
    ("EUPL", "European Union Public Licence", ("1.1", "1.2")), ("BSL", "Boost Software License", ("1.0",)), ("OFL", "SIL Open Font License", ("1.1",)), ("Artistic", "Artistic License", ("1.0", "2.0")),
]
_NAMED = {
    "MIT": ("MIT", "Expat"), "ISC": ("ISC",), "Unlicense": ("Unlicense",), "WTFPL": ("WTFPL",), "Zlib": ("zlib",), "NCSA": ("NCSA", "University of Illinois/NCSA Open Source"),
    "0BSD": ("0BSD", "Zero-Clause BSD", "BSD Zero Clause"), "BSD-2-Clause": ("BSD-2-Clause", "BSD 2-Clause", "2-Clause BSD", "Simplified BSD", "FreeBSD"),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD", "Revised BSD"), "BSD-4-Clause": ("BSD-4-Clause", "BSD 4-Clause", "4-Clause BSD", "Original BSD"),
}
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_OPENINGS = ["Licensed under ", "Released under ", "Distributed under ", "This work is licensed under ", "This project is licensed under ", "This software is licensed under "]


def _names() -> list[tuple[str, str]]:
    """(license_id, name as notices give it); punctuation does not count."""
    out = [(i, article + name + tail) for i, names in _NAMED.items() for name in names for article in ("", "the ") for tail in ("", " License")]
    for short, long, versions in _VERSIONED:
        later = ("", " or later", ", or any later version") if "GNU" in long else ("",)
        forms = (f"the {long}", long, f"the {short}", short, *((f"the GNU {short}",) if "GNU" in long else ()))
        numbers = [(v, n) for v in versions for n in dict.fromkeys((v, v.removesuffix(".0")))]
        out += [(f"{short}-{v}", f"{name}{mark}{n}{more}") for name in forms for v, n in numbers for mark in (" ", ", version ", " v") for more in later]
    for short, long in _CC.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            reach = "International" if v == "4.0" else "Unported"
            names = (f"CC {short} {v}", f"Creative Commons {short} {v}", *(f"{the}Creative Commons {long} {v}{r}" for the in ("", "the ", "a ") for r in ("", f" {reach}", " License", f" {reach} License")))
            out += [(f"CC-{short}-{v}", name) for name in names]
    return out + [("CC0-1.0", name) for name in ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "the Creative Commons Zero License", "the Creative Commons CC0 1.0 Universal License")]


def known_notices() -> list[tuple[str, str]]:
    """(license_id, notice): one-line notices, among them SPDX lines."""
    names = _names()
    spdx = [(i, f"SPDX-License-Identifier: {i}{more}") for i in sorted({i for i, _ in names}) for more in ("", "-only", "-or-later")]
    return [(i, f"{opening}{name}.") for i, name in names for opening in _OPENINGS] + spdx


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text): the packaged full texts and standard notices of several lines."""
    with Path(__file__).with_name("license_texts.jsonl").open(encoding="utf-8") as lines:
        return [(r["license_id"], r["text"]) for r in map(json.loads, lines)]


KNOWN = [("MIT", MIT), ("ISC", ISC), *known_texts(), *known_notices()]
# Spellings that count as equal, the second is used.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("organisation", "organization"), ("per cent", "percent"),
]
COPYRIGHT_LINE = r"(?m)^[^\p{L}\n(©]*(copyright|\(c\)|©)[^\n]*$"
LINE_COPYRIGHT = r"^[^\p{L}(©]*(copyright|\(c\)|©)"
OTHER = r"[^\p{L}\p{N}]+"


def _folded(lowered: Column) -> Column:
    """Letters and digits of lower-cased text, parted by single blanks, in unified spelling; blanks at both ends."""
    out = F.concat(F.lit(" "), F.regexp_replace(lowered, OTHER, " "), F.lit(" "))
    for other, used in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {used} "))
    return F.trim(out)


def canonical(text: Column) -> Column:
    """Canonical form of a whole text."""
    return _folded(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " "))


def digest(form: Column) -> Column:
    """Digest of a canonical form; null for the empty one."""
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id) of a table of known licences."""
    return known.select(digest(canonical(F.col("text"))).alias("digest"), "license_id").filter("digest is not null").distinct()


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def _ids(known: DataFrame, name: str) -> DataFrame:
    ids = known_digests(known).groupBy("digest").agg(F.array_sort(F.collect_set("license_id")).alias(name))
    return counted_broadcast(ids.withColumnRenamed("digest", f"{name}_digest"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per row: doc_id, text_digest, license_ids (whole text), line_license_ids, each sorted and comma-joined."""
    rows = docs.select("doc_id", digest(canonical(F.col("text"))).alias("text_digest"), F.split(F.lower("text"), "\n").alias("lines"), F.monotonically_increasing_id().alias("row"))
    lines = rows.select("doc_id", "text_digest", "row", F.explode_outer("lines").alias("line"))
    form = F.when(~F.col("line").rlike(LINE_COPYRIGHT), digest(_folded(F.col("line"))))
    line_ids, ids = _ids(known.filter(~F.col("text").contains("\n")), "line_ids"), _ids(known, "ids")
    found = (
        lines.withColumn("line_digest", form).join(line_ids, F.col("line_digest") == F.col("line_ids_digest"), "left")
        .groupBy("row", "doc_id", "text_digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("line_ids")))).alias("line_ids"))
    )
    joined = found.join(ids, F.col("text_digest") == F.col("ids_digest"), "left")
    return joined.select(
        "doc_id", "text_digest", F.coalesce(F.array_join("ids", ","), F.lit("")).alias("license_ids"),
        F.coalesce(F.array_join("line_ids", ","), F.lit("")).alias("line_license_ids"),
    )


def _sql_folded(lowered: str) -> str:
    out = f"(' ' || regexp_replace({lowered}, '{OTHER}', ' ', 'g') || ' ')"
    for other, used in SPELLINGS:
        out = f"replace({out}, ' {other} ', ' {used} ')"
    return f"trim({out})"


def _sql_digest(form: str) -> str:
    return f"CASE WHEN {form} <> '' THEN sha256({form}) END"


def oracle_sql() -> str:
    """The scan of ``documents`` in DuckDB."""
    known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    whole = _sql_folded(f"regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT_LINE}', ' ', 'g')")
    return f"""
WITH known AS (SELECT license_id, text, {_sql_digest(whole)} AS digest FROM (VALUES {known}) AS v(license_id, text)),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, {_sql_digest(whole)} AS text_digest FROM documents),
lines AS (SELECT rid, unnest(string_split(lower(text), chr(10))) AS line FROM d),
found AS (
  SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
  FROM (SELECT rid, {_sql_digest(_sql_folded("line"))} AS digest FROM lines WHERE NOT regexp_matches(line, '{LINE_COPYRIGHT}')) AS l
  JOIN known USING (digest) WHERE known.text NOT LIKE '%' || chr(10) || '%' GROUP BY rid),
whole AS (SELECT digest, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM known GROUP BY digest)
SELECT d.doc_id, d.text_digest, coalesce(whole.ids, '') AS license_ids, coalesce(found.ids, '') AS line_license_ids
FROM d LEFT JOIN found USING (rid) LEFT JOIN whole ON whole.digest = d.text_digest
"""
