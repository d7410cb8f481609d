import random

import duckdb
import pytest

from newsloom.llm import licenses, quotes


def test_equivalent_texts_find_their_licence(spark):
    shouted = "Copyright (c) 2020 A. Person\nAll text below\n".replace("All text below\n", "") + licenses.MIT.upper().replace(",", " ,").replace("SUBLICENSE", "sublicence")
    rows = [
        (1, shouted), (2, licenses.MIT + " and more"), (3, "x\n* Released under the MIT licence!\ny"), (4, None), (5, ""), (6, "...\n---"),
        (7, "© 1999 licensed under cc by-nc 4.0."), (8, "Licensed under CC BY-NC 4.0"), (8, "Licensed under CC BY-NC 4.0"), (None, licenses.ISC),
        (9, "w " * 60_000 + "\nLicensed under the Apache License, Version 2.0."),
        (10, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
    ]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, digest string")
    got = {r.doc_id: (r.license_ids, r.line_license_ids) for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert got == {
        1: ("MIT", ""), 2: ("", ""), 3: ("", "MIT"), 4: ("", ""), 5: ("", ""), 6: ("", ""), 7: ("", ""), 8: ("CC-BY-NC-4.0", "CC-BY-NC-4.0"),
        None: ("ISC", ""), 9: ("", "Apache-2.0"), 10: ("", "CC-BY-NC-4.0,MIT"),
    }
    assert licenses.scan(docs.limit(0), licenses.known_licenses(spark)).count() == 0


def test_common_texts_and_notices_are_known(spark):
    texts = dict(reversed(licenses.known_texts()))
    want = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense", "CC0-1.0"]
    notices = {
        "GPL-2.0": "Licensed under the GNU General Public License v2.0 or later", "AGPL-3.0": "# SPDX-License-Identifier: AGPL-3.0-only", "BSD-3-Clause": "Released under the BSD 3-clause licence.",
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "MPL-2.0": "// Distributed under MPL 2.0",
    }
    bsd = "Copyright 2021, Someone\r\nAll rights reserved.\r\n\r\n" + texts["BSD-3-Clause"].replace("\n", "\r\n")
    rows = [*((i, texts[i].upper()) for i in want), ("BSD-3-Clause", bsd), *((i, f"x\n{n}\ny") for i, n in notices.items())]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.license_ids, r.line_license_ids) for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    whole = len(want) + 1
    assert [got[k][0] for k in range(whole)] == [i for i, _ in rows[:whole]]
    assert [got[k] for k in range(whole, len(rows))] == [("", i) for i in notices]
    assert len(licenses.KNOWN) < 50_000


MESSAGES = [
    (1, 0, "user", "How do I sort a list?\n\nIt has Names."), (1, 1, "assistant", "> how do I sort a list\n\nUse sort."), (1, 2, "user", "unrelated"),
    (1, 3, "user", ">> It has names!\n> Use sort.\nThanks, and reversed?"), (1, 4, "assistant", "> Thanks, and reversed?\n>> nobody said this\nYes: reverse."),
    (1, 5, "user", "> never said\nhm"), (2, 0, "user", "Use sort."), (2, 1, "user", "> Use sort.\r\nok"), (3, 0, "user", None), (3, 1, "user", ""), (3, 2, "user", ">"),
    (3, 3, "user", "> > deep\n>> deep two\n> flat\ntext\n> flat"), (None, 1, "user", "> Use sort."), (4, None, "user", "x"), (5, 2, "u", "> later"), (5, 3, "u", "later"),
]


@pytest.fixture(scope="module")
def linked(spark):
    frame = spark.createDataFrame([(*m, 7) for m in MESSAGES], "conv_id long, turn long, role string, text string, msg int")
    return frame, quotes.link_quotes(frame).collect()


def test_links_bodies_and_threads(linked):
    got = {(r.conv_id, r.turn): r for r in linked[1]}
    assert (got[1, 1].parent_turn, got[1, 1].linked, got[1, 1].body) == (0, True, "Use sort.")
    assert (got[1, 3].parent_turn, got[1, 3].thread, got[1, 3].max_level) == (1, 0, 2)  # the outermost passage decides
    assert (got[1, 4].parent_turn, got[1, 4].thread, got[1, 4].body) == (3, 0, "Yes: reverse.")
    assert (got[1, 5].parent_turn, got[1, 5].linked) == (4, False)
    assert (got[2, 1].parent_turn, got[2, 1].linked, got[2, 1].position) == (0, True, 2)
    assert (got[3, 3].n_quotes, got[3, 3].body) == (3, "text") and got[3, 2].body == ""
    assert got[None, 1].parent_turn is None and not got[5, 2].linked


def equal_to_sql(messages, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [m for m in messages if m[0] is not None and m[1] is not None])
    cur = con.execute(quotes.ORACLE_SQL)
    names = [c[0] for c in cur.description]
    want = sorted((tuple(dict(zip(names, r, strict=True))[n] for n in sorted(names)) for r in cur.fetchall()), key=repr)
    mine = [r.asDict() for r in rows if r.conv_id is not None and r.turn is not None]
    assert sorted((tuple(m[n] for n in sorted(m)) for m in mine), key=repr) == want


def test_equals_sql(linked):
    equal_to_sql(MESSAGES, linked[1])


def test_random_trimmed_quotations_equal_sql(spark):
    rng = random.Random(8)
    messages = []
    for c in range(12):
        bodies: list[str] = []
        for t in range(rng.randrange(2, 9)):
            lines = [rng.choice(["ok", "thanks a lot", "one line", "another line", "", "the rest", "x"]) for _ in range(rng.randrange(0, 8))]
            if bodies and rng.random() < 0.8:
                source = rng.choice(bodies).split("\n")
                i = rng.randrange(len(source))
                lines = [f"> {x}" for x in source[i : i + rng.randrange(1, 6)]] + lines
            bodies.append("\n".join(x for x in lines if not x.startswith(">")).strip())
            messages.append((c, t, "user", "\n".join(lines)))
    frame = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    rows = quotes.link_quotes(frame).collect()
    assert sum(r.linked for r in rows) > 15
    equal_to_sql(messages, rows)


def test_a_long_message_with_many_quotations(spark):
    """5,000 lines and 300 quotations of 2 to 301 lines: one run is formed per quotation, not one per line and length."""
    lines = [f"line number {i} of the long message" for i in range(5000)]
    rows = [(1, 0, "\n".join(lines))] + [(1, 1 + k, "\n".join(f"> {x}" for x in lines[7 * k : 9 * k + 2]) + f"\nanswer {k}") for k in range(300)]
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = quotes.link_quotes(frame).collect()
    assert all(r.linked and r.thread == 0 and r.body == f"answer {r.turn - 1}" for r in got if r.turn) and len(got) == 301


def test_a_long_conversation_is_ranked_by_blocks(spark):
    frame = spark.range(5000).selectExpr("1L AS conv_id", "id * 3 AS turn", "'user' AS role", "concat('text ', id) AS text")
    rows = quotes.link_quotes(frame).orderBy("turn").collect()
    assert [r.position for r in rows] == list(range(1, 5001))
    assert [r.parent_turn for r in rows] == [None, *[3 * i for i in range(4999)]]
    assert quotes.link_quotes(frame.limit(0)).count() == 0


def test_trimmed_quotations_find_their_message(spark):
    text = "First line here.\nSecond line here.\nThird line here.\n\nA second paragraph\nof two lines.\n\nThe last one."
    quoting = [
        ("> first line here\n> second line here", 0), ("> Second line here.\n> Third line here.\nright", 0), ("> Third line here.\n>\n> A second paragraph", 0),
        ("> A second paragraph of\n> two lines.\n> \n> The last one.\nwell", 0), ("> First line here.\n> Third line here.", None), ("> First line here.\n> Second line", None),
        ("> Second line here.\n> Other text.", None),
    ]
    rows = [(1, 0, text), (1, 1, "between"), (1, 2, text), *((1, 3 + i, q) for i, (q, _) in enumerate(quoting)), (2, 0, "x"), (2, 1, quoting[0][0])]
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(frame).collect()}
    assert len(got) == len(rows)
    for i, (_, source) in enumerate(quoting):
        r = got[1, 3 + i]
        assert (r.linked, r.parent_turn) == ((True, source) if source is not None else (False, 2 + i)), i
    assert not got[2, 1].linked
