"""Cross-tokenizer alignment against a plain merge of token ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import alignment


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(alignment.TOKENIZER_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.TOKENIZER_B)


def plain(models, text):
    """Groups of one text from the two libraries and the set of common ends; none if a tokenizer changes the text."""
    a, b = models
    if not text:
        return []
    byte_of = {}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    ends = [np.cumsum([len(x) for x in xs]).tolist() for xs in (bytes_a, bytes_b)]
    common, groups = sorted(set(ends[0]) & set(ends[1])), []
    i = j = 0
    for end in common:
        i2, j2 = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        starts = [[e - len(x) for e, x in zip(es[lo:hi], xs[lo:hi])] for es, xs, lo, hi in ((ends[0], bytes_a, i, i2), (ends[1], bytes_b, j, j2))]
        links = [(ids_a[i + p], ids_b[j + q]) for p in range(i2 - i) for q in range(j2 - j) if max(starts[0][p], starts[1][q]) < min(ends[0][i + p], ends[1][j + q])]
        groups.append((ids_a[i:i2], ids_b[j:j2], links))
        i, j = i2, j2
    return groups


def expected(models, texts):
    found = [plain(models, t) for t in texts]
    counts = Counter(x for gs in found for g in gs for x in g[2])
    most: dict = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for gs in found:
        links = [x for g in gs for x in g[2]]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in gs)
        digest = hashlib.sha256(written.encode()).hexdigest() if gs else ""
        out.append((sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


TEXTS = [
    None, "", " ", "  ", "a", "Hello world", "two  blanks   and more ", " leading", "tab\tand\nlines\r\n\r\n  end", "schöne Grüße, où ça?",
    "Привет мир недоразумение", "日本語のテキスト", "emoji 👩‍👩‍👧 x", "<s> </s> <unk> <|endoftext|> <0x41>", "a▁b under", "nul\x00byte   　wide", "ﬁ ligature ① é é",
    "supercalifragilisticexpialidocious 1234567890 don't we'll", "same text here", "same text here", "x" * 500, " " * 300 + "y", "\n" * 200, "१२३ हिन्दी पाठ", "﻿bom ​zero",
]


def rows(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, row string, pairs long").repartition(3)
    return [tuple(r)[1:] for r in alignment.link_report(docs, **options).orderBy("doc_id").collect()]


def test_report_equals_brute_force(spark, models):
    assert rows(spark, TEXTS) == expected(models, TEXTS)


def test_blocks_of_pairs_give_the_same(spark, models):
    assert rows(spark, TEXTS, block_pairs=40) == expected(models, TEXTS)


def test_random_texts(models):
    rng = random.Random(5)
    aligner = alignment.Aligner(*alignment.specs())
    texts = ["".join(rng.choice("ab e1 é.Ж\n漢'") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    x = aligner.align(texts)
    want = [plain(models, t) for t in texts]
    got = [(x["ids_a"][a0:a1].tolist(), x["ids_b"][b0:b1].tolist()) for a0, a1, b0, b1 in zip(x["a0"], x["a1"], x["b0"], x["b1"])]
    assert got == [(list(a), list(b)) for gs in want for a, b, _ in gs]
    assert x["good"].tolist() == [bool(g) for g in want]
    assert (x["a1"] - x["a0"]).max() > 1 and (x["b1"] - x["b0"]).max() > 1


def test_long_texts_are_parted_without_a_trace(spark, models, monkeypatch):
    aligner = alignment.Aligner(*alignment.specs())
    rng = random.Random(3)
    text = "".join(rng.choice(["word", " ", "  ", " ünder", " the", " quick", "ly ", "\n", " 12"]) for _ in range(4000))
    whole = aligner.align([text])
    monkeypatch.setattr(alignment, "PART_CHARS", 500)
    parts = aligner.parts(text)
    assert len(parts) > 10 and sum(map(len, parts)) + len(parts) - 1 == len(text)
    parted = aligner.align(parts)
    for ids in ("ids_a", "ids_b"):
        assert parted[ids].tolist() == whole[ids].tolist()
    assert len(parted["a0"]) == len(whole["a0"])


def test_empty_table_and_groups(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_report(empty).collect() == []
    docs = spark.createDataFrame([(1, "Hello world"), (2, None), (None, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["groups"] for r in alignment.align_documents(docs).collect()}
    assert got[2] == [] and got[None] == [] and [len(g["a"]) for g in got[1]] == [1, 1]


def test_equal_bytes_for_the_given_documents(spark, models):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [tuple(r)[1:] for r in alignment.link_report(docs).orderBy("doc_id").collect()]
    texts = [r["text"] for r in docs.orderBy(F.col("doc_id")).collect()]
    assert got == expected(models, texts)
