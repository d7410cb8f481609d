"""Document likelihood over the lattice of all subword segmentations.

The pieces are those of an existing public vocabulary; its scores give the first piece probabilities, which
``STEPS`` expectation steps over all distinct learning words adapt (each word once: the lattice is for words
not seen before). A word's probability is the sum over all its segmentations, by
forward recursion in log space; bytes are pieces of their own, so every text has a probability. Seen words are
a further arc of their lattice: with N word tokens, V distinct ones and discount D,

    P(word) = (1 - P(end)) * (max(c - D, 0) / N + D * V / N * lattice(word))

which sums to one over all words. The recursion parts at white space, where no piece crosses, so a text's log
probability is the sum over its words and the end; each distinct word's lattice is walked once.

Counts cover all learning rows: tasks count, one aggregation merges. The ``HEAD`` most frequent words (a fixed
number) are sent to all tasks, which settle most tokens on the spot, so no frequent word is ever shuffled; the
rest goes to the count table by a join on the word.

Defined results: null text is empty; an empty text is just its end; without learning rows the lattice alone
counts and P(end) is one half; repeated rows are each scored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, rows_of, text_chunks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAD, HELD_WORDS = 100_000, 400_000
#: Expectation steps, and the uses that the vocabulary's own scores count for.
STEPS, PRIOR_USES = 3, 100.0
LONGEST_PIECE = 16
START = b"\xff"  # stands for the mark before a word; no UTF-8 text has this byte
_LN10 = float(np.log(10))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes and their probabilities.

    The vocabulary ranks its pieces by score; probabilities fall with the rank (Zipf). Every byte is a piece.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", "￾").encode().replace("￾".encode(), START)
        if START not in piece[1:] and len(piece) <= LONGEST_PIECE:
            found[piece] = max(found.get(piece, 0.0), 1.0 / (2.0 - model.get_score(i)))
    least = min(found.values(), default=1.0)
    for b in range(256):
        found.setdefault(bytes([b]), least / 10)
    weights = np.array(list(found.values()))
    return list(found), weights / weights.sum()


class Lattice:
    """All segmentations of words into pieces."""

    def __init__(self, pieces: list[bytes], probabilities: np.ndarray):
        self.pieces, self.logp = pieces, np.log(probabilities)
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.bits = 22
        slots = (self.keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deep = int(np.diff(self.first).max())

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_BASE) + b + 1) & (1 << 64) - 1
        return (h ^ len(piece)) * 0xFF51AFD7ED558CCD & (1 << 64) - 1

    def _find(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        keys = (hashes ^ np.uint64(length)) * np.uint64(0xFF51AFD7ED558CCD)
        at = self.first[(keys >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        out = np.full(keys.shape, -1, np.int64)
        for k in range(self.deep):
            place = np.minimum(at + k, len(self.keys) - 1)
            out = np.where(self.keys[place] == keys, self.ids[place], out)
        return out

    def arcs(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For a matrix of words of one length: piece length and the piece that ends at each position."""
        n = words.shape[1]
        wide, rolling = words.astype(np.uint64) + np.uint64(1), np.zeros_like(words, np.uint64)
        for length in range(1, min(LONGEST_PIECE, n) + 1):
            rolling = rolling[:, : n - length + 1] * _BASE + wide[:, length - 1 :]
            yield length, self._find(rolling, length)

    def walk(self, words: list[bytes], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of each word's marginal; with weights, the expected number of uses of each piece too."""
        out = np.zeros(len(words))
        expected = None if weights is None else np.zeros(len(self.pieces))
        lengths = np.array([len(w) for w in words]) + 1
        for n in np.unique(lengths).tolist():
            every = np.flatnonzero(lengths == n)
            block = max(1, 40_000 // n)
            for start in range(0, len(every), block):
                part = every[start : start + block]
                matrix = np.frombuffer(b"".join(START + words[i] for i in part), np.uint8).reshape(len(part), n)
                longest = min(LONGEST_PIECE, n)
                found = np.full((longest, len(part), n + 1), -1, np.int32)  # by length and end
                for length, ids in self.arcs(matrix):
                    found[length - 1, :, length:] = ids
                cost = np.where(found >= 0, self.logp[found], -np.inf)
                ahead = np.full((len(part), n + 1), -np.inf)
                ahead[:, 0] = 0
                for end in range(1, n + 1):
                    k = min(longest, end)
                    ways = ahead[:, end - k : end][:, ::-1] + cost[:k, :, end].T
                    ahead[:, end] = np.logaddexp.reduce(ways, axis=1)
                out[part] = ahead[:, n]
                if expected is None:
                    continue
                behind = np.full((len(part), n + 1), -np.inf)
                behind[:, n] = 0
                for begin in range(n - 1, -1, -1):
                    k = np.arange(1, min(longest, n - begin) + 1)
                    behind[:, begin] = np.logaddexp.reduce(behind[:, begin + k] + cost[k - 1, :, begin + k].T, axis=1)
                for length in range(1, longest + 1):
                    own = found[length - 1, :, length:]
                    share = np.exp(ahead[:, : n + 1 - length] + cost[length - 1, :, length:] + behind[:, length:] - ahead[:, n:])
                    row, at = np.nonzero(own >= 0)
                    expected += np.bincount(own[row, at], share[row, at] * weights[part[row]], len(expected))
        return out, expected


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a text after lower-casing A-Z, without the end."""
    return text.lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        words = list(held[0].keys() | held[1].keys())
        out = pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "c": pa.array([held[1][w] for w in words], pa.int64()), "used": pa.array([held[0][w] + held[1][w] for w in words], pa.int64())})
        for h in held:
            h.clear()
        return out

    for chunk in text_chunks(batches, "text"):
        for text, learn in zip(rows_of(chunk.column("text")), chunk.column("learn").to_pylist(), strict=True):
            held[bool(learn)].update(tokens_of(text))
            if len(held[0]) + len(held[1]) > HELD_WORDS:
                yield flush()
    yield flush()


class Totals:
    """What scoring needs besides the words: token and word counts, discount, end."""

    def __init__(self, tokens: int, distinct: int, ends: int, once: int, twice: int):
        self.words, self.distinct, self.ends = tokens, distinct, ends
        self.all_tokens = tokens + ends
        all_distinct = distinct + (ends > 0)
        self.base_norm = float(np.log10(self.all_tokens + 0.5 * (all_distinct + 1)))
        self.discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        self.p_end = (ends + 0.5) / (self.all_tokens + 1)

    def score(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 of each word's probability from its count and the natural log of its lattice marginal."""
        if not self.words:
            return np.log10(1 - self.p_end) + lattice / _LN10
        seen = np.maximum(counts - self.discount, 0) / self.words
        with np.errstate(divide="ignore"):
            mixed = np.logaddexp(np.log(seen), np.log(self.discount * self.distinct / self.words) + lattice)
        return np.log10(1 - self.p_end) + mixed / _LN10


def _expected(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.pieces))
        for batch in batches:
            total += shared.value.walk(rows_of(batch.column("word")), np.ones(batch.num_rows))[1]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int64()), "uses": pa.array(total[used])})

    return run


def _valued(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, totals = shared.value
        for batch in batches:
            counts = np.array(batch.column("c").to_pylist(), float)
            logs = lattice.walk(rows_of(batch.column("word")))[0]
            yield pa.RecordBatch.from_pydict({"word": batch.column("word"), "c": batch.column("c"), "used": batch.column("used"), "value": pa.array(totals.score(counts, logs))})

    return run


def _score(shared):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()),
        ("value", pa.float64()), ("rest", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, totals = shared.value
        end_value, end_log = float(np.log10(totals.p_end)), float(np.log10(totals.ends + 0.5))
        for chunk in text_chunks(batches, "text"):
            out = []
            for doc_id, row, text in zip(chunk.column("doc_id").to_pylist(), chunk.column("row").to_pylist(), rows_of(chunk.column("text")), strict=True):
                words = Counter(tokens_of(text))
                known, logs, value, rest = int(totals.ends > 0), end_log, end_value, []
                for word, n in words.items():
                    found = head.get(word)
                    if found is None:
                        rest.append({"word": word, "n": n})
                    else:
                        c, log_c, v = found
                        known += n if c else 0
                        logs += n * log_c
                        value += n * v
                # A row of its own keeps the text in the join; no word has a blank, so it meets no count.
                rest.append({"word": b" %d" % row, "n": 0})
                out.append({"doc_id": doc_id, "row": row, "n_tokens": sum(words.values()) + 1, "n_known": known, "log_counts": logs, "value": value, "rest": rest})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def score_documents(docs: DataFrame, learn, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``learn`` is a boolean column of ``docs``: the rows to learn from.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice-lm")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    counted = docs.select(text, learn.alias("learn")).mapInArrow(_count, "word binary, c bigint, used bigint")
    counts = scratch.cut(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("used").alias("used")), "counts")
    sums = counts.agg(
        F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("once"), F.sum((F.col("c") == 2).cast("long")).alias("twice")
    ).first()
    totals = Totals(sums["n"] or 0, sums["v"] or 0, docs.filter(learn).count(), sums["once"] or 0, sums["twice"] or 0)

    pieces, prior = read_vocabulary(vocabulary)
    now, learned = prior, counts.filter("c > 0").select("word")
    for _ in range(STEPS):
        shared = spark.sparkContext.broadcast(Lattice(pieces, now))
        uses = learned.mapInArrow(_expected(shared), "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        expected = np.zeros(len(pieces))
        for r in uses.collect():  # at most one row per piece of the vocabulary
            expected[r["piece"]] = r["uses"]
        now = (expected + PRIOR_USES * prior) / (expected.sum() + PRIOR_USES)
    model = spark.sparkContext.broadcast((Lattice(pieces, now), totals))

    values = scratch.cut(counts.mapInArrow(_valued(model), "word binary, c bigint, used bigint, value double"), "values")
    scratch.drop(counts)
    log_c = F.log10(F.col("c") + 0.5)
    top = values.orderBy(F.desc("used"), "word").limit(HEAD).select("word", "c", log_c.alias("log_c"), "value").collect()
    head = {bytes(r["word"]): (r["c"], r["log_c"], r["value"]) for r in top}
    shared = spark.sparkContext.broadcast((head, totals))
    ddl = "doc_id bigint, row bigint, n_tokens bigint, n_known bigint, log_counts double, value double, rest array<struct<word: binary, n: bigint>>"
    rows = docs.select(F.col("doc_id").cast("long"), text, F.monotonically_increasing_id().alias("row")).mapInArrow(_score(shared), ddl)
    lone = F.lit(b" ")
    tokens = rows.select("doc_id", "row", "n_tokens", "n_known", "log_counts", "value", F.explode("rest").alias("w")).select(
        "row", "w.word", "w.n", F.when(F.substring("w.word", 1, 1) == lone, F.struct("doc_id", "n_tokens", "n_known", "log_counts", "value")).alias("doc")
    )
    joined = tokens.join(values.select("word", "c", "value"), "word", "left")
    parts = joined.groupBy("row").agg(
        F.max("doc").alias("doc"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.coalesce(log_c, F.lit(0.0))).alias("logs"), F.sum(F.col("n") * F.coalesce("value", F.lit(0.0))).alias("rest"),
    )
    return parts.select(
        "doc.doc_id", "doc.n_tokens", (F.col("doc.n_known") + F.col("known")).alias("n_known"), F.lit(totals.all_tokens).cast("long").alias("train_tokens"),
        (F.col("doc.log_counts") + F.col("logs") - F.col("doc.n_tokens") * F.lit(totals.base_norm)).alias("base_score"),
        (F.col("doc.value") + F.col("rest")).alias("score"),
    )
