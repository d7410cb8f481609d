"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Each text is encoded by two public tokenizers: A is byte-level merges, B pieces with byte fallback. Both cut the
same bytes (a space and the text), so their tokens end at byte offsets of one line. An interval of that line is
split at a common end near its middle: the ends of A are tried from the middle outwards, each looked up among
the ends of B by bisection; both halves go on alike, and an interval without a common end is a group. All
intervals of one depth, over all texts of a chunk, are split together.

Links are the A-B tokens of a group whose bytes overlap. How often each pair of ids is linked is counted over
the corpus by one aggregation of per-chunk counts; the counts return to the rows in blocks of ``BLOCK_PAIRS``
pairs, one broadcast at a time, so no row moves and no frequent pair meets in one task.

Memory: texts are handled in parts of ``PART_CHARS``; longer ones are parted at a single blank between two ASCII
letters, where both tokenizers are certain to cut. Only a text without such a place is held whole.

Defined results: null and empty texts have no tokens, and so have texts that one of the tokenizers doesn't give
back byte by byte; their columns are zero and the digest empty. Repeated rows are each aligned and all count;
an empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, text_chunks

TOKENIZER_A, TOKENIZER_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_BYTES, PART_CHARS = 1 << 20, 1 << 20
#: Pairs of ids in a broadcast block (17 bytes each).
BLOCK_PAIRS = 2_000_000
#: Words and tokens that a tokenizer remembers before it starts anew.
KNOWN_WORDS, KNOWN_TOKENS = 300_000, 3_000_000

# The pattern that parts texts before byte-level merges.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_SPACED = re.compile(r" +[^ ]*")


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Tokens:
    """The bytes of every id of a vocabulary."""

    def __init__(self, table: list[bytes]):
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.blob[ragged(self.starts[ids], self.lengths[ids])]


class ByteLevel:
    """Tokenizer A, from the JSON file of a byte-level merge vocabulary."""

    def __init__(self, spec: bytes):
        parsed = json.loads(spec)
        vocabulary, merges = parsed["model"]["vocab"], parsed["model"]["merges"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from 256
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        special = {t["content"] for t in parsed["added_tokens"]}
        plain = {t: i for t, i in vocabulary.items() if t not in special}
        of = {i: bytes(byte_of[c] for c in t) for t, i in plain.items()}
        self.tokens = Tokens([of.get(i, b"") for i in range(max(vocabulary.values()) + 1)])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        # If ids follow the order of merges, they are the ranks of the faster encoder.
        ranked = sorted(of) == list(range(256 + len(pairs))) and all(vocabulary["".join(p)] == 256 + i for i, p in enumerate(pairs))
        self.fast = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks={t: i for i, t in of.items()}, special_tokens={}) if ranked else None
        self._spec, self._slow = spec, None

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            self._slow = tokenizers.Tokenizer.from_str(self._spec.decode())
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a blank and each text, one after the other, and their number per text."""
        found = []
        for text in texts:
            if self.fast:
                try:
                    found.append(self.fast.encode_to_numpy(" " + text, disallowed_special=()))
                    continue
                except ValueError:  # its pattern engine gives up on very long runs
                    pass
            found.append(np.array(self.slow(" " + text), np.uint32))
        return np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.int64), np.array([len(f) for f in found], np.int64)


class Pieces:
    """Tokenizer B, from a model file; it puts a blank before each text itself.

    No piece goes on into a blank after another character (checked), so a text's ids are those of its words,
    each with the blanks before it, and words seen before are looked up.
    """

    def __init__(self, spec: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=spec)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        plain = [not (self.model.is_control(i) or self.model.is_unknown(i)) for i in range(n)]
        table = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.tokens = Tokens([t if ok else b"" for t, ok in zip(table, plain, strict=True)])
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces)
        self.blank = self.model.piece_to_id("▁")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a blank and each text, one after the other, and their number per text."""
        if not self.by_word:
            found = self.model.encode(texts, num_threads=1)
            return np.array([i for f in found for i in f], np.int64), np.array([len(f) for f in found], np.int64)
        words: list[str] = []
        counts = []
        for text in texts:
            mine = _SPACED.findall(" " + text)
            words += mine
            counts.append(len(mine))
        new = list(set(words) - self.known.keys())
        if len(self.known) + len(new) > KNOWN_WORDS or len(self.ids) > KNOWN_TOKENS:
            self._forget()
            new = list(set(words))
        if new:
            found = [f or [self.blank] for f in self.model.encode([w[1:] for w in new], num_threads=1)]
            self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, np.array([i for f in found for i in f], np.int64)])
            self.sizes = np.concatenate([self.sizes, np.array([len(f) for f in found], np.int64)])
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        ids = self.ids[ragged((np.cumsum(self.sizes) - self.sizes)[at], sizes)]
        ends = np.cumsum(np.array(counts, np.int64))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return ids, upto[ends] - upto[ends - np.array(counts, np.int64)]


def middle_cuts(a0: np.ndarray, a1: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval of A tokens [a0, a1): the token nearest to the middle with an inner end that B has too, and B's token; -1 if none.

    Ends of A are tried from the middle outwards, each by bisection among the ends of B.
    """
    cut_a, cut_b = np.full(len(a0), -1), np.full(len(a0), -1)
    left, step = np.arange(len(a0)), 0
    middle = (a0 + a1 - 1) >> 1
    while len(left):
        for side in (1, -1) if step else (1,):
            at = middle[left] + side * step
            inner = (at >= a0[left]) & (at < a1[left] - 1)
            tried, place = left[inner], at[inner]
            end = ends_a[place]
            b = np.searchsorted(ends_b, end)
            same = ends_b[b] == end
            cut_a[tried[same]], cut_b[tried[same]] = place[same], b[same]
            left = left[cut_a[left] < 0]
        step += 1
        left = left[(middle[left] + step < a1[left] - 1) | (middle[left] - step >= a0[left])]
    return cut_a, cut_b


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray, tops: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Token ranges (a0, a1, b0, b1) of all groups, in order; ``tops`` are the ranges of whole texts."""
    leaves, now = [], tops
    while len(now[0]):
        a0, a1, b0, b1 = now
        parted = (a1 - a0 > 1) & (b1 - b0 > 1)
        cut_a, cut_b = np.full(len(a0), -1), np.full(len(a0), -1)
        cut_a[parted], cut_b[parted] = middle_cuts(a0[parted], a1[parted], ends_a, ends_b)
        whole = cut_a < 0
        leaves.append([x[whole] for x in now])
        a0, a1, b0, b1, cut_a, cut_b = (x[~whole] for x in (a0, a1, b0, b1, cut_a + 1, cut_b + 1))
        now = tuple(np.column_stack(halves).ravel() for halves in ((a0, cut_a), (cut_a, a1), (b0, cut_b), (cut_b, b1)))
    a0, a1, b0, b1 = (np.concatenate(x) for x in zip(*leaves, strict=True)) if leaves else tops
    order = np.argsort(a0, kind="stable")
    return a0[order], a1[order], b0[order], b1[order]


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B of every overlap, in order: each starts where one of its two tokens starts."""
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def _decimal(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every id below ``size`` as digits in the low bytes of a number, and the number of its digits."""
    shown = [str(i).encode() for i in range(size)]
    return np.array([int.from_bytes(s, "little") for s in shown], np.uint64), np.array([len(s) for s in shown], np.int64)


class Aligner:
    """Both tokenizers and the alignment of chunks of texts."""

    def __init__(self, spec_a: bytes, spec_b: bytes):
        self.a, self.b = ByteLevel(spec_a), Pieces(spec_b)
        self.size_b = len(self.b.tokens.lengths)
        self.digits, self.widths = _decimal(max(len(self.a.tokens.lengths), self.size_b))

    def parts(self, text: str) -> list[str]:
        """The text, or if it is long, parts that leave out the blank at each cut (both tokenizers put it back)."""
        out, at = [], 0
        while self.b.by_word and len(text) - at > PART_CHARS:
            cut = _SAFE_CUT.search(text, at + PART_CHARS // 2)
            if not cut:
                break
            out.append(text[at : cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def align(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Ids and group ranges of texts that are not empty; ``good``: those that both tokenizers give back."""
        raw = [(" " + t).encode() for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        good = np.ones(len(texts), bool)
        ids, counts = [], []
        for tokenizer in (self.a, self.b):
            i, n = tokenizer.encode(texts)
            upto = np.concatenate([[0], np.cumsum(tokenizer.tokens.lengths[i])])
            good &= np.diff(upto[np.concatenate([[0], np.cumsum(n)])]) == sizes
            ids.append(i)
            counts.append(n)
        for k, tokenizer in enumerate((self.a, self.b)):
            ids[k], counts[k] = ids[k][np.repeat(good, counts[k])], counts[k][good]
            data = np.frombuffer(b"".join(r for r, g in zip(raw, good, strict=True) if g), np.uint8)
            wrong = np.flatnonzero(tokenizer.tokens.joined(ids[k]) != data)
            if len(wrong):  # as long, but other bytes
                kept = np.flatnonzero(good)
                good[kept[np.searchsorted(np.cumsum(sizes[kept]), wrong, side="right")]] = False
                return self._again(texts, good)
        tops = [x for n in counts for x in (np.cumsum(n) - n, np.cumsum(n))]
        ends = [np.cumsum(t.tokens.lengths[i]) for t, i in zip((self.a, self.b), ids, strict=True)]
        a0, a1, b0, b1 = groups_of(*ends, tuple(tops))
        return {"good": good, "ids_a": ids[0], "ids_b": ids[1], "n_a": counts[0], "n_b": counts[1], "ends_a": ends[0], "ends_b": ends[1], "a0": a0, "a1": a1, "b0": b0, "b1": b1}

    def _again(self, texts: list[str], good: np.ndarray) -> dict[str, np.ndarray]:
        found = self.align([t for t, g in zip(texts, good, strict=True) if g])
        good[good] = found["good"]
        return found | {"good": good}

    def written(self, x: dict[str, np.ndarray]) -> tuple[bytes, np.ndarray]:
        """Groups as ``a1,a2|b1;...`` of all good texts, one after the other, and the end of each."""
        in_a, in_b = np.arange(len(x["ids_a"])) + np.repeat(x["b0"], x["a1"] - x["a0"]), np.arange(len(x["ids_b"])) + np.repeat(x["a1"], x["b1"] - x["b0"])
        ids = np.empty(len(in_a) + len(in_b), np.int64)
        ids[in_a], ids[in_b] = x["ids_a"], x["ids_b"]
        mark = np.full(len(ids), ord(","), np.uint64)
        mark[in_a[x["a1"] - 1]], mark[in_b[x["b1"] - 1]] = ord("|"), ord(";")
        last = np.cumsum(x["n_a"] + x["n_b"]) - 1
        mark[last] = 0
        width = self.widths[ids]
        cells = (self.digits[ids] | mark << (width * 8).astype(np.uint64)).view(np.uint8)
        return cells[cells > 0].tobytes(), np.cumsum(width + (mark > 0))[last]


_ALIGNERS: dict[int, Aligner] = {}


def aligner_of(specs: tuple[bytes, bytes]) -> Aligner:
    """The worker process's aligner for two vocabularies."""
    key = hash(specs)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*specs)
    return _ALIGNERS[key]


def _aligned_parts(aligner: Aligner, texts: list[str | None]) -> Iterator[tuple[list[int], dict[str, np.ndarray]]]:
    """Owners (rows of ``texts``) of some parts, and these parts aligned; parts come in order."""
    owners: list[int] = []
    parts: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        for part in aligner.parts(text) if text else ():
            if held and held + len(part) > PART_CHARS:
                yield owners, aligner.align(parts)
                owners, parts, held = [], [], 0
            owners.append(row)
            parts.append(part)
            held += len(part)
    if parts:
        yield owners, aligner.align(parts)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(weights, starts)


DIGEST = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def _digests(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(shared.value)
        bits = (len(aligner.a.tokens.lengths) * aligner.size_b).bit_length()
        for chunk in text_chunks(batches, "text", CHUNK_BYTES):
            rows = chunk.num_rows
            sums, bad, hashes = np.zeros((rows, 4), np.int64), np.zeros(rows, bool), [None] * rows
            keys, weights = [], []
            for owners, x in _aligned_parts(aligner, chunk.column("text").to_pylist()):
                owner = np.array(owners)
                bad[owner[~x["good"]]] = True
                owner = owner[x["good"]]
                if not len(owner):
                    continue
                groups = np.diff(np.searchsorted(x["a0"], np.concatenate([np.cumsum(x["n_a"]) - x["n_a"], [len(x["ids_a"])]])))
                a, b = links_of(x["ends_a"], x["ends_b"])
                part = np.repeat(np.arange(len(owner)), x["n_a"])[a]
                np.add.at(sums, owner, np.column_stack([x["n_a"], x["n_b"], groups, np.bincount(part, minlength=len(owner))]))
                found, times = np.unique(owner[part] << bits | x["ids_a"][a] * aligner.size_b + x["ids_b"][b], return_counts=True)
                keys.append(found)
                weights.append(times)
                text, ends = aligner.written(x)
                start = 0
                for row, end in zip(owner.tolist(), ends.tolist(), strict=True):
                    if hashes[row] is None:
                        hashes[row] = hashlib.sha256()
                    else:
                        hashes[row].update(b";")
                    hashes[row].update(text[start:end])
                    start = end
            sums[bad] = 0
            found, times = summed(np.concatenate(keys), np.concatenate(weights)) if keys else (np.zeros(0, np.int64),) * 2
            good = ~bad[found >> bits]
            found, times = found[good], times[good]
            upto = np.searchsorted(found >> bits, np.arange(rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), **{name: pa.array(sums[:, i]) for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                "groups_sha256": pa.array(["" if h is None or b else h.hexdigest() for h, b in zip(hashes, bad.tolist(), strict=True)]),
                "pairs": pa.ListArray.from_arrays(upto, found & (1 << bits) - 1), "times": pa.ListArray.from_arrays(upto, times.astype(np.int32)),
            })

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the place where each row ends."""
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, weights, held = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"pair": pa.array(keys[0]), "n": pa.array(weights[0])})

    for b in batches:
        keys.append(_flat(b.column("pairs"))[0])
        weights.append(_flat(b.column("times"))[0].astype(np.int64))
        held += len(keys[-1])
        if held > 2 * BLOCK_PAIRS:
            k, w = summed(np.concatenate(keys), np.concatenate(weights))
            keys, weights, held = [k], [w], len(k)
            if held > BLOCK_PAIRS:
                yield batch()
                keys, weights, held = [], [], 0
    if held:
        k, w = summed(np.concatenate(keys), np.concatenate(weights))
        keys, weights = [k], [w]
        yield batch()


def _weigh(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        for b in batches:
            mine, ends = _flat(b.column("pairs"))
            times = _flat(b.column("times"))[0].astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, mine), max(len(pairs) - 1, 0))
            hit = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
            per_link = [np.where(hit, values[at], 0) * times if len(pairs) else times * 0 for values in (best, counts)]
            total = [np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(v)])[ends]])) for v in per_link]
            kept = {f.name: b.column(i) for i, f in enumerate(b.schema) if f.name not in ("pairs", "times")}
            yield pa.RecordBatch.from_pydict(kept | {"n_best": pa.array(total[0], pa.int64()), "count_sum": pa.array(total[1], pa.int64())})

    return run


def specs(path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B) -> tuple[bytes, bytes]:
    """Both vocabulary files, read on the driver (a few MB) and sent to the tasks."""
    with open(path_a, "rb") as a, open(path_b, "rb") as b:
        return a.read(), b.read()


def align_documents(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B) -> DataFrame:
    """Per row: doc_id and its groups in order, each with the ids of A and of B."""
    shared = docs.sparkSession.sparkContext.broadcast(specs(path_a, path_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(shared.value)
        for chunk in text_chunks(batches, "text", CHUNK_BYTES):
            out: list[list | None] = [[] for _ in range(chunk.num_rows)]
            for owners, x in _aligned_parts(aligner, chunk.column("text").to_pylist()):
                owner = np.array(owners)
                for row in owner[~x["good"]].tolist():
                    out[row] = None
                of = np.repeat(owner[x["good"]], x["n_a"])[x["a0"]]
                for row, a0, a1, b0, b1 in zip(of.tolist(), *(x[k].tolist() for k in ("a0", "a1", "b0", "b1")), strict=True):
                    if out[row] is not None:
                        out[row].append({"a": x["ids_a"][a0:a1], "b": x["ids_b"][b0:b1]})
            ids = pa.list_(pa.int32())
            groups = pa.array([g or [] for g in out], pa.list_(pa.struct([("a", ids), ("b", ids)])))
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id"), "groups": groups})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, groups array<struct<a: array<int>, b: array<int>>>")


def link_report(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "align")
    files = specs(path_a, path_b)
    size_b = sentencepiece.SentencePieceProcessor(model_proto=files[1]).get_piece_size()
    shared = spark.sparkContext.broadcast(files)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digests(shared), DIGEST)
    rows = scratch.cut(rows.withColumn("row", F.monotonically_increasing_id()), "rows", compression="zstd")
    counted = scratch.cut(rows.select("pairs", "times").mapInArrow(_count_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "counted")
    of_b = (F.col("pair") % size_b).alias("b")
    most = counted.groupBy(of_b).agg(F.max("n").alias("most"))
    pairs = scratch.cut(counted.select("pair", "n", of_b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    blocks = -(-pairs.count() // block_pairs) or 1
    out = None
    for block in range(blocks):
        mine = pairs.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == block).toArrow().sort_by("pair")
        table = spark.sparkContext.broadcast(tuple(mine.column(c).to_numpy().astype(np.int64 if c != "best" else bool) for c in ("pair", "n", "best")))
        if not block:
            kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("pairs", "times")]
            out = rows.mapInArrow(_weigh(table), ", ".join([*kept, "n_best bigint, count_sum bigint"]))
        else:
            out = out.unionByName(rows.select("row", "pairs", "times").mapInArrow(_weigh(table), "row bigint, n_best bigint, count_sum bigint"), allowMissingColumns=True)
        if blocks > 1:  # each block's sums are written, so that its broadcast can go
            out = scratch.cut(out, "weighed")
            table.destroy()
    if blocks > 1:
        firsts = [F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
        out = out.groupBy("row").agg(*firsts, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
