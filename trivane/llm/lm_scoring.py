"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Training counts words and word pairs of whole texts, ends included. A count c becomes the level
1 + floor(log2 c), and the filter holds (n-gram, j) for each j up to the level; a count is read back by
asking for j = 1, 2, ... until the answer is no. The filter is made of shards by n-gram hash, each sized for
its own entries and built in its own task.

P(w | h) = weight * c(hw) / c(h) + (1 - weight) * (c(w) + 1) / (N + V + 1), counts read from the filter;
without c(h) only the second part. The score of a text is the sum of log10 P over its words and its end.

Blocks of documents (``blocks``) send each n-gram once with its count in training. The buckets build the shards
and answer with the exact counts of words, of which the add-one unigram score (``base_score``) is made. Once its
size is known, a filter up to a bound is broadcast. A larger one is not: then the buckets answer the same
questions by the same probes where the shards are, so that nothing of it passes through the driver or meets in
one task, and the scores are the same.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.llm import blocks as B
from trivane.llm.exchange import bucket_of, by_bucket
from trivane.llm.words import NOT_SPACE, find_words, mix, span_names
from trivane.llm.workspace import NO_ID, bucket_count, materialise, ship

END = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: A filter of this size at most is broadcast.
MAX_FILTER_BYTES = 192 << 20
#: Bits and hash functions for each entry of the filter: about 1.2 % false answers for one question.
BITS, HASHES = 10, 4
PAIR_WEIGHT = 0.4
#: Answers of words' exact counts, and of all levels.
COUNTS, LEVELS = 1, 2


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words with an END after each document, and where each document begins (one more entry)."""
    words = find_words(column, NOT_SPACE, lower=True)
    names = span_names(words.data, words.starts, words.ends)
    first = words.first + np.arange(len(words.first))
    return np.insert(names, words.first[1:], END), first


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    """The name of each token with the one before; before a document's first word stands END."""
    before = np.concatenate([np.array([END]), tokens[:-1]]) if len(tokens) else tokens
    return mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + mix(tokens))


def levels_of(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log2(counts))).astype(np.int64)


#: The count that a level stands for: 0, 1, then about the middle of its range.
LEVEL_COUNT = np.array([0.0, 1.0] + [1.4 * 2.0 ** (j - 1) for j in range(2, 64)])


def _bit_places(names: np.ndarray, level: int, sizes: np.ndarray, i: int) -> np.ndarray:
    key = mix(names + np.uint64(level) * _STEP)
    return ((key >> np.uint64(32)) + np.uint64(i) * ((key & np.uint64(0xFFFFFFFF)) | np.uint64(1))) % sizes


def build_shard(names: np.ndarray, counts: np.ndarray, bits: int = BITS) -> bytes:
    """The bits of a shard that holds every name at all levels up to that of its count."""
    levels = levels_of(counts) if len(counts) else np.zeros(0, np.int64)
    size = np.uint64(max(64, (int(levels.sum()) * bits + 63) // 64 * 64))
    flags = np.zeros(int(size), bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        held = names[levels >= level]
        for i in range(HASHES):
            flags[_bit_places(held, level, size, i)] = True
    return np.packbits(flags).tobytes()


class LogBloom:
    """A filter of shards, of which those of buckets ``lo`` and on are held."""

    def __init__(self, buckets: int, sizes: np.ndarray, lo: int = 0):
        """``sizes`` are the bytes of the shards, which are filled in one by one."""
        self.buckets, self.lo = buckets, lo
        self.bits = np.zeros(int(sizes.sum()), np.uint8)
        self.sizes = sizes.astype(np.uint64) * np.uint64(8)
        self.first = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.sizes)])

    def fill(self, bucket: int, bits: bytes) -> None:
        at = int(self.first[bucket - self.lo]) // 8
        self.bits[at : at + len(bits)] = np.frombuffer(bits, np.uint8)

    def levels(self, names: np.ndarray) -> np.ndarray:
        """The level of each name by repeated membership probes."""
        shard = bucket_of(names, self.buckets) - self.lo
        found, active, level = np.zeros(len(names), np.uint8), np.arange(len(names)), 0
        while len(active):
            level += 1
            for i in range(HASHES):
                own = shard[active]
                at = self.first[own] + _bit_places(names[active], level, self.sizes[own], i)
                there = (self.bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1
                active = active[there.astype(bool)]
            found[active] = level
        return found


def pair_log_probability(tokens: np.ndarray, words: np.ndarray, pairs: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 P of each token from the levels of words and pairs; END's level stands before the first token."""
    count, pair = LEVEL_COUNT[words], LEVEL_COUNT[pairs]
    alone = (count + 1) / (total + distinct + 1)
    end = count[np.argmax(tokens == END)] if len(tokens) else 0.0
    before = np.concatenate([[end], count[:-1]]) if len(count) else count
    share = np.minimum(pair, before) / np.maximum(before, 1)
    return np.log10(np.where(before > 0, PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * alone, alone))


class Block:
    """The n-grams of a block: distinct words and pairs in the order of their names, and where each stands."""

    def __init__(self, row: dict):
        texts = B.Texts(row)
        self.ids, self.held_out = texts.ids, texts.flags
        self.tokens, self.first = tokens_of(texts.column)
        self.orders = [np.unique(names, return_inverse=True) for names in (self.tokens, pairs_of(self.tokens))]

    def questions(self, block: int, buckets: int) -> pa.Table:
        """In each bucket the names of words and then of pairs, and how often each stands in training texts."""
        training = np.repeat(~self.held_out, np.diff(self.first))
        keys: dict[int, list] = {}
        for order, (names, place) in enumerate(self.orders):
            counts = np.bincount(place[training], minlength=len(names)).astype(np.int64)
            for b, lo, hi in by_bucket(names, buckets)[1]:  # sorted names are in the order of their buckets
                keys.setdefault(b, [(names[:0], counts[:0])] * 2)[order] = (names[lo:hi], counts[lo:hi])
        rows = [(b, block, (w[0].tobytes() + p[0].tobytes()), len(w[0]).to_bytes(4, "little") + B.squeeze_planes(np.concatenate([w[1], p[1]]))) for b, (w, p) in keys.items()]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, B.ASKED_SCHEMA)], schema=B.ASKED_SCHEMA)


class Asked:
    """The questions of a bucket: for each its block, its names, how many of them are words, and counts of all."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.names = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        self.words = [int.from_bytes(r["more"][:4], "little") for r in rows]
        self.counts = [B.unsqueeze_planes(r["more"][4:], np.int64) for r in rows]

    def summed(self, which) -> tuple[np.ndarray, np.ndarray]:
        """Distinct names in ascending order with the sums of their counts; ``which`` cuts words or pairs."""
        names = np.concatenate([which(x, n) for x, n in zip(self.names, self.words)])
        counts = np.concatenate([which(x, n) for x, n in zip(self.counts, self.words)])
        names, place = np.unique(names, return_inverse=True)
        return names, np.bincount(place, counts, len(names)).astype(np.int64)


_BUILT = "bucket int, bits binary, total long, distinct long, block long, level int, answers binary"
_BUILT_SCHEMA = pa.schema([("bucket", pa.int32()), ("bits", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64()), ("block", pa.int64()), ("level", pa.int32()), ("answers", pa.binary())])


def _build(bits: int, table: pa.Table) -> pa.Table:
    """A bucket's questions to its shard, the totals of its words, and exact word counts for each block."""
    asked = Asked(table.to_pylist())
    words, counts = asked.summed(lambda x, n: x[:n])
    pairs, pair_counts = asked.summed(lambda x, n: x[n:])
    names, held = np.concatenate([words, pairs]), np.concatenate([counts, pair_counts])
    bucket = asked.rows[0]["bucket"]
    out = [(bucket, build_shard(names[held > 0], held[held > 0], bits), int(counts.sum()), int((counts > 0).sum()), None, None, None)]
    for row, own, n in zip(asked.rows, asked.names, asked.words):
        out.append((bucket, None, None, None, row["block"], COUNTS, B.squeeze_planes(counts[np.searchsorted(words, own[:n])])))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _BUILT_SCHEMA)], schema=_BUILT_SCHEMA)


def _probe(buckets: int, table: pa.Table) -> pa.Table:
    """A bucket's shard and questions to the levels of all names."""
    rows = table.to_pylist()
    bucket = rows[0]["bucket"]
    bits = next(r["bits"] for r in rows if r["bits"] is not None)
    shard = LogBloom(buckets, np.array([len(bits)]), bucket)
    shard.fill(bucket, bits)
    asked = Asked([r for r in rows if r["bits"] is None])
    out = [(r["block"], bucket, LEVELS, n.to_bytes(4, "little") + shard.levels(names).tobytes()) for r, names, n in zip(asked.rows, asked.names, asked.words)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), B.ANSWERS)], schema=B.ANSWERS)


_SCORED = "id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double"
_SCORED_SCHEMA = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_sum", pa.float64()), ("score", pa.float64())])


def _score(bloom, total: int, distinct: int, row: dict, answers: list[dict]) -> pa.Table:
    block = Block(row)
    (words, place), (pairs, pair_place) = block.orders
    counts = np.concatenate([B.unsqueeze_planes(x, np.int64) for x in B.answers_of(answers, COUNTS)])[place]
    if bloom is not None:
        levels = [bloom.value.levels(words), bloom.value.levels(pairs)]
    else:
        held = [(int.from_bytes(x[:4], "little"), np.frombuffer(x, np.uint8, offset=4)) for x in B.answers_of(answers, LEVELS)]
        levels = [np.concatenate([x[:n] for n, x in held]), np.concatenate([x[n:] for n, x in held])]
    logs = pair_log_probability(block.tokens, levels[0][place], levels[1][pair_place], total, distinct)
    add = lambda values: np.add.reduceat(values, block.first[:-1])
    columns = [block.ids, block.held_out, np.diff(block.first), add((counts > 0).astype(np.int64)), add(np.log10(counts + 1.0)), add(logs)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORED_SCHEMA)], schema=_SCORED_SCHEMA)


def score(docs: DataFrame, held_out: Column, max_filter_bytes: int = MAX_FILTER_BYTES, bits: int = BITS) -> DataFrame:
    """Score every whole text, learning from the rows for which ``held_out`` (of doc_id) is not true.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``.
    A null or empty text has one token, its end. Repeated rows are counted and returned as often as they stand
    there. A null doc_id is a document like any other. Only doc_id and text are read, so further columns do not matter.
    With no training text every count is 0, and both scores are those of a uniform guess. The blocks and the
    buckets' answers are written to the shared folder by jobs of their own, and are left there.
    """
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    buckets = bucket_count(docs)
    blocks = B.packed(docs, F.coalesce(held_out, F.lit(False)))

    asked = B.with_answers(blocks, None, lambda row, _: Block(row).questions(row["block"], buckets), B.ASKED)

    def build(table: pa.Table) -> pa.Table:
        return _build(bits, table)

    built = materialise(asked.groupBy("bucket").applyInArrow(build, _BUILT), "lm")
    shards, answers = built.filter("block is null"), built.filter("block is not null").select("block", "bucket", "level", "answers")
    size, total, distinct = shards.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    bloom = None
    if size <= max_filter_bytes:
        sizes = np.full(buckets, 8, np.int64)
        for r in shards.select("bucket", F.octet_length("bits").alias("size")).collect():
            sizes[r["bucket"]] = r["size"]
        whole = LogBloom(buckets, sizes)
        for r in shards.select("bucket", "bits").toLocalIterator():  # a file's shards at a time
            whole.fill(r["bucket"], r["bits"])
        bloom = sc.broadcast(whole)
    else:
        both = asked.unionByName(shards.select("bucket", "bits"), allowMissingColumns=True)
        answers = answers.unionByName(materialise(B.answered(both, partial(_probe, buckets)), "levels"))
    scored = B.with_answers(blocks, answers, partial(_score, bloom, total, distinct), _SCORED)
    base = F.col("log_sum") - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    return scored.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
