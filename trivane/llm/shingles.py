"""Sets of word shingles, and the check that two of them are similar.

A text is the set of its distinct shingles, known by 64-bit names. Candidates are confirmed by the whole sets. Before
whole sets travel, candidates that differ in more parities than similar sets can are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.words import NOT_SPACE, find_words, mix, phrase_names, span_names, text_slices
from trivane.llm.workspace import materialise

SHINGLE = 5
#: The similarity from which texts are near copies, as numerator and denominator.
SIMILARITY = (4, 5)
#: Bits of a set's parities, which bound from below in how many shingles two sets differ.
PARITIES = 1024
#: The filter of candidates' sets has 2 ** SLOTS bits.
SLOTS = 25


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of all texts, ascending in each, and where each text's begin (one more entry at the end).

    Words are lower-case and end at white space. A text of fewer words is one shingle; one without words has none.
    """
    words = find_words(column, NOT_SPACE, lower=True)
    names = span_names(words.data, words.starts, words.ends)
    each = np.where(words.counts > 0, np.maximum(words.counts - shingle + 1, 1), 0)
    document = np.repeat(np.arange(len(each)), each)
    at = words.first[:-1][document] + np.arange(each.sum()) - (np.cumsum(each) - each)[document]
    found = phrase_names(names, at, np.minimum(at + shingle, words.first[1:][document]))
    order = np.lexsort((found, document))
    found, document = found[order], document[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (document[1:] != document[:-1])
    return found[new], np.searchsorted(document[new], np.arange(len(each) + 1))


def set_names(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, the same for equal sets in every task; the empty set is zero."""
    sums = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(mix(names ^ np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
    sizes = np.diff(first).astype(np.uint64)
    return np.where(sizes > 0, mix(sums[first[1:]] - sums[first[:-1]] + sizes), np.uint64(0))


def parities(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of bytes for each set: for each of PARITIES classes of shingles whether it has an odd number of them."""
    n = len(first) - 1
    at = np.repeat(np.arange(n), np.diff(first)) * PARITIES + (mix(names) % np.uint64(PARITIES)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=n * PARITIES) & 1).astype(bool).reshape(n, PARITIES), axis=1)


#: Bits of a sketch, and how many of them differ at most for a pair that is looked at: of a pair of similarity 0.8 on average 12.8
#: differ, with a deviation of 3.4, of one of 0.54 29.
SKETCH, SKETCH_BITS = 128, 25


def sketches(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of SKETCH / 64 numbers for each set: for each of SKETCH orders of all shingles a bit of the set's least one.

    Two sets have the same least shingle as often as is their similarity, and differ in half of the other bits.
    """
    out = np.zeros((len(first) - 1, SKETCH), np.uint8)
    full = np.flatnonzero(np.diff(first))
    turns = mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)
    for i, turn in enumerate(turns if len(full) else []):
        least = np.minimum.reduceat(names * turn, first[:-1][full])
        out[full, i] = (mix(least) >> np.uint64(17)) & np.uint64(1)
    return np.packbits(out, axis=1).view(np.uint64)


def required(sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many shingles sets of these sizes share at least, if they are similar."""
    p, q = SIMILARITY
    return -(-p * (sizes + others) // (p + q))


def _sets(shingle: int, wanted, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, names) of the texts whose node may be wanted, equal sets of a slice once."""
    slots = wanted.value
    for batch in batches:
        for piece in text_slices(batch):
            names, first = shingle_sets(piece.column("text"), shingle)
            nodes, once = np.unique(set_names(names, first), return_index=True)
            slot = (nodes >> np.uint64(64 - SLOTS)).astype(np.int64)
            may = (slots[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            held = [names[first[d] : first[d + 1]].tobytes() for d in once[may].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[may].view(np.int64)), pa.array(held, pa.binary())], ["node", "names"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (a, b) in enumerate(zip(batch.column("names").to_pylist(), batch.column("other").to_pylist())):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            keep[i] = len(np.intersect1d(a, b, assume_unique=True)) >= required(len(a), len(b))
        yield batch.select(["u", "v"]).filter(pa.array(keep))


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets may be similar by their sizes and parities."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, PARITIES // 64) for c in ("parities", "other"))
        sizes, others = (batch.column(c).to_numpy().astype(np.int64) for c in ("size", "other_size"))
        differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        yield batch.select(["u", "v"]).filter(pa.array(differ <= sizes + others - 2 * required(sizes, others)))


def similar(docs: DataFrame, heads: DataFrame, pairs: DataFrame, shingle: int, possible: bool = False) -> DataFrame:
    """The pairs (u, v) of nodes whose sets are similar. ``heads`` has node, size and parities of each set of ``docs``.

    Pairs that are ``possible`` by sizes and parities already are not held against these again.
    """
    spark = docs.sparkSession
    if not possible:
        first = heads.selectExpr("node as u", "size", "parities")
        second = heads.selectExpr("node as v", "size as other_size", "parities as other")
        pairs = pairs.join(first.hint("shuffle_hash"), "u").join(second.hint("shuffle_hash"), "v")
        pairs = pairs.select("u", "v", "size", "other_size", "parities", "other").mapInArrow(_possible, "u long, v long")
    pairs = materialise(pairs, "possible")
    slot = f"shiftrightunsigned(node, {64 - SLOTS})"
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).selectExpr(f"cast({slot} div 8 as int) as byte", f"shiftleft(1, cast({slot} % 8 as int)) as bit")
    filled = ends.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** (SLOTS - 3) rows at most
    slots = np.zeros(1 << (SLOTS - 3), np.uint8)
    slots[filled.column("byte").to_numpy()] = filled.column("bits").to_numpy().astype(np.uint8)
    sets = docs.select("text").mapInArrow(partial(_sets, shingle, spark.sparkContext.broadcast(slots)), "node long, names binary")
    sets = sets.groupBy("node").agg(F.first("names").alias("names"))  # one exchange for both joins
    first, second = sets.withColumnRenamed("node", "u"), sets.select(F.col("node").alias("v"), F.col("names").alias("other"))
    both = pairs.join(first.hint("shuffle_hash"), "u").join(second.hint("shuffle_hash"), "v")
    return materialise(both.select("u", "v", "names", "other").mapInArrow(_similar, "u long, v long"), "similar")
