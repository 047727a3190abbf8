"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive words of benchmark items. Words are the symbols: a block is the last two
words (one for patterns of one word), the shift table tells for the hash of a block how far a scan may move
on without missing a pattern, and where the shift is zero the hash of the whole suffix selects the patterns
to compare. What the hashes select is confirmed by comparing bytes.

The scan moves many positions at once: documents are cut into lanes that overlap by a window, and one numpy
step advances all lanes. Patterns of each length have tables of their own, so that short items do not
shorten the shifts of the others.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.words import ALNUM, Words, find_words, mix, phrase_names, span_names, text_slices
from trivane.llm.workspace import NO_ID, keyed, materialise, ship

WINDOW = 10
#: Patterns that are searched and broadcast at a time; a larger benchmark is searched in several passes.
PATTERNS = 200_000
LANE = 128


@dataclass
class Tables:
    """Search tables for the patterns of ``length`` words."""

    length: int
    block: int
    shifts: np.ndarray
    suffixes: np.ndarray  # names of whole patterns, ascending
    texts: list[bytes]  # their words joined by spaces, in that order
    items: list[list[int]]  # places of the items that hold each


def _block_names(names: np.ndarray, block: int) -> np.ndarray:
    """A name for each block, standing at its last word."""
    if block == 1:
        return mix(names)
    before = np.concatenate([np.zeros(1, np.uint64), names[:-1]]) if len(names) else names
    return mix(mix(before) * np.uint64(3) + names)


def build_tables(windows: dict[bytes, set[int]]) -> list[Tables]:
    """Tables for each length of the windows, which are words joined by spaces, with the items they come from."""
    by_length = defaultdict(list)
    for text in windows:
        by_length[text.count(b" ") + 1].append(text)
    out = []
    for length, texts in sorted(by_length.items()):
        words = find_words(pa.array([t.decode("utf-8") for t in texts], pa.large_string()), ALNUM, lower=False)
        names = span_names(words.data, words.starts, words.ends)
        whole = phrase_names(names, words.first[:-1], words.first[1:])
        block = min(2, length)
        size = 1 << max(10, int(np.ceil(np.log2(8 * max(1, len(texts)) * length))))
        shifts = np.full(size, length - block + 1, np.int64)
        blocks = _block_names(names, block) & np.uint64(size - 1)
        for end in range(block - 1, length):  # a block that ends at this word lets the scan move to the last word
            np.minimum.at(shifts, blocks[words.first[:-1] + end], length - 1 - end)
        order = np.argsort(whole, kind="stable")
        out.append(Tables(length, block, shifts, whole[order], [texts[i] for i in order], [sorted(windows[texts[i]]) for i in order]))
    return out


def find(words: Words, names: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(first word of an occurrence, place of its pattern) for every occurrence in the documents of ``words``."""
    length = tables.length
    mask = np.uint64(len(tables.shifts) - 1)
    shift_at = tables.shifts[_block_names(names, tables.block) & mask]
    lo, hi = words.first[:-1], words.first[1:]
    lanes = np.maximum(0, -(-(hi - lo - length + 1) // LANE))  # each owns LANE starts of windows
    document = np.repeat(np.arange(len(lo)), lanes)
    number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = lo[document] + number * LANE + length - 1  # the last word of the first window
    stop = np.minimum(lo[document] + (number + 1) * LANE + length - 1, hi[document])
    stops = []
    while len(at):
        shift = shift_at[at]
        stops.append(at[shift == 0])
        at = at + np.maximum(shift, 1)
        inside = at < stop
        at, stop = at[inside], stop[inside]
    last = np.sort(np.concatenate(stops)) if stops else np.zeros(0, np.int64)
    first = last - (length - 1)
    whole = phrase_names(names, first, last + 1)
    place = np.minimum(np.searchsorted(tables.suffixes, whole), len(tables.suffixes) - 1)
    hit = np.flatnonzero(tables.suffixes[place] == whole)
    found = []
    for i in hit.tolist():
        text = b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[first[i] : last[i] + 1], words.ends[first[i] : last[i] + 1]))
        p = int(place[i])
        while p < len(tables.suffixes) and tables.suffixes[p] == whole[i]:
            if tables.texts[p] == text:
                found.append((int(first[i]), p))
            p += 1
    starts, places = zip(*found) if found else ((), ())
    return np.array(starts, np.int64), np.array(places, np.int64)


def _windows(length: int):
    """(item) rows to (words joined by spaces, item) rows, one for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                words = find_words(piece.column("text"), ALNUM, lower=True)
                texts, items = [], []
                for d, item in enumerate(piece.column("item").to_pylist()):
                    own = [words.data[s:e].tobytes() for s, e in zip(words.starts[words.first[d] : words.first[d + 1]], words.ends[words.first[d] : words.first[d + 1]])]
                    each = {b" ".join(own[i : i + length]) for i in range(max(1, len(own) - length + 1))} if own else set()
                    texts += sorted(each)
                    items += [item] * len(each)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(items, pa.string())], ["window", "item"])

    return run


def _scan(tables, names_of_items):
    """Texts to (id, tag, n_words, hit bits, items) with the tables of one block of patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tables.value
        for batch in batches:
            for piece in text_slices(batch):
                words = find_words(piece.column("text"), ALNUM, lower=True)
                names = span_names(words.data, words.starts, words.ends)
                cover = np.zeros(len(names) + 1, np.int64)
                items: dict[int, set[int]] = defaultdict(set)
                for t in held:
                    starts, places = find(words, names, t)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + t.length, -1)
                    document = np.searchsorted(words.first, starts, side="right") - 1
                    for d, p in zip(document.tolist(), places.tolist()):
                        items[d].update(t.items[p])
                hit = np.cumsum(cover[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                bits, found = [], []
                for d in range(len(words.first) - 1):
                    lo, hi = words.first[d], words.first[d + 1]
                    bits.append(np.packbits(hit[lo:hi]).tobytes() if total[hi] > total[lo] else b"")
                    found.append([names_of_items.value[i] for i in sorted(items[d])] if d in items else [])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("tag"), pa.array(words.counts, pa.int64()), pa.array(bits, pa.binary()), pa.array(found, pa.list_(pa.string()))],
                    ["id", "tag", "n_words", "hits", "items"],
                )

    return run


def _merged(table: pa.Table) -> pa.Table:
    """The passes of one document as one row for each copy of it."""
    bits = [x for x in table.column("hits").to_pylist() if x]
    n = table.column("n_words")[0].as_py()
    either = np.zeros((n + 7) // 8, np.uint8)
    for x in bits:
        either |= np.frombuffer(x, np.uint8)
    items = sorted({x for held in table.column("items").to_pylist() for x in held})
    first = table.slice(0, 1)
    return first.set_column(3, "hits", pa.array([either.tobytes() if bits else b""], pa.binary())).set_column(4, "items", pa.array([items], pa.list_(pa.string())))


_FOUND = "id long, tag long, n_words long, hits binary, items array<string>"


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, patterns: int = PATTERNS) -> DataFrame:
    """Occurrences of windows of benchmark items in every whole text.

    Returns doc_id, n_words, hits (a bit for each word, first word first; empty without a hit) and items (sorted
    ids, as strings, of items of which a window occurs): one row for each row of ``docs``. Words are runs of
    0-9, a-z and characters beyond ASCII after lower-casing A-Z. An item of fewer words than ``window`` is one
    window of its own length; one without words is none. Null and empty texts have no words; a null item_id
    is left out. Repeated documents are returned as often as they stand there, repeated items count as one.
    Only doc_id, item_id and text are read. An empty benchmark hits nothing.

    The distinct windows are counted first. Up to ``patterns`` of them are broadcast at once; more are split by
    hash into blocks of about that many, each a pass over the documents that is written before the next block is
    broadcast, and the passes are merged by document.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null")
    windows = items.mapInArrow(_windows(window), "window binary, item string").distinct().cache()
    total = windows.count()
    blocks = max(1, -(-total // patterns))
    rows = keyed(docs) if blocks > 1 else docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.lit(0).cast("long").alias("tag"), "text")
    passes = None
    for b in range(blocks):
        held: dict[bytes, set[int]] = defaultdict(set)
        places: dict[str, int] = {}
        for r in windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).collect():
            held[bytes(r["window"])].add(places.setdefault(r["item"], len(places)))
        sc = spark.sparkContext
        tables = sc.broadcast(build_tables(held))
        one = rows.mapInArrow(_scan(tables, sc.broadcast(list(places))), _FOUND)
        if blocks > 1:  # one block of patterns on the driver at a time
            one = materialise(one, "hits")
            tables.destroy()
        passes = one if passes is None else passes.unionByName(one)
    windows.unpersist()
    if blocks > 1:
        copies = rows.groupBy("id", "tag").count().filter("count > 1")
        merged = passes.groupBy("id", "tag").applyInArrow(_merged, _FOUND)
        passes = merged.join(copies, ["id", "tag"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("count"), F.lit(1)).cast("int"))))
    return passes.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "hits", F.array_sort("items").alias("items"))


def count_bits(hits: bytes) -> int:
    return int(np.unpackbits(np.frombuffer(hits, np.uint8)).sum())


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [count_bits(x) for x in batch.column("hits").to_pylist()]
            items = batch.column("items").to_pylist()
            shas = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(shas), pa.array([x > 0 for x in hit])],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
