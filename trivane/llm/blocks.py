"""Documents in blocks, one row each, and rounds in which a block asks once for each distinct key.

A block holds some MB of whole texts. In a round every block sends its distinct keys to buckets of the key space, a
bucket gathers what all blocks have of a key, and each block gets an answer for every key it sent, in the order it
sent them. So a key that a third of all documents have is one entry for each block, not one for each document.
Blocks are written once; in later rounds they and the answers meet by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.llm.exchange import by_bucket
from trivane.llm.words import mix, text_buffer, text_slices
from trivane.llm.workspace import NO_ID, materialise

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 3 << 20

PACKED = "block long, ids binary, flags binary, sizes binary, texts binary"
_PACKED = pa.schema([("block", pa.int64())] + [(c, pa.binary()) for c in ("ids", "flags", "sizes", "texts")])
#: A question: the keys of a block in a bucket. An answer goes back as (block, bucket, level, answers).
ASKED = "bucket int, block long, keys binary, more binary"
ASKED_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])
ANSWER = "block long, bucket int, level int, answers binary"
ANSWERS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("level", pa.int32()), ("answers", pa.binary())])


def squeeze_planes(values: np.ndarray) -> bytes:
    """64-bit numbers in any order; bytes of one weight stand together, so small numbers take little."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze_planes(held: bytes, kind: type = np.uint64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row() -> pa.RecordBatch:
        ids, flags, sizes, texts = (np.concatenate(x) for x in zip(*held))
        values = [(part << 32) + number, ids.tobytes(), flags.tobytes(), sizes.tobytes(), zstandard.ZstdCompressor(level=1).compress(texts.tobytes())]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _PACKED)], schema=_PACKED)

    for batch in batches:
        for piece in text_slices(batch, most=BLOCK):
            data, offsets = text_buffer(piece.column("text"))
            if held and size + len(data) > BLOCK:
                yield row()
                number, held, size = number + 1, [], 0
            held.append((piece.column("id").to_numpy(), piece.column("flag").to_numpy(zero_copy_only=False), np.diff(offsets), data))
            size += len(data)
    if held:
        yield row()


def packed(docs: DataFrame, flag: Column | None = None) -> DataFrame:
    """The rows of ``docs`` in blocks, written to the shared folder; a null doc_id is NO_ID and a null text is empty."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text", (F.lit(False) if flag is None else flag).alias("flag"))
    return materialise(rows.mapInArrow(_pack, PACKED), "blocks")


class Texts:
    """The texts of a block: ids, flags and one column of texts."""

    def __init__(self, row: dict):
        self.ids, self.flags = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["flags"], bool)
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
        data = zstandard.ZstdDecompressor().decompress(row["texts"])
        self.column = pa.Array.from_buffers(pa.large_string(), len(self.ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


class Keys:
    """Distinct keys of two 64-bit numbers, in the order of their buckets, and the place of every given key among them."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        spread = mix(a ^ mix(b + np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(spread, kind="stable")
        for _ in range(2):
            s, x, y = spread[order], a[order], b[order]
            differ = np.ones(len(order), bool)
            differ[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            if not (differ[1:] & (s[1:] == s[:-1])).any():
                break
            order = np.lexsort((b, a, spread))  # two keys of one spread: equal ones must stand together
        self.first = order[differ]
        self.a, self.b, self.spread = a[self.first], b[self.first], spread[self.first]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(differ) - 1
        self.begin = np.flatnonzero(differ)
        self.order = order

    def reduced(self, how: np.ufunc, values: np.ndarray) -> np.ndarray:
        """``how`` over the values of each distinct key."""
        return how.reduceat(values[self.order], self.begin) if len(self.begin) else values[:0]

    def questions(self, block: int, buckets: int, pack, more) -> pa.Table:
        """Rows of ASKED: ``pack`` makes bytes of the keys of a bucket, ``more`` of a range of the distinct keys."""
        rows = [(b, block, pack(self.a[lo:hi], self.b[lo:hi]), more(lo, hi)) for b, lo, hi in by_bucket(self.spread, buckets)[1]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, ASKED_SCHEMA)], schema=ASKED_SCHEMA)


def pack_small(a: np.ndarray, b: np.ndarray) -> bytes:
    """Keys of small numbers."""
    return squeeze_planes(np.concatenate([a, b]))


def unpack_small(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.split(unsqueeze_planes(held), 2))


def pack_whole(a: np.ndarray, b: np.ndarray) -> bytes:
    """Keys that are names, which cannot be squeezed."""
    return np.concatenate([a, b]).tobytes()


def unpack_whole(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.split(np.frombuffer(held, np.uint64), 2))


def answers_of(rows: list[dict], level: int) -> list[bytes]:
    """A block's answers of a level in the order of its keys."""
    return [r["answers"] for r in sorted((r for r in rows if r["level"] == level), key=lambda r: r["bucket"])]


def with_answers(blocks: DataFrame, answers: DataFrame | None, run, schema: str) -> DataFrame:
    """``run(block's row, its answers) -> pa.Table`` for every block."""

    def each(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return run(next(r for r in rows if r["texts"] is not None), [r for r in rows if r["texts"] is None])

    if answers is None:
        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield from run(row, []).to_batches()

        return blocks.mapInArrow(narrow, schema)
    both = blocks.unionByName(answers, allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(each, schema)



def answered(asked: DataFrame, answer) -> DataFrame:
    """``answer(a bucket's questions) -> pa.Table`` of ANSWERS for every bucket."""

    def run(table: pa.Table) -> pa.Table:
        return answer(table)

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)
