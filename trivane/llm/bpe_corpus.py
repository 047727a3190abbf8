"""BPE encoding and decoding of document tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm import bpe
from trivane.llm.words import text_slices
from trivane.llm.workspace import ship


def _texts(encoder: bpe.Encoder, ids: np.ndarray, counts: np.ndarray) -> Iterator[str]:
    """The decoded texts of documents, one after the other."""
    ends = np.cumsum(counts)
    return (encoder.decode(ids[lo:hi].tolist()) for lo, hi in zip(ends - counts, ends))


def _encode(path: str, decoded: bool, verify: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = bpe.encoder(path)
    for batch in batches:
        for piece in text_slices(batch, "_text"):
            texts = piece.column("_text")
            ids, counts = encoder.encode(texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            kept = piece.drop_columns(["_text"])
            more = {}
            if decoded:
                more["decoded"] = pa.array(_texts(encoder, ids, counts), pa.string())
            if verify:
                same = [back == (text.as_py() or "") for text, back in zip(texts, _texts(encoder, ids, counts))]
                more["round_trip"] = pa.array(same, pa.bool_())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*kept.columns, lists, pa.array(counts, pa.int64()), *more.values()], [*kept.schema.names, "ids", "n_tokens", *more])


def encode(docs: DataFrame, path: str, keep: list[str], decoded: bool = False, verify: bool = False) -> DataFrame:
    """The columns ``keep`` of every row, and the token ids (array) and n_tokens of its whole text.

    With ``decoded`` the ids are decoded again in the same task, as a column of that name; with ``verify`` only
    round_trip is returned, whether they decode to the text (null: empty).
    Null and empty texts have no tokens. Repeated rows are all encoded. ``keep`` must not name the added columns.
    Nothing is shuffled; a task holds one slice of texts, and words it has met before up to a bound.
    """
    ship(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    added = ["ids array<int>", "n_tokens long", *["decoded string"] * decoded, *["round_trip boolean"] * verify]
    schema = ", ".join([f"`{n}` {t}" for n, t in rows.drop("_text").dtypes] + added)
    return rows.mapInArrow(partial(_encode, path, decoded, verify), schema)


def _decode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = bpe.encoder(path)
    for batch in batches:
        texts = [None if ids is None else encoder.decode(ids) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of ``encoded`` and the text of ``ids`` as ``decoded``; bytes that are no UTF-8 become U+FFFD, null stays null."""
    ship(encoded.sparkSession)
    schema = ", ".join([f"`{n}` {t}" for n, t in encoded.dtypes] + ["decoded string"])
    return encoded.mapInArrow(partial(_decode, path), schema)


def _digest(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = bpe.encoder(path)
    numbers = [str(i) for i in range(len(encoder.vocabulary.bytes))]
    for batch in batches:
        for piece in text_slices(batch):
            ids, counts = encoder.encode(piece.column("text"))
            whole, at, of_ids, of_text = ids.tolist(), 0, [], []
            for n in counts.tolist():
                own = whole[at : at + n]
                at += n
                of_ids.append(hashlib.sha256(",".join([numbers[i] for i in own]).encode()).hexdigest())
                of_text.append(hashlib.sha256(encoder.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded in one task."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_digest, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
