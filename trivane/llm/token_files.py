"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are sorted by doc_id over all files, so that stripe statistics and Bloom filters let a reader of some
documents skip all other stripes, and stripes are read in parallel.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.llm import bpe
from trivane.llm.words import text_slices
from trivane.llm.workspace import ship

END_ID = 0
#: Bytes of text for each file, of ids for each stripe, and documents for each entry of the row index.
FILE_TEXT, STRIPE, INDEX_ROWS = 64 << 20, 16 << 20, 1000


class LibraryWords:
    """The vocabulary of ``bpe.Encoder`` with words encoded by the tokenizers library itself, each distinct word once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]


_library: dict[str, bpe.Encoder] = {}


def library_encoder(path: str) -> bpe.Encoder:
    """This process's encoder by the library for a vocabulary file."""
    if path not in _library:
        _library[path] = bpe.Encoder(path, vocabulary=LibraryWords(path))
    return _library[path]


_ROWS = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def _encode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, part, before = library_encoder(path), TaskContext.get().partitionId(), 0
    for batch in batches:
        for piece in text_slices(batch):
            ids, counts = encoder.encode(piece.column("text"))
            ids = np.insert(ids, np.cumsum(counts), END_ID)
            counts = counts + 1
            ends = np.cumsum(counts)
            offsets = np.concatenate([[0], ends])
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(before + offsets[:-1]), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))],
                ["doc_id", "part", "before", "n_tokens", "ids"],
            )
            before += int(ends[-1])


def write_tokens(docs: DataFrame, path: str, folder: str) -> None:
    """Encode every whole text, end it with END_ID, and write all in ascending doc_id order as ORC to ``folder``.

    Null and empty texts have the end id only. Documents of equal doc_id follow one another by text; a null
    doc_id comes first. Only doc_id and text are read. An empty table gives a readable folder without rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // FILE_TEXT + 1)
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(partial(_encode, path), _ROWS)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.row.index.stride": INDEX_ROWS, "orc.stripe.size": STRIPE, "orc.compress": "ZSTD"}
    encoded.write.options(**options).orc(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; filters on doc_id reach the stripes.

    What is gathered for the starts is one number for each written file, by a job that runs at once.
    """
    held = spark.read.schema(_ROWS).orc(folder)
    parts = sorted(held.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    ends = np.cumsum([r["n"] for r in parts]).tolist()
    starts = spark.createDataFrame([(r["part"], e - r["n"]) for r, e in zip(parts, ends)], "part int, base long")
    placed = held.join(F.broadcast(starts), "part")
    return placed.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8)
        ends = 4 * np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        sums = [zlib.crc32(values[lo:hi]) for lo, hi in zip(np.concatenate([[0], ends[:-1]]) if len(ends) else [], ends)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    ship(tokens.sparkSession)
    return tokens.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
