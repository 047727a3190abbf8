"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists.

Vectors stay where they are: each task makes blocks of its rows and sorts every dimension of a block. For a
query, all lists of its non-zero components are read downwards (upwards where the component is negative), new
vectors are scored in full, and a block is left as soon as the bound, the score of a vector as good as the
last read place of every list, cannot beat the kth score so far, which is carried from block to block. Nothing
else ends a search. The tasks' best meet by query, and there a query's own row is taken out once: so a task
keeps one more than k.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trivane.llm.workspace import materialise, ship

SCALE = 1024
#: Queries that are broadcast at a time, and vectors whose lists are sorted together.
QUERIES, BLOCK = 2048, 8192
FIRST_DEPTH = 16
#: Stands for a null vec_id, so that it comes last.
NO_ID = (1 << 63) - 1

_VECTOR = "vec_id long, v array<long>"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component x as double.

    Without rows whose vector is null or empty, or holds a null or non-finite component.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: F.coalesce((e > float("-inf")) & (e < float("inf")) & ~F.isnan(e), F.lit(False)))
    rows = vectors.filter("embedding is not null and size(embedding) > 0").filter(fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(scale * e).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows; missing components are 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), max(width, int(lengths.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Best:
    """The k best (score, vec_id) of a query: higher scores first, then smaller ids. ``own`` marks the query's own vector."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores, self.own = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, ids: np.ndarray, scores: np.ndarray, own: np.ndarray) -> None:
        if len(self.ids) == self.k:
            good = scores >= self.scores[-1]
            ids, scores, own = ids[good], scores[good], own[good]
        if len(ids):
            ids, scores, own = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores]), np.concatenate([self.own, own])
            top = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores, self.own = ids[top], scores[top], own[top]


class Lists:
    """A block of vectors with its sorted lists. ``scored`` counts the vectors that searches have scored."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.scored = ids, vectors, 0
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()  # ascending, a list for each dimension
        self.sorted = np.take_along_axis(vectors, self.order.T, axis=0).T.copy()

    def search(self, query_id: int, query: np.ndarray, best: Best) -> None:
        n = len(self.ids)
        up, down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        seen = np.zeros(n, bool)
        done, depth = 0, FIRST_DEPTH if len(up) + len(down) else n
        while True:
            depth = min(depth, n)
            fresh = np.zeros(n, bool)
            if len(up) + len(down):
                fresh[self.order[up, done:depth].ravel()] = True
                fresh[self.order[down, n - depth : n - done].ravel()] = True
            else:  # no list to read: all scores are 0
                fresh[:] = True
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            self.scored += len(new)
            own = self.ids[new] == query_id
            own[own] = (self.vectors[new[own]] == query).all(axis=1)
            best.add(self.ids[new], self.vectors[new] @ query, own)
            if depth == n:
                return
            bound = (query[up] * self.sorted[up, depth - 1]).sum() + (query[down] * self.sorted[down, n - depth]).sum()
            if len(best.ids) == best.k and best.scores[-1] > bound:
                return
            done, depth = depth, 2 * depth


def _exact(values: np.ndarray) -> np.ndarray:
    """As doubles where no sum of products can pass 2**53, for the faster product; else as they are."""
    most = float(np.abs(values).max(initial=0))
    return values.astype(np.float64) if most * most * max(1, values.shape[1]) < 2**52 else values


_FOUND = "query long, vec_id long, score long, own boolean"


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of BLOCK rows at a time, whatever the batches."""
    ids, parts, n = [], [], 0

    def whole():
        wide = max(x.shape[1] for x in parts)
        return np.concatenate(ids), np.concatenate([np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in parts])

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(at, BLOCK)
            ids.append(piece.column("vec_id").to_numpy())
            parts.append(_matrix(piece.column("v"), width))
            n += piece.num_rows
            if n >= BLOCK:
                yield whole()
                ids, parts, n = [], [], 0
    if n:
        yield whole()


def _search(queries, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers, query_ids, query_vectors = queries.value
    best = [Best(k + 1) for _ in query_ids]
    for ids, vectors in _blocks(batches, query_vectors.shape[1]):
        wide = np.zeros((len(query_vectors), vectors.shape[1]), np.int64)
        wide[:, : query_vectors.shape[1]] = query_vectors
        both = _exact(np.concatenate([wide, vectors]))
        lists = Lists(ids, both[len(wide) :])
        for q, query_id in enumerate(query_ids.tolist()):
            lists.search(query_id, both[q], best[q])
    for number, b in zip(numbers.tolist(), best):
        if len(b.ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), number)), pa.array(b.ids), pa.array(b.scores.astype(np.int64)), pa.array(b.own)], ["query", "vec_id", "score", "own"])


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` of the highest inner product with each query.

    Both tables are (vec_id, embedding). Ties go to the smaller vec_id. Of the rows with a query's vec_id and vector
    one is its own and no candidate; others are, as are rows of its vec_id with another vector. Every row of
    ``queries`` has its own ranks, so rows that repeat are answered as often as they stand there. A query without
    candidates has no rows. Shorter vectors are taken as ending in zeros. A null vec_id is no query, but its
    vector is a candidate, after all others of its score. Scores are 64-bit integers.

    Queries go out in blocks of about QUERIES, each a pass over all vectors. With several blocks each pass is written
    before the next block is broadcast, so that the driver holds one block only.
    """
    spark = vectors.sparkSession
    ship(spark)
    asked = scaled(queries).filter("vec_id is not null").groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    blocks = max(1, -(-asked.count() // QUERIES))
    number = F.xxhash64("vec_id", "v")
    rows = scaled(vectors).withColumn("vec_id", F.coalesce("vec_id", F.lit(NO_ID)))
    answers = None
    for b in range(blocks):
        held = asked.filter(F.pmod(number, F.lit(blocks)) == b).collect()
        width = max([len(r["v"]) for r in held], default=0)
        matrix = np.array([r["v"] + [0] * (width - len(r["v"])) for r in held], np.int64).reshape(len(held), width)
        sent = spark.sparkContext.broadcast((np.arange(len(held)), np.array([r["vec_id"] for r in held], np.int64), matrix))
        found = rows.mapInArrow(partial(_search, sent, k), _FOUND)
        names = spark.createDataFrame([(i, r["vec_id"], r["copies"]) for i, r in enumerate(held)], "query long, query_id long, copies long")
        ordered = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("_at", F.row_number().over(ordered)).filter(F.col("_at") <= k + 1)
        gone = F.min(F.when(F.col("own"), F.col("_at"))).over(Window.partitionBy("query"))
        best = best.withColumn("_gone", gone).filter(F.col("_gone").isNull() | (F.col("_at") != F.col("_gone")))
        rank = (F.col("_at") - (F.col("_at") > F.coalesce("_gone", F.lit(k + 1))).cast("int")).alias("rank")
        one = best.join(names, "query").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        one = one.select("query_id", rank, F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score").filter(F.col("rank") <= k)
        if blocks > 1:
            one = materialise(one, "answers")
            sent.destroy()
        answers = one if answers is None else answers.unionByName(one)
    return answers
