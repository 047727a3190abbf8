"""Exact k-means over integer vectors by balls.

A cluster is a ball: its centroid and, as radius, the distance of its farthest member. Another centroid is a neighbour of
the ball if it is nearer than twice the radius; no member can be nearer to any other. Members nearer to
their own centroid than half the way to the nearest neighbour are the stable core and stay. The rest lies in annuli
between halves of the ways to the neighbours in order: a member is compared with a neighbour only from its annulus on. Two
centroids that did not move need no comparison at all. Tests are on squared integers, so nothing is rounded: a
member stays without comparison where 4 d(own)^2 < d(own centroid, other centroid)^2.

Vectors with their cluster are a written table, read and written anew in each round. The balls are those of a task's
batch: they lie inside the clusters' balls, so they prune at least as much, and need no pass of their own. Only sums
of k clusters for each task are grouped, and k centroids come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.topk import scaled
from trivane.llm.workspace import discard, materialise, ship

#: Below this size of components four squared distances of 64 of them fit in a long; beyond, Python's integers are used.
FITS, WIDTH = 1 << 26, 64
LONGEST = (1 << 63) - 1

ROWS = "vec_id long, v array<long>, cluster int, distance long, n long, inertia decimal(38,0), sums array<decimal(38,0)>"
_DECIMAL = pa.decimal128(38, 0)
_ARROW = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("cluster", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("inertia", _DECIMAL), ("sums", pa.list_(_DECIMAL))])


def _squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = x - centre
    return (apart * apart).sum(axis=1)


@dataclass
class Balls:
    """Centroids, what they were when the vectors got their clusters, and how many distances were computed."""

    centres: list[tuple[int, ...]]
    before: list[tuple[int, ...]] | None = None
    compared: int = 0

    def assigned(self, x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(clusters, squared distances) of the vectors ``x``, whose clusters were ``held``. Ties go to the smaller number."""
        small = max(map(abs, (c for centre in self.centres for c in centre)), default=0) < FITS and np.abs(x).max(initial=0) < FITS
        # the end of a long has no positive counterpart in it, so its absolute value stays negative
        small = small and x.min(initial=0) > -FITS
        x = x if small else x.astype(object)
        centres = np.array(self.centres, dtype=np.int64 if small else object).reshape(len(self.centres), -1)
        moved = [self.before is None or a != b for a, b in zip(self.centres, self.before or self.centres)]
        cluster, distance = held.copy(), np.zeros(len(x), x.dtype)
        for i in np.unique(held):
            rows = np.flatnonzero(held == i)
            own = _squares(x[rows], centres[i])
            self.compared += len(rows)
            apart = _squares(centres, centres[i])
            near = [int(j) for j in np.argsort(apart, kind="stable") if j != i and 4 * own.max() >= apart[j] and (moved[i] or moved[j])]
            best, label = own.copy(), np.full(len(rows), i, held.dtype)
            for j in near:
                ring = np.flatnonzero((4 * own >= apart[j]).astype(bool))  # empty for those in the stable core of all
                other = _squares(x[rows[ring]], centres[j])
                self.compared += len(ring)
                better = ((other < best[ring]) | ((other == best[ring]) & (j < label[ring]))).astype(bool)
                best[ring[better]], label[ring[better]] = other[better], j
            cluster[rows], distance[rows] = label, best
        return cluster, distance


def _summary(n: np.ndarray, inertia: list[int], sums: list[list[int]]) -> pa.RecordBatch:
    """A row for each cluster with members, without a vector."""
    full = [i for i in range(len(n)) if n[i]]
    held = {
        "cluster": pa.array(full, pa.int32()),
        "n": pa.array([int(n[i]) for i in full], pa.int64()),
        "inertia": pa.array([Decimal(inertia[i]) for i in full], _DECIMAL),
        "sums": pa.array([[Decimal(s) for s in sums[i]] for i in full], pa.list_(_DECIMAL)),
    }
    return pa.RecordBatch.from_arrays([held.get(f.name, pa.nulls(len(full), f.type)) for f in _ARROW], schema=_ARROW)


def _round(batches: Iterator[pa.RecordBatch], balls: Balls, last: bool) -> Iterator[pa.RecordBatch]:
    """Vectors with their new clusters, in the last round with distances and without components, and the task's sums."""
    k = len(balls.centres)
    n, inertia, sums = np.zeros(k, np.int64), [0] * k, [[0] * WIDTH for _ in range(k)]
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
        cluster, distance = balls.assigned(x, batch["cluster"].to_numpy(zero_copy_only=False))
        exact = distance.dtype == object
        distance = np.array([min(d, LONGEST) for d in distance], np.int64) if exact else distance
        for i in np.unique(cluster):
            rows = cluster == i
            members = x[rows].astype(object) if exact else x[rows]
            n[i] += len(members)
            sums[i] = [a + int(b) for a, b in zip(sums[i], members.sum(axis=0))]
            inertia[i] += int(distance[rows].astype(object).sum() if exact else distance[rows].sum())
        made = {"vec_id": batch["vec_id"], "cluster": pa.array(cluster, pa.int32())} | ({"distance": pa.array(distance)} if last else {"v": batch["v"]})
        yield pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(len(x), f.type)).cast(f.type) for f in _ARROW], schema=_ARROW)
    yield _summary(n, inertia, sums)


def first_centres(rows: DataFrame, k: int) -> list[tuple[int, ...]]:
    """The vectors of the k smallest SHA-256 of ``3:<vec_id>``, in that order; of equal ids the smaller vectors, null ids last."""
    order = [F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("v")]
    return [tuple(r["v"]) for r in rows.orderBy(*order).limit(k).collect()]


def _moved(summary: Sequence, centres: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Componentwise floors of the means; a cluster without members keeps its centroid."""
    out = list(centres)
    for r in summary:
        out[r["cluster"]] = tuple(int(s) // r["n"] for s in r["sums"])
    return out


def _totals(state: DataFrame) -> list:
    """A row of sums for each cluster that has members."""
    parts = state.filter("n is not null")
    sums = parts.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").cast("decimal(38,0)").alias("x"))
    sums = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("sums"))  # 64 of each
    counts = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"))
    return counts.join(sums, "cluster").collect()


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of all vectors that take part.

    ``vectors`` has vec_id and embedding; further columns are left out. A vector takes part if it has exactly 64
    components, none null or not finite; each is floor(1024 x), at the ends of a long if it is beyond, and a squared
    distance beyond it is its end. Repeated vectors and ids count as often as they are there; a null id is kept. With
    fewer than k vectors each is a centroid. Rounds end early when no centroid moves, as later ones would change nothing.
    ``centroid`` has the components. An empty table gives none.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = scaled(vectors).filter(F.size("v") == WIDTH)
    state = materialise(rows.withColumn("cluster", F.lit(0)), "vectors")
    centres, before = first_centres(state, k), None
    for done in range(rounds + 1):
        last = done == rounds or centres == before
        task = lambda batches, balls=Balls(centres, before), last=last: _round(batches, balls, last)
        source = state.filter("v is not null").select("vec_id", "v", "cluster")
        made = materialise(source.mapInArrow(task, ROWS), "clustered")
        discard(state)
        state, summary = made, _totals(made)
        if last:
            break
        centres, before = _moved(summary, centres), centres
    whole = sum(int(r["inertia"]) for r in summary)
    balls = [(r["cluster"], min(int(r["inertia"]), LONGEST), min(whole, LONGEST), list(centres[r["cluster"]])) for r in summary]
    balls = spark.createDataFrame(balls, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return state.filter("n is null").select("vec_id", "cluster", "distance").join(F.broadcast(balls), "cluster")  # k rows


def centroid_sha256(components: Sequence[int]) -> str:
    return sha256(",".join(map(str, components)).encode()).hexdigest()
