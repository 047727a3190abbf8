"""Whole datasets made from others: samples, fewer or collapsed relations, the grid of sparse and noisy ones."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.functions import columns as C
from trivane.operators import ids, perturb, pruned, scoring
from trivane.operators.ranking import ranked, settled
from trivane.schema import Dataset
from trivane.sources import readers

KEY = ["head", "tail", "relation"]


def dataset(triples: DataFrame) -> Dataset:
    """Triples with their split, and ids in the order in which the sorted triples show entities and relations."""
    placed = ranked(triples.select(*KEY), [F.col(c) for c in KEY], rank="pos", distinct=True)
    return Dataset(triples, settled(ids.entity_ids(placed)), settled(ids.relation_ids(placed)))


def sampled(whole: Dataset, size: int, seed: int = 4) -> Dataset:
    """``size`` triples of all splits, split anew, with ids of their own."""
    return dataset(settled(perturb.split(perturb.sample_triples(whole.triples.select(*KEY), size, seed), seed)))


def with_fewer_relations(whole: Dataset, n: int, seed: int = 4) -> tuple[Dataset, DataFrame]:
    """(dataset, removed triples): relations with at least ``n`` train triples go from all splits; ids have no holes."""
    gone = settled(perturb.removal_relations(whole.split("train"), n, seed))
    marked = perturb.without_relations(whole.triples, gone)
    left = marked.filter("not removed").drop("removed")
    relations = ids.redensified(whole.relations, gone.withColumnRenamed("relation", "key"))
    return replace(whole, triples=left, relations=relations), marked.filter("removed").drop("removed")


def collapsed(whole: Dataset, n: int, seed: int = 4) -> tuple[Dataset, DataFrame]:
    """(dataset, map): ``n`` relations become others in all splits; ids have no holes."""
    mapping = settled(perturb.collapse_map(whole.triples, n, seed))
    relations = ids.redensified(whole.relations, mapping.withColumnRenamed("source", "key"))
    return replace(whole, triples=ids.rewritten(whole.triples, mapping), relations=relations), mapping


def grid(triples: DataFrame, removed: int, step: int, levels: int, shares: list[float], seed: int = 4) -> DataFrame:
    """The datasets of the sparsity and noise grid: (level, share, head, tail, relation, corrupted).

    Level -1 is the base, without the ``removed`` triples; the cells of ``perturb.grid`` have theirs beside the base's. A
    triple that is corrupted in several cells is the same in all of them, and has null parts if all attempts at it fail.
    """
    cells = settled(perturb.grid(triples, removed, step, levels, shares, seed))
    out = perturb.shuffled(triples, seed, KEY, "_out")
    base = out.filter(F.col("_out") > removed).select(*KEY)
    changed = perturb.replaced(cells.filter("corrupt").select(*KEY).distinct(), triples, seed)
    new = [F.when(F.col("corrupt"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in KEY]
    added = cells.join(changed, KEY, "left").select("level", "share", *new, F.col("corrupt").alias("corrupted"))
    plain = F.lit(False).alias("corrupted")
    every = cells.select("level", "share").distinct().crossJoin(base).select("level", "share", *KEY, plain)  # the grid's datasets
    return base.select(F.lit(-1).alias("level"), F.lit(0.0).alias("share"), *KEY, plain).unionByName(every).unionByName(added)


def scored_folder(triples: DataFrame, embedding: str, data: str, corrupt: bool = False, below: float | None = None) -> DataFrame:
    """Energies of triples of external ids, or with ``corrupt`` of their corruptions, by an embedding's folder.

    The folder's name has the method and distance; ``data`` is the folder with entity2id.txt and relation2id.txt, whose
    ids are the lines of the vectors.
    """
    spark = triples.sparkSession
    method, distance = C.method_of_path(embedding)
    held = []
    for name, rows in zip(("entity2id.txt", "relation2id.txt"), readers.embedding_folder(spark, embedding)):
        held.append(readers.id_map(spark, f"{data}/{name}").join(rows, "idx").drop("idx"))
    entities, relations = held
    if not corrupt:
        return scoring.score(triples, entities, relations, method, distance, below)
    universe = entities.select(F.col("key").alias("entity"))
    if below is not None and method == "transe":  # its energies are distances, so an index leaves out most pairs
        return pruned.below(triples, universe, entities, relations, below, distance)
    return scoring.scored_corruptions(triples, universe, entities, relations, method, distance, below)

