"""Dense ids of entities and relations, and translation between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.operators.ranking import ranked, settled


#: Of more ids each task keeps its share in a hash table; of fewer Spark chooses the join.
MANY = 1_000_000


def _first_seen(seen: DataFrame) -> DataFrame:
    """Ids of ``key`` by the first ``head`` position, then the first ``tail`` position: two plain minima, which are hashed, not sorted."""
    first = seen.groupBy("key").agg(F.min("head").alias("head"), F.min("tail").alias("tail"))
    order = [F.col("head").asc_nulls_last(), F.col("tail"), F.col("key")]
    return ranked(first, order).select("key", (F.col("rank") - 1).alias("idx"))


def entity_ids(triples: DataFrame, position: str = "pos") -> DataFrame:
    """0-based ids of entities: all heads in order, then all tails, each where it is seen first."""
    none = F.lit(None).cast(triples.schema[position].dataType)
    heads = triples.select(F.col("head").alias("key"), F.col(position).alias("head"), none.alias("tail"))
    tails = triples.select(F.col("tail").alias("key"), none.alias("head"), F.col(position).alias("tail"))
    return _first_seen(heads.unionByName(tails))


def relation_ids(triples: DataFrame, position: str = "pos") -> DataFrame:
    none = F.lit(None).cast(triples.schema[position].dataType)
    return settled(_first_seen(triples.select(F.col("relation").alias("key"), F.col(position).alias("head"), none.alias("tail"))))  # few rows, of known size


def to_dense(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """External to dense ids; what has no id becomes null. Relations are first, so that their names are not shuffled with the entities'."""
    out = triples
    many = entities.count() > MANY
    for column, ids in (("relation", relations), ("head", entities), ("tail", entities)):
        named = ids.select(F.col("key").alias(column), F.col("idx").alias(f"_{column}_idx"))
        out = out.join(named.hint("shuffle_hash") if many and ids is entities else named, column, "left")
    kept = [c for c in triples.columns if c not in ("head", "tail", "relation")]
    return out.select(*[F.col(f"_{c}_idx").alias(c) for c in ("head", "tail", "relation")], *kept)


def to_external(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Dense to external ids."""
    swap = lambda ids: ids.select(F.col("idx").alias("key"), F.col("key").alias("idx"))
    return to_dense(triples, swap(entities), swap(relations))


def redensified(ids: DataFrame, removed: DataFrame) -> DataFrame:
    """Ids without the removed keys, without holes, in the order they had."""
    left = ids.join(removed.select("key"), "key", "left_anti")
    return ranked(left, [F.col("idx")]).select("key", (F.col("rank") - 1).alias("idx"))


def rewritten(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations replaced by a map (source, target); others stay."""
    new = mapping.select(F.col("source").alias("relation"), F.col("target").alias("_target"))
    return triples.join(new, "relation", "left").withColumn("relation", F.coalesce("_target", "relation")).select(*triples.columns)
