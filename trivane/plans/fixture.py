"""Knowledge-graph views of the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


#: (table, head prefix and column, tail prefix and column, relation)
EDGES = [
    ("customer", "c:", "c_custkey", "n:", "c_nationkey", "in_nation"),
    ("supplier", "s:", "s_suppkey", "n:", "s_nationkey", "in_nation"),
    ("nation", "n:", "n_nationkey", "r:", "n_regionkey", "in_region"),
    ("orders", "o:", "o_orderkey", "c:", "o_custkey", "placed_by"),
    ("lineitem", "o:", "l_orderkey", "p:", "l_partkey", "contains"),
    ("lineitem", "p:", "l_partkey", "s:", "l_suppkey", "supplied_by"),
]


def structure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples between the rows of the tables, repeats and all."""
    out = None
    for name, a, head, b, tail, relation in EDGES:
        one = table(spark, sf_dir, name).select(_named(a, head).alias("head"), _named(b, tail).alias("tail"), F.lit(relation).alias("relation"))
        out = one if out is None else out.union(one)
    return out


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct triples between the rows of the tables. Keys are made distinct before they become names, those of a head in one
    partition: who counts heads shuffles few rows."""
    by_relation: dict[str, DataFrame] = {}
    for name, a, head, b, tail, relation in EDGES:
        keys = table(spark, sf_dir, name).select(head, tail).repartition(head).distinct()
        one = keys.select(_named(a, head).alias("head"), _named(b, tail).alias("tail"), F.lit(relation).alias("relation"))
        # a relation of two tables may have a triple of both, if keys are null
        by_relation[relation] = by_relation[relation].union(one).distinct() if relation in by_relation else one
    first, *others = by_relation.values()
    for one in others:
        first = first.union(one)
    return first


STRUCTURE = "tri AS (" + " UNION ".join(f"SELECT '{a}' || {h} AS head, '{b}' || {t} AS tail, '{r}' AS relation FROM {n}" for n, a, h, b, t, r in EDGES) + ")"


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user, tens of value, event type)."""
    rows = table(spark, sf_dir, "events").filter("user_id is not null and value is not null and event_type is not null")
    return rows.select(_named("u:", "user_id").alias("head"), F.concat(F.lit("v:"), F.floor(F.col("value") / 10).cast("long").cast("string")).alias("tail"), F.col("event_type").alias("relation")).distinct()


ACTIVITY = """act AS (SELECT DISTINCT 'u:' || user_id AS head, 'v:' || floor(value / 10)::bigint AS tail, event_type AS relation
FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL)"""


def entity_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def relation_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label the vector of its smallest id, and as weights that of its largest."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("key"), vec.alias("vec"))
    return rows.groupBy("key").agg(F.min_by("vec", "vec_id").alias("vec"), F.max_by("vec", "vec_id").alias("w"))


def embedded_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    n = rows.count()
    return rows.select(F.col("vec_id").cast("string").alias("head"), ((F.col("vec_id") * 7 + 3) % n).cast("string").alias("tail"), F.col("label").cast("string").alias("relation"))


VECTORS = """ev AS (SELECT vec_id::varchar AS key, list_transform(embedding, lambda x: x::double) AS vec FROM embeddings),
rv AS (SELECT label::varchar AS key, arg_min(list_transform(embedding, lambda x: x::double), vec_id) AS vec,
              arg_max(list_transform(embedding, lambda x: x::double), vec_id) AS w FROM embeddings GROUP BY label),
et AS (SELECT vec_id::varchar AS head, ((vec_id * 7 + 3) % (SELECT count(*) FROM embeddings))::varchar AS tail, label::varchar AS relation FROM embeddings)"""
