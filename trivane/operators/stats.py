"""Counts, dataset statistics and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.operators.ranking import ranked, settled


def entity_counts(triples: DataFrame, once: bool = False) -> DataFrame:
    """Appearances of each entity; a loop counts twice, or with ``once`` a triple counts once for an entity."""
    both = F.array("head", "tail")
    ends = F.explode(F.array_distinct(both) if once else both)
    return triples.select(ends.alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def relation_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def frequent_triples(triples: DataFrame, counted: DataFrame, entity_min: int = 10, relation_min: int = 5) -> DataFrame:
    """Triples whose parts appear often enough in ``counted``."""
    entities = entity_counts(counted).filter(F.col("n") >= entity_min)
    relations = settled(relation_counts(counted).filter(F.col("n") >= relation_min))
    out = triples
    for side in ("head", "tail"):
        out = out.join(entities.select(F.col("entity").alias(side)), side, "left_semi")
    return out.join(relations, "relation", "left_semi")


def dataset_stats(triples: DataFrame) -> DataFrame:
    """Thirteen measures of each split, and of all as ``Total``."""
    rows = triples.select("head", "tail", "relation", F.explode(F.array(F.lit("Total"), "split")).alias("label"))
    ends = rows.select("label", "relation", F.explode(F.array("head", "tail")).alias("entity"))
    per_entity = ends.groupBy("label", "entity").agg(F.countDistinct("relation").alias("relations"), F.count(F.lit(1)).alias("triples"))
    per_relation = ends.groupBy("label", "relation").agg(F.countDistinct("entity").alias("entities"), (F.count(F.lit(1)) / 2).alias("triples"))
    by_entity = per_entity.groupBy("label").agg(
        F.count(F.lit(1)).alias("entities"), F.avg("relations").alias("relations_per_entity_mean"), F.median("relations").alias("relations_per_entity_median"),
        F.avg("triples").alias("triples_per_entity_mean"), F.median("triples").alias("triples_per_entity_median"),
    )
    by_relation = per_relation.groupBy("label").agg(
        F.count(F.lit(1)).alias("relations"), F.avg("entities").alias("entities_per_relation_mean"), F.median("entities").alias("entities_per_relation_median"),
        F.avg("triples").alias("triples_per_relation_mean"), F.median("triples").alias("triples_per_relation_median"),
    )
    out = rows.groupBy("label").agg(F.count(F.lit(1)).alias("triples")).join(by_entity, "label").join(by_relation, "label")
    return out.withColumn("triples_per_entity", F.col("triples") / F.col("entities")).withColumn("triples_per_relation", F.col("triples") / F.col("relations"))


def stats_row(stats: DataFrame) -> DataFrame:
    """All labels' measures in one row, ``Label_measure`` each."""
    measures = [c for c in stats.columns if c != "label"]
    labels = ["Total", "test", "train", "valid"]
    return stats.agg(*[F.max(F.when(F.col("label") == x, F.col(m))).alias(f"{x}_{m}") for x in labels for m in measures])


def histogram(values: DataFrame, column: Column, buckets: int = 10, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Counts in equal ranges (bucket, lo, hi, n); a border belongs to the lower bucket. Equal values are all in bucket 0."""
    rows = values.select(column.cast("double").alias("v")).filter("v is not null")
    ends = rows.agg((F.min("v") if lo is None else F.lit(lo)).alias("a"), (F.max("v") if hi is None else F.lit(hi)).alias("b"))
    share = F.coalesce(F.try_divide(F.col("v") - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0))
    at = (share * buckets - 1e-7).cast("int")
    counts = rows.crossJoin(ends).groupBy(at.alias("bucket"), "a", "b").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("b") - F.col("a")) / buckets
    return counts.select("bucket", (F.col("a") + F.col("bucket") * width).alias("lo"), (F.col("a") + (F.col("bucket") + 1) * width).alias("hi"), "n")


def value_stats(values: DataFrame, column: str = "energy") -> DataFrame:
    """Count, distinct rounded values, mean, variance and deviation (of all values), ends, quarters of the range, median.

    A border of two quarters belongs to the lower one. Equal values are all in the first.
    """
    rounded = values.select(F.round(column, 2).alias("v"))
    counts = rounded.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    run = ranked(counts, [F.col("v")], {"seen": F.col("n")})
    whole = rounded.agg(
        F.count(F.lit(1)).alias("triples"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.stddev_pop("v").alias("deviation"), F.min("v").alias("min"), F.max("v").alias("max"),
    )
    middle = run.crossJoin(whole.select("triples")).filter(F.col("seen") >= F.floor(F.col("triples") / 2)).agg(F.min("v").alias("median"))
    share = F.coalesce(F.try_divide(F.col("v") - F.col("min") - 1e-7, F.col("max") - F.col("min")), F.lit(0.0))
    quarter = F.floor((share * 100).cast("int") / 25)
    quarters = counts.crossJoin(whole.select("min", "max")).agg(F.count(F.lit(1)).alias("distinct_values"), *[F.coalesce(F.sum(F.when(quarter == q, F.col("n"))), F.lit(0)).alias(f"quarter_{q + 1}") for q in range(4)])
    return whole.crossJoin(middle).crossJoin(quarters)
