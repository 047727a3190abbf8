"""The relational build: linked tables, counts, centiles, candidates and selections, in Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.functions import columns as C
from trivane.operators.ranking import first_rows, ntile, ranked, settled
from trivane.operators.stats import entity_counts, relation_counts


def tables_of(rows: DataFrame) -> dict[str, DataFrame]:
    """Entities, Relations, Triples, EntityLiteralStrings and EntityCategories from the rows of a dump.

    An entity is a concept if it is a head anywhere, or begins with ``concept:``. Of equal triples the one of highest
    probability stays. Surrogate keys follow the natural keys' order; a part without a row would be null.
    """
    heads = rows.select(F.col("entity").alias("name"), F.lit(True).alias("concept"))
    tails = rows.select(F.col("value").alias("name"), F.col("value").startswith("concept:").alias("concept"))
    merged = heads.union(tails).filter("name is not null").groupBy("name").agg(F.bool_or("concept").alias("isConcept"))
    entities = ranked(merged, [F.col("name")], rank="id")
    relations = ranked(rows.select(F.col("relation").alias("name")).filter("name is not null").distinct(), [F.col("name")], rank="id")
    best = rows.groupBy("entity", "relation", "value").agg(F.max("probability").alias("probability"))
    linked = best
    for column, to, ids in (("entity", "head", entities), ("value", "tail", entities), ("relation", "relationId", relations)):
        linked = linked.join(ids.select(F.col("name").alias(column), F.col("id").alias(to)), column, "left")
    triples = linked.select("head", F.col("relationId").alias("relation"), "tail", "probability")
    named = lambda entity, column, to: rows.select(F.col(entity).alias("name"), F.explode_outer(F.split(column, r"\s+")).alias(to)).filter(f"{to} is not null and {to} != ''")
    literals = named("entity", "entity_literals", "literal").union(named("value", "value_literals", "literal")).distinct()
    categories = named("entity", "entity_categories", "category").union(named("value", "value_categories", "category")).distinct()
    return {"Entities": entities, "Relations": relations, "Triples": triples, "EntityLiteralStrings": literals, "EntityCategories": categories}


def with_centiles(counts: DataFrame, key: str) -> DataFrame:
    """Counts with their centile, ties by key."""
    return ntile(counts, [F.col("n"), F.col(key)], 100, "centile")


def candidates(triples: DataFrame, concepts: DataFrame, entity_min: int = 10, relation_min: int = 5) -> DataFrame:
    """Triples between concepts whose entities and relation appear often; an entity counts once in a triple."""
    entities = settled(entity_counts(triples, once=True).filter(F.col("n") >= entity_min).join(concepts, "entity", "left_semi").select("entity"))
    relations = settled(relation_counts(triples).filter(F.col("n") >= relation_min))  # of known size: a shuffle by so few keys would be skewed
    out = triples.join(relations, "relation", "left_semi")
    for side in ("head", "tail"):
        out = out.join(entities.select(F.col("entity").alias(side)), side, "left_semi")
    return out


def selected(
    triples: DataFrame,
    probability: tuple[float, float] = (0.95, 1.0),
    entity_centiles: tuple[int, int] = (95, 100),
    relation_centiles: tuple[int, int] = (10, 40),
    most: int = 600_000,
) -> DataFrame:
    """Triples in ranges of probability and centiles, both ends included; at most ``most``, in the order of their parts."""
    entities = settled(with_centiles(entity_counts(triples, once=True), "entity").filter(F.col("centile").between(*entity_centiles)).select("entity"))
    relations = settled(with_centiles(relation_counts(triples), "relation").filter(F.col("centile").between(*relation_centiles)))
    out = triples.filter(F.col("probability").between(*probability)).join(relations, "relation", "left_semi")
    for side in ("head", "tail"):
        out = out.join(entities.select(F.col("entity").alias(side)), side, "left_semi")
    return first_rows(settled(out), [F.col(c) for c in ("head", "relation", "tail")], most)  # read in several passes


def grid_sizes(triples: DataFrame, grid: list[dict[str, float]]) -> DataFrame:
    """For each set of parameters (min_probability, max_probability, min_centile, max_centile) the number ``n`` of triples that it
    selects: probability and the centiles of both entities in the ranges, ends included.

    One pass serves all sets: each triple goes to those that it fits, of which only counts are shuffled. Without centiles a
    set has all of them.
    """
    names = ("min_probability", "max_probability", "min_centile", "max_centile")
    held = [(*(float(x[n]) for n in names[:2]), *(int(x.get(n, default)) for n, default in zip(names[2:], (0, 100)))) for x in grid]
    sets = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, x)]) for x in held])
    centiles = settled(with_centiles(entity_counts(triples, once=True), "entity").select("entity", "centile"))
    rows = triples.select("head", "tail", "probability")
    for side in ("head", "tail"):
        rows = rows.join(centiles.select(F.col("entity").alias(side), F.col("centile").alias(f"_{side}")), side)
    low, high = F.least("_head", "_tail"), F.greatest("_head", "_tail")
    fits = lambda x: F.col("probability").between(x["min_probability"], x["max_probability"]) & (low >= x["min_centile"]) & (high <= x["max_centile"])
    sizes = rows.select(F.explode(F.filter(sets, fits)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).select("x.*", "n")
    every = triples.sparkSession.createDataFrame(held, "min_probability double, max_probability double, min_centile int, max_centile int")
    return every.join(sizes, list(names), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def prepared(text, kind: str):
    """A dump's text as a typed value: NaN and text that is no number become null."""
    clean = C.not_a_number_to_null(F.trim(text))
    if kind in ("int", "double"):
        return clean.try_cast(kind)
    return F.lower(clean).isin("true", "t", "1") if kind == "boolean" else C.url_decoded(clean)


def built(rows: DataFrame, entity_min: int = 10, relation_min: int = 5) -> dict[str, DataFrame]:
    """The whole build from a dump's rows: its tables, counts of entities and relations, and the candidate triples."""
    tables = {name: settled(df) for name, df in tables_of(rows).items()}
    triples = tables["Triples"].dropna(subset=["head", "tail", "relation"])
    concepts = tables["Entities"].filter("isConcept").select(F.col("id").alias("entity"))
    counts = {"EntityCounts": with_centiles(entity_counts(triples, once=True), "entity"), "RelationCounts": with_centiles(relation_counts(triples), "relation")}
    return tables | counts | {"CandidateTriples": candidates(triples, concepts, entity_min, relation_min)}


def inserted(held: DataFrame, page: DataFrame, key: list[str]) -> DataFrame:
    """``held`` and those rows of ``page`` whose key is new; of several of one key the first in the order of the others stays."""
    others = [c for c in held.columns if c not in key]
    new = page.select(*held.columns).join(held.select(*key), key, "left_anti")
    new = new.groupBy(*key).agg(F.min(F.struct(*others)).alias("_row")).select(*key, "_row.*") if others else new.distinct()
    return held.unionByName(new)


def united(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct rows of both."""
    return left.unionByName(right).distinct()


def common(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct rows that both have."""
    return left.intersect(right.select(*left.columns))


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of ``left``, repeats and all, that ``right`` does not have; nulls are equal."""
    gone = right.select(*[F.col(c).alias(f"_{c}") for c in left.columns]).distinct()
    return left.join(gone, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in left.columns], "left_anti")
