"""Whole datasets (head, tail, relation, split) from what the readers give."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.functions import columns as C
from trivane.operators import ontology, perturb, scoring, stats
from trivane.operators.ranking import settled
from trivane.plans import datasets
from trivane.shared import names_in, renamed, touch
from trivane.sources import catalogs, folder, readers

KEY = ["head", "tail", "relation"]
#: The relation between an entity and its category.
CATEGORY = "0"


def training(triples: DataFrame, least: float = 0.0, categories: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Distinct triples of at least the confidence, with (head, tail) of ``categories``, and what ``rules`` add."""
    rows = triples.filter(F.col("confidence") >= least).select(*KEY)
    if categories is not None:
        rows = rows.unionByName(categories.select("head", "tail", F.lit(CATEGORY).alias("relation")))
    rows = rows.distinct()
    return rows if rules is None else ontology.expanded(rows, rules)


def with_gold(train: DataFrame, gold: DataFrame, entity_min: int = 10, relation_min: int = 5, seed: int = 4) -> DataFrame:
    """Train triples as they are; gold triples whose parts they have often enough, half test (rounded down), half valid.

    The strict variant has both least counts at 1.
    """
    kept = stats.frequent_triples(gold.select(*KEY).distinct(), train, entity_min, relation_min).select(*KEY)
    half = kept.count() // 2
    split = F.when(F.col("rank") <= half, "test").otherwise("valid")
    held = perturb.shuffled(kept, seed, KEY).select(*KEY, split.alias("split"))
    return train.select(*KEY, F.lit("train").alias("split")).unionByName(held)


def extracted(triples: DataFrame, annotations: DataFrame | None = None, seed: int = 4) -> DataFrame:
    """A dataset of extractions: split by chance, or all train with the valid annotations of known parts as test."""
    rows = triples.select(*KEY).distinct()
    if annotations is None:
        return perturb.split(rows, seed)
    known = readers.annotated_in(annotations.filter("is_valid"), rows).select(*KEY).distinct()
    return rows.withColumn("split", F.lit("train")).unionByName(known.withColumn("split", F.lit("test")))


def from_folder(spark: SparkSession, source: str, least: float = 0.99, strict: bool = False, categories: bool = False, ontological: bool = False, seed: int = 4) -> tuple[DataFrame, DataFrame]:
    """(dataset, counts) from a folder of extraction files.

    Train are the distinct triples, and with ``categories`` the categories as triples, of at least the confidence ``least``, with what the
    folder's ontology adds if ``ontological``. Test and valid are halves of the gold triples whose parts train has
    often enough. ``strict`` takes only what was extracted, and gold triples whose parts train has at all. ``counts`` has
    the rows and the rejected ones of each kind. All files are one scan, whose accepted rows are written for the rest.
    """
    names = (catalogs.STRICT_TRIPLES, catalogs.STRICT_CATEGORIES) if strict else (catalogs.TRIPLES, catalogs.CATEGORIES)
    kinds = [("triples", names[0], False, least), ("gold", catalogs.TEST_TRIPLES, False, 0.1)]
    kinds += [("categories", names[1], True, least)] if categories else []
    rows = settled(readers.catalog(spark, source, kinds))
    counts = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("accepted")).alias("rejected"))
    held = rows.filter("accepted")
    rules = readers.ontology(spark, source) if ontological else None
    train = settled(training(held.filter("kind != 'gold'"), rules=rules))
    often = (1, 1) if strict else (10, 5)
    return with_gold(train, held.filter("kind = 'gold'"), *often, seed), counts


def replaced_folder(spark: SparkSession, source: str, target: str, scored: DataFrame) -> bool:
    """A folder of extraction files with confidences by an embedding: those of the catalogs' replaced files are 1 - the share of the
    range of all energies of ``scored`` (triple, energy), where a row has one. False if it is there already.

    The files of the catalogs are one pass, in which rows meet their energies; of others, as an ontology's, the order of lines
    counts, so they are copied in it. A category is a triple of relation 0. The folder is renamed when it is whole.
    """
    if folder.is_written(spark, target):
        return False
    at, held = f"{target.rstrip('/')}.writing-{uuid.uuid4().hex}", names_in(spark, source)
    pairs = [n for n in held if n in catalogs.CATEGORIES + catalogs.TEST_CATEGORIES]
    known = pairs + [n for n in held if n in catalogs.TRIPLES + catalogs.TEST_TRIPLES]
    cell = lambda i: C.stripped(F.get(F.split("value", "\t"), F.lit(i)))
    relation = F.when(F.col("name").isin(pairs), F.lit(CATEGORY)).otherwise(cell(2))
    rows = readers.named_lines(spark, [f"{source}/{n}" for n in known]).select("name", "value", cell(0).alias("head"), cell(1).alias("tail"), relation.alias("relation"))
    replaced = F.col("name").isin(*catalogs.REPLACED_TRIPLES, *catalogs.REPLACED_CATEGORIES)
    new = scoring.normalised(scored.select(*KEY, "energy"), "energy").withColumnRenamed("energy", "_new")
    parts = F.when(F.col("name").isin(pairs), F.concat_ws("\t", "head", "tail")).otherwise(F.concat_ws("\t", *KEY))
    line = F.when(replaced & F.col("_new").isNotNull(), F.concat_ws("\t", parts, F.col("_new").cast("string"))).otherwise(F.col("value"))
    rows.join(new, KEY, "left").select(F.col("name").alias("file"), line.alias("value")).write.partitionBy("file").text(f"{at}/_rows")
    made = names_in(spark, f"{at}/_rows")
    for name in known:
        if f"file={name}" in made:
            renamed(spark, f"{at}/_rows/file={name}", f"{at}/{name}")
        else:
            touch(spark, f"{at}/{name}")
    for name in held:
        if name not in known and not name.startswith(("_", ".")):
            copied = readers.numbered(spark, f"{source}/{name}").repartitionByRange("line").sortWithinPartitions("line")
            copied.select("value").write.text(f"{at}/{name}")
    touch(spark, f"{at}/{folder.WHOLE}")
    renamed(spark, at, target)
    return True


#: The files of the lexical database.
LEXICAL = ("data.adj", "data.adv", "data.noun", "data.verb")


def _to_folder(triples: DataFrame, target: str, seed: int) -> bool:
    """Distinct triples, split by chance, as a dataset's folder; False if it is there already, and then nothing is read."""
    spark = triples.sparkSession
    if folder.is_written(spark, target):
        return False
    return folder.write_dataset(datasets.dataset(settled(perturb.split(settled(triples.distinct()), seed))), target)


def rdf_to_folder(spark: SparkSession, dump: str | list[str], target: str, seed: int = 4) -> bool:
    """A dataset's folder from an RDF dump, compressed or not."""
    return _to_folder(readers.freebase(readers.lines(spark, dump)), target, seed)


def lexical_to_folder(spark: SparkSession, source: str, target: str, seed: int = 4) -> bool:
    """A dataset's folder from the four data files of a lexical database."""
    return _to_folder(readers.wordnet(readers.lines(spark, [f"{source}/{name}" for name in LEXICAL])), target, seed)
