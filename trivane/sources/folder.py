"""A dataset as a folder: dense ids of entities and relations, and the triples of each split."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.schema import Dataset
from trivane.shared import names_in, renamed, touch
from trivane.sources import readers

# The names of a dataset's files.
ENTITIES, RELATIONS = "entity2id.txt", "relation2id.txt"
SPLITS = {"train": "train.txt", "test": "test.txt", "valid": "valid.txt"}
#: Stands in a folder that is whole.
WHOLE = "_WHOLE"


def is_written(spark: SparkSession, folder: str) -> bool:
    return WHOLE in names_in(spark, folder)


def _write_ids(ids: DataFrame, path: str) -> None:
    rows = ids.repartitionByRange("idx").sortWithinPartitions("idx")
    rows.select(F.concat_ws("\t", "key", F.col("idx").cast("string")).alias("value")).write.text(path)


def write_dataset(dataset: Dataset, folder: str, base: str | None = None, unchanged: Sequence[str] = ()) -> bool:
    """Writes a dataset to its folder, files as ordered parts; False, and nothing is done, if it is there already.

    The triples are written in one pass for all splits. The files ``unchanged`` are copied, by Spark's tasks, from the
    folder ``base`` of the dataset that this one was made of. All is written beside the folder and renamed at the end, so a job that fails
    leaves no half of a dataset; cells must not have tabs or line ends. A split without triples is an empty file.
    """
    spark = dataset.triples.sparkSession
    if is_written(spark, folder):
        return False
    at = f"{folder.rstrip('/')}.writing-{uuid.uuid4().hex}"
    changed = [name for name in SPLITS if SPLITS[name] not in unchanged]
    if changed:
        rows = dataset.triples.filter(F.col("split").isin(changed))
        rows.select("split", F.concat_ws("\t", "head", "tail", "relation").alias("value")).write.partitionBy("split").text(f"{at}/_triples")
        made = names_in(spark, f"{at}/_triples")
        for name in changed:
            if f"split={name}" in made:
                renamed(spark, f"{at}/_triples/split={name}", f"{at}/{SPLITS[name]}")
            else:
                touch(spark, f"{at}/{SPLITS[name]}/part-00000")
    for name, ids in ((ENTITIES, dataset.entities), (RELATIONS, dataset.relations)):
        if name not in unchanged:
            _write_ids(ids, f"{at}/{name}")
    for name in unchanged:
        readers.lines(spark, f"{base}/{name}").write.text(f"{at}/{name}")
    touch(spark, f"{at}/{WHOLE}")
    renamed(spark, at, folder)
    return True


def read_dataset(spark: SparkSession, folder: str) -> Dataset:
    """What ``write_dataset`` wrote; the triples of all splits are one scan."""
    rows = readers.named_lines(spark, [f"{folder}/{name}" for name in SPLITS.values()])
    split = F.coalesce(*[F.when(F.col("name") == name, split) for split, name in SPLITS.items()])
    cells = F.split("value", "\t")
    triples = rows.filter("value != ''").select(*[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(("head", "tail", "relation"))], split.alias("split"))
    return Dataset(triples, readers.id_map(spark, f"{folder}/{ENTITIES}"), readers.id_map(spark, f"{folder}/{RELATIONS}"))
