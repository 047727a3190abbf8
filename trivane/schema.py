"""Schemas of knowledge-graph tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from trivane.operators import ids

TRIPLE = "head string, tail string, relation string"
SCORED = "head string, tail string, relation string, energy double"
CONFIDENCE = "head string, tail string, relation string, confidence double"
CATEGORY = "entity string, category string, confidence double"
ID_MAP = "key string, idx long"


@dataclass(frozen=True)
class Dataset:
    """Triples with a ``split`` column, and dense ids (key, idx) of entities and relations. ``dataclasses.replace`` makes
    another that shares what does not change."""

    triples: DataFrame
    entities: DataFrame
    relations: DataFrame

    def split(self, name: str) -> DataFrame:
        return self.triples.filter(self.triples["split"] == name).drop("split")

    def dense(self) -> DataFrame:
        """The triples by dense ids."""
        return ids.to_dense(self.triples, self.entities, self.relations)
