"""Embedding scores of triples and of their corruptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivane.functions import columns as C
from trivane.operators import tiles
from trivane.operators.best import best
from trivane.operators.ranking import ranked, settled

KEY = ["head", "tail", "relation"]


def _vectors(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Vectors by head, by tail, and by relation with the weights, whose names are returned too."""
    h, t = (entities.select(F.col("key").alias(side), F.col("vec").alias(f"_{side[0]}")) for side in ("head", "tail"))
    weights = [c for c in relations.columns if c not in ("key", "vec")]
    return h, t, relations.select(F.col("key").alias("relation"), F.col("vec").alias("_r"), *[F.col(c).alias(f"_w_{c}") for c in weights]), weights


def _energy(method: str, distance: str, weights: list[str]):
    return C.energy(method, distance, h=F.col("_h"), r=F.col("_r"), t=F.col("_t"), **{c: F.col(f"_w_{c}") for c in weights}).alias("energy")


def score(triples: DataFrame, entities: DataFrame, relations: DataFrame, method: str = "transe", distance: str = "L1", below: float | None = None) -> DataFrame:
    """Energy of each distinct triple.

    ``entities`` (key, vec) and ``relations`` (key, vec, and the method's weights w or w1, w2). Triples with a part
    that has no vector are dropped; with ``below`` also those of a higher energy. The joins are left to Spark,
    which broadcasts vectors only as far as their size allows.
    """
    h, t, r, weights = _vectors(entities, relations)
    rows = triples.select(*KEY).distinct().join(h, "head").join(t, "tail").join(r, "relation")
    out = rows.select(*KEY, _energy(method, distance, weights))
    return out if below is None else out.filter(F.col("energy") <= below)


def entity_universe(*triples: DataFrame) -> DataFrame:
    """All distinct entities of the triples, as ``entity``."""
    out = None
    for one in triples:
        both = one.select(F.col("head").alias("entity")).union(one.select(F.col("tail").alias("entity")))
        out = both if out is None else out.union(both)
    return out.distinct()


def _halves(triples: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tail, relation) where heads are replaced; (head, relation) where tails are; and the entities as tails.

    The two latter say what the first half has already: ``_known`` heads with the tail's ``_others``.
    """
    by_tail, by_head = triples.select("tail", "relation").distinct(), triples.select("head", "relation").distinct()
    others = by_tail.groupBy("tail").agg(F.collect_set("relation").alias("_others"))
    ends = entities.select(F.col("entity").alias("tail")).join(others, "tail", "left")
    known = entities.select(F.col("entity").alias("head"), F.lit(True).alias("_known"))
    return by_tail, by_head.join(known, "head", "left"), ends


def _twice() -> Column:
    return F.coalesce(F.col("_known") & F.array_contains("_others", F.col("relation")), F.lit(False))


def corruptions(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Every triple with its head, and with its tail, replaced by every entity; distinct, the triple itself included.

    Equal (tail, relation) and (head, relation) are made one before they meet the distinct entities: the product with
    the entities is the result itself, so nothing smaller can be joined. It is made in tiles by many tasks. What both halves would have is left
    out of the second as it is made, so the product is not shuffled.
    """
    by_tail, by_head, ends = _halves(triples, entities)
    heads = tiles.product(by_tail, entities.select(F.col("entity").alias("head")), ["tail", "relation"], "head")
    return heads.select(*KEY).union(tiles.product(by_head, ends, ["head", "relation"], "tail").filter(~_twice()).select(*KEY))


def searches(limits: dict[str, DataFrame], entities: DataFrame, vectors: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Searches and entities for ``tiles.taken``.

    ``limits`` has by the side that is kept (side, relation, most), and others, ``entities`` (entity). Searches are ``known`` if the entities have
    what they keep, and an entity has the ``limits`` (relation, most) of the searches in which it is the tail.
    """
    vec = vectors.select(F.col("key").alias("name"), "vec")
    r = relations.select(F.col("key").alias("relation"), F.col("vec").alias("r"))
    known = entities.select(F.col("entity").alias("name"), F.lit(True).alias("known"))
    asked = None
    for side, rows in limits.items():
        one = rows.withColumnRenamed(side, "name").withColumn("kind", F.lit(side))
        asked = one if asked is None else asked.unionByName(one)
    asked = asked.join(known, "name", "left").fillna(False, ["known"]).join(vec, "name").join(r, "relation")
    held = limits["tail"].groupBy(F.col("tail").alias("name")).agg(F.collect_set(F.struct("relation", "most")).alias("limits"))
    return asked, entities.select(F.col("entity").alias("name")).join(vec, "name").join(held, "name", "left")


def _all_searches(triples: DataFrame, entities: DataFrame, vectors: DataFrame, relations: DataFrame, below: float | None = None) -> tuple[DataFrame, DataFrame, int]:
    most = F.lit(below).cast("double").alias("most")
    asked, met = searches({side: triples.select(side, "relation").distinct().withColumn("most", most) for side in ("head", "tail")}, entities, vectors, relations)
    return tiles.dealt(settled(tiles.narrow(asked)), settled(tiles.narrow(met)), ["kind", "name", "relation"], "name")


def scored_corruptions(triples: DataFrame, entities: DataFrame, vectors: DataFrame, relations: DataFrame, method: str = "transe", distance: str = "L1", below: float | None = None) -> DataFrame:
    """The energies of ``corruptions(triples, entities)``, or of them those of at most ``below``.

    Translation energies are computed in arrays, tile by tile. For other methods the vectors meet the kept parts and the
    entities before the product, which only computes the energy.
    """
    if method.lower() == "transe":
        return tiles.taken(*_all_searches(triples, entities, vectors, relations, below), tiles.corruptions, tiles.RESULT, distance, None if below is None else tiles.within)
    h, t, r, weights = _vectors(vectors, relations)
    by_tail, by_head, ends = _halves(triples, entities)
    energy = _energy(method, distance, weights)
    heads = tiles.product(by_tail.join(t, "tail").join(r, "relation"), entities.select(F.col("entity").alias("head")).join(h, "head"), ["tail", "relation"], "head")
    tails = tiles.product(by_head.join(h, "head").join(r, "relation"), ends.join(t, "tail"), ["head", "relation"], "tail").filter(~_twice())
    out = heads.select(*KEY, energy).union(tails.select(*KEY, energy))
    return out if below is None else out.filter(F.col("energy") <= below)


def corruption_counts(triples: DataFrame, entities: DataFrame, vectors: DataFrame, relations: DataFrame, distance: str = "L1") -> DataFrame:
    """(energy, n): how many of ``corruptions(triples, entities)`` have a translation energy, rounded to hundredths. Only counts leave a task."""
    counts = tiles.taken(*_all_searches(triples, entities, vectors, relations), tiles.counted, tiles.COUNTS, distance)
    return counts.groupBy(F.round("energy", 2).alias("energy")).agg(F.sum("n").alias("n"))


def cutoffs(scored: DataFrame, side: str) -> DataFrame:
    """The highest energy of the triples that share a side and the relation."""
    return scored.groupBy(side, "relation").agg(F.max("energy").alias(f"{side}_cutoff"))


def skyline(test_scored: DataFrame, corrupt_scored: DataFrame) -> DataFrame:
    """Corruptions whose energy is at most that of a test triple with the same head, or tail, and relation."""
    out = corrupt_scored
    for side in ("head", "tail"):
        out = out.join(cutoffs(test_scored, side), [side, "relation"], "left")
    kept = (F.col("energy") <= F.col("head_cutoff")) | (F.col("energy") <= F.col("tail_cutoff"))
    return out.filter(kept).select(*KEY, "energy")


#: Searches and entities of a tile where each search takes its best of it, which are far more than its vectors.
TOP_SIZES = 1024, 20480


def top_pairs(test: DataFrame, universe: DataFrame, vectors: DataFrame, relations: DataFrame, n: int = 500, method: str = "transe", distance: str = "L1") -> DataFrame:
    """Distinct (head, tail) of the n corruptions of lowest energy of each test triple, ties by head and tail.

    Each (head, relation) and (tail, relation) of the test triples is one search over the entities of ``universe``
    (entity), of which every task keeps the n best before anything is shuffled. A triple's are among those of its two
    searches. Entities are numbered in the order of their names, so ties are those of the names.
    """
    h, t, r, weights = _vectors(vectors, relations)
    named = settled(ranked(universe.select("entity"), [F.col("entity")], rank="item"))
    ids = settled(ranked(test.select(*KEY).distinct(), [F.col(c) for c in KEY], rank="test"))
    kept = [ids.select(F.lit(side).alias("kind"), F.col(side).alias("name"), "relation") for side in ("head", "tail")]
    asked = settled(ranked(kept[0].union(kept[1]).distinct(), [F.col(c) for c in ("kind", "name", "relation")], rank="group"))
    if method.lower() == "transe":
        vec = vectors.select(F.col("key").alias("name"), "vec")
        left = asked.join(vec, "name").join(r.select("relation", F.col("_r").alias("r")), "relation")
        right = named.withColumnRenamed("entity", "name").join(vec, "name")
        dealt = tiles.dealt(settled(tiles.narrow(left)), settled(tiles.narrow(right)), ["group"], "name", TOP_SIZES)
        product = tiles.taken(*dealt, tiles.nearest(n), "group long, item long, value double", distance, tiles.among(n), tiles.HELD)  # of whole tiles
    else:
        energy, product = _energy(method, distance, weights), None
        for side, other, own, others in (("head", "tail", h, t), ("tail", "head", t, h)):
            searches = asked.filter(F.col("kind") == side).withColumnRenamed("name", side)
            left, right = searches.join(own, side).join(r, "relation"), named.withColumnRenamed("entity", other).join(others, other)
            one = tiles.product(left, right, ["group"], "item").select("group", "item", energy.alias("value"))
            product = one if product is None else product.union(one)
    places = settled(best(product, n, method.lower() != "transe").select("group", "item", "value"))  # of a tile there are n at most
    groups = ids
    for side in ("head", "tail"):
        groups = groups.join(asked.filter(F.col("kind") == side).select(F.col("name").alias(side), "relation", F.col("group").alias(f"_{side}")), [side, "relation"], "left")
    groups = settled(groups)
    found = None
    for side, other in (("head", "tail"), ("tail", "head")):
        mine = groups.withColumnRenamed(f"_{side}", "group").join(places, "group").join(named.withColumnRenamed("entity", "_found"), "item")
        mine = mine.select("test", *[F.col("_found").alias(c) if c == other else F.col(c) for c in ("head", "tail")], "value")
        found = mine if found is None else found.union(mine)
    # the triple itself may come from both of its searches; equal rows have the same place
    place = F.dense_rank().over(Window.partitionBy("test").orderBy("value", "head", "tail"))
    return found.withColumn("place", place).filter(F.col("place") <= n).select("head", "tail").distinct()


def normalised(values: DataFrame, column: str = "value") -> DataFrame:
    """1 - (v - min) / (max - min); null where all values are equal."""
    ends = values.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    out = values.crossJoin(ends)  # one row
    return out.withColumn(column, 1 - F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def below_top_range(values: DataFrame, cutoff: float, column: str = "energy") -> DataFrame:
    """Rows below max - (max - min) * cutoff."""
    ends = values.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return values.crossJoin(ends).filter(F.col(column) < F.col("_hi") - (F.col("_hi") - F.col("_lo")) * cutoff).drop("_lo", "_hi")


def replaced_confidence(triples: DataFrame, scored: DataFrame) -> DataFrame:
    """Confidences replaced by normalised energies where there is one."""
    new = normalised(scored, "energy").select(*KEY, F.col("energy").alias("_new"))
    return triples.join(new, KEY, "left").withColumn("confidence", F.coalesce("_new", "confidence")).drop("_new")


def targets(scored: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    """(targets, log) of scored triples: those of at most the energy ``most`` with a running id from 0, and counts of all rounded energies.

    ``targets`` has id, the triple and its energy; files of ids with triples and of ids with energies are two selections of it.
    """
    kept = ranked(scored.filter(F.col("energy") <= most).select(*KEY, "energy"), [F.col(c) for c in KEY], rank="_rank")
    log = scored.groupBy(F.round("energy", 2).alias("energy")).agg(F.count(F.lit(1)).alias("n"))
    return kept.select((F.col("_rank") - 1).alias("id"), *KEY, "energy"), log


def missing_from(triples: DataFrame, cache: DataFrame, buckets: int) -> DataFrame:
    """The distinct triples whose energy is not in ``cache``, which has so many buckets by the triple and is not shuffled."""
    return _wanted(triples, buckets).join(cache.select(*KEY).hint("merge"), KEY, "left_anti")


def with_cache(triples: DataFrame, cache: DataFrame, buckets: int) -> DataFrame:
    """The energies of the distinct triples that ``cache`` (triple, energy) has; it must have a triple once."""
    return _wanted(triples, buckets).join(cache.select(*KEY, "energy").hint("merge"), KEY)


def _wanted(triples: DataFrame, buckets: int) -> DataFrame:
    """Distinct triples where the cache has them: one shuffle for both ends."""
    return triples.select(*KEY).repartition(buckets, *KEY).distinct()
