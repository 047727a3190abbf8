"""Samples, splits, sparser and noisier datasets. Chance is the order of a hash, so every engine agrees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trivane.functions import columns as C
from trivane.operators.ranking import first_rows, ranked, ranked_within, settled

KEY = ["head", "tail", "relation"]


def shuffled(df: DataFrame, seed: int, columns: list[str], rank: str = "rank") -> DataFrame:
    """Rows numbered in hash order of ``columns``."""
    return ranked(df, [C.hash_order(seed, *map(F.col, columns)), *map(F.col, columns)], rank=rank)


def split(triples: DataFrame, seed: int = 4, train: float = 0.9, keep_remainder: bool = False) -> DataFrame:
    """Add ``split``: a share of train, and halves of the rest for test and valid, all rounded down.

    An odd remainder is dropped, or with ``keep_remainder`` goes to valid.
    """
    rows = shuffled(triples, seed, KEY)  # also counted, so that ``triples`` are computed once
    n = rows.count()
    n_train = int(n * train)
    half = (n - n_train) // 2
    place = F.col("rank")
    name = F.when(place <= n_train, "train").when(place <= n_train + half, "test")
    name = name.when((place <= n_train + 2 * half) | F.lit(keep_remainder), "valid")
    return rows.withColumn("split", name).filter("split is not null").drop("rank")


def sample_triples(triples: DataFrame, size: int, seed: int = 4) -> DataFrame:
    return first_rows(triples, [C.hash_order(seed, *map(F.col, KEY)), *map(F.col, KEY)], size)


def sample_entities(triples: DataFrame, size: int, seed: int = 4) -> DataFrame:
    """Triples whose both ends are among ``size`` sampled entities."""
    entities = settled(triples.select(F.explode(F.array("head", "tail")).alias("entity")).distinct())  # read in several passes
    kept = settled(first_rows(entities, [C.hash_order(seed, F.col("entity")), F.col("entity")], size))
    out = triples
    for side in ("head", "tail"):
        out = out.join(kept.select(F.col("entity").alias(side)), side, "left_semi")
    return out.select(*triples.columns)


#: Ticks of a clock in its mean time between two arrivals.
TICKS = 1 << 24


def sparser(triples: DataFrame, n: int, seed: int = 4, mode: str = "draw") -> DataFrame:
    """Add ``removed`` for n triples; the last triple of a relation, in hash order, is never removed.

    ``draw`` draws a relation with equal chance, of those that have a triple to spare, and takes its next triple, n times.
    That is a race of clocks: the triples of each relation arrive one by one after exponential times, and the first n go,
    as the next arrival is as likely any relation's as another's, whatever came before. Times are made by hash
    and counted in whole ticks. ``rounds`` takes one triple of each relation in turn.
    """
    order = [C.hash_order(seed, *map(F.col, KEY)), *map(F.col, KEY)]
    chance = (C.hash_int(f"{seed}:clock", *map(F.col, KEY)) + 1) / F.lit(float(1 << 32))
    wait = F.floor(-F.log(chance) * TICKS) if mode == "draw" else F.lit(1)
    placed = settled(ranked_within(triples, ["relation"], order, {"_time": wait.cast("long")}, rank="_place"))
    sizes = settled(placed.groupBy("relation").agg(F.count(F.lit(1)).alias("_n")))
    total, relations = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    if n > total - relations:
        raise ValueError("more triples are to go than relations can spare")
    spare = placed.join(sizes, "relation").withColumn("_spare", F.col("_place") < F.col("_n"))
    turn = [F.col("_time"), C.hash_order(seed, F.col("relation")), F.col("relation"), F.col("_place")]
    last = first_rows(spare.filter("_spare"), turn, n).agg(F.max(F.struct(*[c.alias(f"t{i}") for i, c in enumerate(turn)])).alias("_last"))
    gone = F.col("_spare") & (F.struct(*[c.alias(f"t{i}") for i, c in enumerate(turn)]) <= F.col("_last"))
    return spare.crossJoin(F.broadcast(last)).withColumn("removed", F.coalesce(gone, F.lit(False))).select(*triples.columns, "removed")  # one row


def removal_relations(train: DataFrame, n: int, seed: int = 4) -> DataFrame:
    """Relations in hash order until their triples are at least n."""
    counts = train.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    run = ranked(counts.withColumn("own", F.col("n")), [C.hash_order(seed, F.col("relation")), F.col("relation")], {"upto": F.col("n")})
    chosen = run.filter(F.col("upto") - F.col("own") < n)
    if train.count() < n:
        raise ValueError("there are fewer triples than are to go")
    return chosen.select("relation")


def without_relations(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """Add ``removed`` for triples of the relations."""
    gone = relations.select("relation", F.lit(True).alias("_gone"))
    return triples.join(gone, "relation", "left").withColumn("removed", F.coalesce("_gone", F.lit(False))).select(*triples.columns, "removed")


def collapse_map(triples: DataFrame, n: int, seed: int = 4) -> DataFrame:
    """n pairs (source, target) of relations: in hash order each odd one goes into the next."""
    relations = triples.select("relation").distinct()
    rows = ranked(relations, [C.hash_order(seed, F.col("relation")), F.col("relation")]).filter(F.col("rank") <= 2 * n)
    source = rows.filter("rank % 2 = 1").select((F.col("rank") + 1).alias("rank"), F.col("relation").alias("source"))
    return source.join(rows.withColumnRenamed("relation", "target"), "rank").select("source", "target")


def replaced(chosen: DataFrame, triples: DataFrame, seed: int = 4, attempts: int = 16) -> DataFrame:
    """(head, tail, relation, new_head, new_tail, new_relation) of distinct chosen triples.

    One part is replaced by an entity or relation by chance; the first of the attempts that is none of ``triples`` counts.
    If all attempts are, as happens among dense triples, the new parts are null.
    """
    entities = ranked(triples.select(F.explode(F.array("head", "tail")).alias("value")).distinct(), [F.col("value")])
    relations = ranked(triples.select(F.col("relation").alias("value")).distinct(), [F.col("value")])
    n_entities, n_relations = entities.count(), relations.count()
    tries = chosen.select(*KEY).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    part = F.pmod(C.hash_int(f"{seed}:part", *map(F.col, KEY), F.col("attempt")), F.lit(3))
    value = C.hash_int(f"{seed}:value", *map(F.col, KEY), F.col("attempt"))
    tries = tries.withColumn("part", part).withColumn("at", F.when(F.col("part") == 2, value % n_relations).otherwise(value % n_entities) + 1)
    pool = entities.withColumn("kind", F.lit(0)).union(relations.withColumn("kind", F.lit(1))).select(F.col("value").alias("new"), F.col("rank").alias("at"), "kind")
    drawn = tries.withColumn("kind", (F.col("part") == 2).cast("int")).join(pool, ["at", "kind"])
    new = [F.when(F.col("part") == i, F.col("new")).otherwise(F.col(c)).alias(f"new_{c}") for i, c in enumerate(KEY)]
    known = triples.select(*[F.col(c).alias(f"new_{c}") for c in KEY]).distinct()
    fresh = drawn.select(*KEY, "attempt", *new).join(known, [f"new_{c}" for c in KEY], "left_anti")
    first = fresh.groupBy(*KEY).agg(F.min_by(F.struct(*[f"new_{c}" for c in KEY]), "attempt").alias("_new"))
    return chosen.select(*KEY).join(first, KEY, "left").select(*KEY, "_new.*")


def corrupted(triples: DataFrame, share: float, seed: int = 4, attempts: int = 16) -> DataFrame:
    """Add ``corrupted``, with the chosen train rows changed: the first share in hash order, rounded down (see ``replaced``).

    A chosen row whose attempts all fail stays as it is.
    """
    train = triples.filter("split = 'train'")
    n = int(train.count() * share)
    placed = shuffled(train, seed, KEY, "_place").withColumn("corrupted", F.col("_place") <= n)
    new = replaced(placed.filter("corrupted"), triples, seed, attempts)
    changed = placed.join(new, KEY, "left").select(*[F.coalesce(f"new_{c}", c).alias(c) for c in KEY], "split", "corrupted")
    return changed.unionByName(triples.filter("split != 'train'").select(*KEY, "split").withColumn("corrupted", F.lit(False)))


def grid(triples: DataFrame, removed: int, step: int, levels: int, shares: list[float], seed: int = 4) -> DataFrame:
    """Cells of the sparsity and noise grid: (level, share, triple, corrupt).

    ``removed`` triples go; level i has (i + 1) * step of them back, and in cell (i, share) the first share of each
    block of ``step`` is to be corrupted. All cells come from one numbering, nested along both axes.
    """
    placed = shuffled(triples, seed, KEY, "_out").filter(F.col("_out") <= removed)
    placed = placed.withColumn("block", F.floor((F.col("_out") - 1) / step).cast("int")).filter(F.col("block") < levels)
    order = Window.partitionBy("block").orderBy(C.hash_order(f"{seed}:corrupt", *map(F.col, KEY)), *KEY)
    placed = placed.withColumn("_in_block", F.row_number().over(order))
    levels_, shares_ = F.explode(F.sequence(F.col("block"), F.lit(levels - 1))), F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.lit(int(s * step)).alias("most")) for s in shares]))
    cells = placed.withColumn("level", levels_).withColumn("s", shares_)
    return cells.select("level", F.col("s.share").alias("share"), *KEY, (F.col("_in_block") <= F.col("s.most")).alias("corrupt"))


def neighbours(triples: DataFrame) -> DataFrame:
    """Distinct (entity, other) of both directions, loops included."""
    return triples.select(F.col("head").alias("entity"), F.col("tail").alias("other")).union(triples.select("tail", "head")).distinct()


def adjacency(triples: DataFrame) -> DataFrame:
    """Distinct neighbours of each entity, in both directions."""
    return neighbours(triples).groupBy("entity").agg(F.array_sort(F.collect_list("other")).alias("neighbours"))


#: Of entities of the same counts so many of the least names are looked at in a batch of rounds; the neighbours of so many
#: entities, each of so many at most, come to the driver with them.
NAMES, NEAR, DEGREE = 8, 512, 256


@dataclass
class Grooming:
    """A batch of rounds of a greedy search on what the driver knows of a graph.

    Entities of the same (count, neighbours) have one score, so only the least name of each such bucket can be next.
    ``buckets`` has the least names of each in order and whether there are more; ``near`` the neighbours (other, triples) of
    some entities, with None for what is chosen already; ``state`` is (count, neighbours, active) of all that are named.
    """

    target: float
    held: int
    entities: int
    buckets: dict[tuple[int, int], tuple[list[str], bool]]
    near: dict[str, list[tuple[str, int]]]
    state: dict[str, tuple[int, int, bool]]

    def __post_init__(self) -> None:
        self.moved: set[str] = set()

    def far(self, count: int, neighbours: int) -> float:
        return abs(self.target - (self.held + count) / (self.entities + neighbours + 1))

    def best(self) -> str | None:
        """The next entity, by score and then name; None if the names that are known do not tell."""
        found: list[tuple[float, str, bool]] = [(self.far(*key), names[0], True) if names else (self.far(*key), "", False) for key, (names, more) in self.buckets.items() if names or more]
        found += [(self.far(*self.state[e][:2]), e, True) for e in self.moved]
        far, name, known = min(found, default=(0.0, "", False))
        return name if known else None

    def rounds(self, most: int) -> list[str]:
        """The entities of the next rounds, in order: up to one whose neighbours are not known, or the end of the search."""
        out: list[str] = []
        while self.held < most and (e := self.best()) is not None:
            out.append(e)
            self._leave(e)
            if e not in self.near:
                break
            self._take(e)
        return out

    def _leave(self, e: str) -> None:
        """``e`` is in no bucket any more."""
        self.moved.discard(e)
        names = self.buckets.get(self.state[e][:2], ([], False))[0]
        if e in names:
            names.remove(e)

    def _take(self, e: str) -> None:
        active = self.state[e][2]
        for other, triples in self.near[e]:
            if other == e:
                self.held += triples // 2  # a loop counts at both ends
            elif other in self.state:
                self._leave(other)
                count, neighbours, seen = self.state[other]
                self.held += triples
                self.entities += not seen
                self.state[other] = count - triples, neighbours - 1, True
                self.moved.add(other)
        self.entities += not active
        del self.state[e]


def _graph(state: DataFrame, ends: DataFrame, target: float, held: int, entities: int) -> Grooming:
    """What a batch of rounds needs: a row for each bucket and name, and the neighbours of the names that come next.

    A name whose bucket is in question may be a neighbour of a chosen one, so what is said of it holds until it moves.
    """
    bucket = Window.partitionBy("count", "neighbours")
    rows = state.withColumn("_place", F.row_number().over(bucket.orderBy("entity"))).filter(F.col("_place") <= NAMES)
    sizes = state.groupBy("count", "neighbours").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes, ["count", "neighbours"]).select("count", "neighbours", "n", "entity", "active").collect()
    out = Grooming(target, held, entities, {}, {}, {})
    for r in sorted(rows, key=lambda r: r["entity"]):
        out.buckets.setdefault((r["count"], r["neighbours"]), ([], r["n"] > NAMES))[0].append(r["entity"])
        out.state[r["entity"]] = r["count"], r["neighbours"], r["active"]
    next_ = sorted((r for r in rows if r["count"] <= DEGREE), key=lambda r: (out.far(r["count"], r["neighbours"]), r["entity"]))[:NEAR]
    names = state.sparkSession.createDataFrame([(r["entity"],) for r in next_], "entity string")
    near = ends.join(F.broadcast(names), "entity").groupBy("entity", "other").agg(F.count(F.lit(1)).alias("triples"))
    # those chosen already have no state and no part in what follows, so a hub's past does not come either
    near = near.join(state.select(F.col("entity").alias("other"), "count", "neighbours", "active"), "other").collect()
    out.near = {r["entity"]: [] for r in next_}
    for r in near:
        out.near[r["entity"]].append((r["other"], r["triples"]))
        out.state[r["other"]] = r["count"], r["neighbours"], r["active"]
    return out


def groomed(triples: DataFrame, target: float = 3.3478, most: int = 600_000, share: float = 0.0) -> DataFrame:
    """Triples in the rounds in which a search for a density takes them: (head, tail, relation, round).

    All entities are candidates from the start. A round takes the entity for which (triples + its count) / (entities + its
    neighbours + 1) is closest to ``target``, ties by name; all its triples and neighbours come with it, and the
    counts of the entities they touch fall. It ends with the round that reaches ``most`` triples, or without candidates.
    A loop counts twice. The rounds are made in batches: Spark counts what is left of the graph and brings its buckets of
    equal counts and the neighbours of the next candidates (``Grooming``), and the batch goes on as long as these tell
    which entity is next.

    ``share`` is the part of the candidates that a round takes at once, one at least: beyond 0, counts are those of the round's
    beginning, and the search ends in about log(entities) / share rounds.
    """
    triples = settled(triples.select(*KEY))
    spark, deals = triples.sparkSession, int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = settled(triples.select(F.col("head").alias("entity"), F.col("tail").alias("other")).union(triples.select("tail", "head")))
    left = settled(ends.select("entity").distinct())
    chosen = left.limit(0).select("entity", F.lit(0).alias("round"))
    held, entities, number, candidates = 0, 0, 0, left.count()
    while candidates and held < most:
        free = ends.join(chosen.select(F.col("entity").alias("other")), "other", "left_anti")
        counts = free.groupBy("entity").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("other").alias("neighbours"))
        state = left.join(counts, "entity", "left").fillna(0)
        if share > 0:
            far = F.abs(target - (held + F.col("count")) / (entities + F.col("neighbours") + 1))
            take = max(1, int(share * candidates))
            best = first_rows(state.withColumn("far", far), [F.col("far"), F.col("entity")], take).select("entity", F.lit(number + 1).alias("round"))
            number, candidates = number + 1, candidates - take
        else:
            touched = ends.join(chosen, "entity").select(F.col("other").alias("entity"), F.lit(True).alias("active")).distinct()
            state = settled(state.join(touched, "entity", "left").withColumn("active", F.coalesce("active", F.lit(False))))
            names = _graph(state, ends, target, held, entities).rounds(most)
            best = spark.createDataFrame([(e, number + i) for i, e in enumerate(names, 1)], "entity string, round int")
            number, candidates = number + len(names), candidates - len(names)
        chosen = settled(chosen.union(best).coalesce(deals))
        left = settled(left.join(chosen, "entity", "left_anti"))
        held = _touched(triples, chosen).count()
        met = ends.join(chosen, "entity").select(F.col("other").alias("entity")).union(chosen.select("entity"))
        entities = met.distinct().count()
    return _touched(triples, chosen)


def _touched(triples: DataFrame, chosen: DataFrame) -> DataFrame:
    """The triples with an end among (entity, round), and the first round of both."""
    out = triples
    for side in ("head", "tail"):
        out = out.join(chosen.select(F.col("entity").alias(side), F.col("round").alias(f"_{side}")), side, "left")
    return out.withColumn("round", F.least("_head", "_tail")).filter("round is not null").select(*KEY, "round")


def dataset_name(kind: str, base: str, *values: float, suffix: str = "") -> str:
    """Names of derived datasets; shares are written as truncated percents.

    ``selected`` takes the least and greatest probability, entity centile and relation centile and the most triples,
    ``groomed`` the probabilities, the density and the most triples; these two end in ``suffix``, if there is one, after a
    line, as they may be made again and again.
    """
    end = f"_{suffix}" if suffix else ""
    percent = lambda x: "%03d" % int(x * 100)
    if kind == "selected":
        a, b, *tiles, most = values
        return base + f"_{percent(a)}_{percent(b)}_[%03d,%03d;%03d,%03d;{most}]" % tuple(tiles) + end
    if kind == "groomed":
        a, b, target, most = values
        return base + f"_{percent(a)}_{percent(b)}_[{target};{most}]" + end
    forms = {  # fixed values
        "corrupt": "_CORRUPT[%03d]", "triples_removed": "_TR[%06d]", "relations_removed": "_RR[%06d]", "collapsed": "_CR[%03d]", "sample": "_SAMPLE[%06d]", "entity_sample": "_ENTITY_SAMPLE[%06d]"
    }
    if kind == "tradeoff":
        return base + "_TRADEOFF[%06d,%03d]" % (values[0], int(values[1] * 100))
    value = int(values[0] * 100) if kind == "corrupt" else values[0]
    return base + forms[kind] % value


def nell_grid() -> list[dict[str, float]]:
    """Ten confidence bins, and five bins by four centile ranges; neighbouring bins share their border."""
    tenth = [{"min_probability": i / 10, "max_probability": (i + 1) / 10} for i in range(10)]
    fifths = [{"min_probability": i / 5, "max_probability": (i + 1) / 5, "min_centile": 25 * c, "max_centile": 25 * (c + 1)} for i in range(5) for c in range(4)]
    return tenth + fifths
