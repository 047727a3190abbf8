"""Hand-checked values of the graph operators, and the registered queries against SQL on a small table."""

import hashlib
import math
import random
import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trivane.functions import columns as C
from trivane.operators import evaluation, ids, ontology, perturb, pruned, scoring, stats, tiles
from trivane.operators.best import SCHEMA, partial_best
from trivane.operators.ranking import cut_off, first_rows, ntile, ranked, ranked_within
from trivane.plans import compiled, datasets, fixture
from trivane.plans import queries as Q
from trivane.plans.dataset_queries import scored_with_cache
from trivane.sources import catalogs, folder, readers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def triples(spark, rows):
    return spark.createDataFrame(rows, "head string, tail string, relation string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_energies(spark):
    h, r, t = vec(1, 2), vec(0.5, 0.5), vec(1, 1)
    assert one(spark, C.transe_energy(h, r, t)) == 2.0
    assert one(spark, C.transe_energy(h, r, t, "L2")) == 2.5
    assert one(spark, C.transh_energy(h, vec(0, 0), t, vec(1, 0))) == 1.0
    unit = F.array(vec(1, 0), vec(0, 1))
    assert one(spark, C.stranse_energy(h, r, t, unit, unit)) == 2.0
    assert one(spark, C.stranse_energy(h, r, t, unit, unit, "L2")) == pytest.approx(2.5**0.5)
    assert C.max_energy("TransE", "L2") == 1.0
    with pytest.raises(ValueError):
        C.max_energy("stranse", "L1")
    assert C.method_of_path("/x/TransE_FB_[size:100,distance:1]/") == ("transe", "L2")


def test_scalars(spark):
    assert one(spark, C.cantor(F.lit(3), F.lit(4))) == 32
    assert one(spark, C.cantor(F.lit(300000001), F.lit(300000002))) == 180000002400000008
    assert one(spark, C.without(F.lit("abcabc"), "b", "x", "ca")) == "abc"
    assert one(spark, C.stripped(F.lit("\t a b \r\n"))) == "a b"
    assert one(spark, C.lenient_int(F.lit("12abc"))) == 12 and one(spark, C.lenient_int(F.lit("x"))) == 0
    assert one(spark, C.url_decoded(F.lit("a+b%20c"))) == "a+b c"
    assert one(spark, C.f1(F.lit(0.0), F.lit(0.0))) == 0.0
    rows = spark.createDataFrame([("a", 2.0), ("b", 4.0), ("c", 6.0)], "id string, value double")
    assert {r["id"]: r["value"] for r in scoring.normalised(rows).collect()} == {"a": 1.0, "b": 0.5, "c": 0.0}
    assert perturb.dataset_name("corrupt", "FB", 0.29) == "FB_CORRUPT[028]"
    assert perturb.dataset_name("selected", "N", 0.95, 1.0, 95, 100, 10, 40, 600000) == "N_095_100_[095,100;010,040;600000]"
    assert perturb.dataset_name("groomed", "N", 0.29, 1.0, 3.3478, 600000) == "N_028_100_[3.3478;600000]"
    assert perturb.dataset_name("groomed", "N", 0.95, 1.0, 3.3478, 600000, suffix="201601") == "N_095_100_[3.3478;600000]_201601"
    assert len(perturb.nell_grid()) == 30
    with pytest.raises(ValueError), C.added_method("transe", C.transe_energy):
        pass
    assert len(catalogs.REPLACED_TRIPLES) == 8 and catalogs.STRICT_CATEGORIES[-1].startswith("NELL.08m.165.esv")


def test_ranks(spark):
    rows = spark.range(103).select(((F.col("id") * 37) % 103).alias("v"))
    got = {r["v"]: (r["rank"], r["s"]) for r in ranked(rows, [F.col("v")], {"s": F.col("v") + 0}).withColumnRenamed("v", "v").collect()}
    assert got == {v: (v + 1, v * (v + 1) // 2) for v in range(103)}
    tiles = [r["t"] for r in ntile(rows, [F.col("v")], 10, "t").orderBy("v").collect()]
    assert tiles == [r[0] for r in duckdb.sql("select ntile(10) over (order by i) from range(103) t(i) order by i").fetchall()]


def test_ranks_within(spark):
    rows = spark.range(90).select((F.col("id") * 37 % 90).alias("v"), F.when(F.col("id") < 80, "hot").when(F.col("id") < 88, "b").alias("k"))
    got = sorted((r["k"] or "", r["v"], r["rank"], r["s"]) for r in ranked_within(rows, ["k"], [F.col("v")], {"s": F.col("v")}).collect())
    seen, expected = {}, []
    for k, v in sorted((r["k"] or "", r["v"]) for r in rows.collect()):
        n, s = seen.get(k, (0, 0))
        seen[k] = (n + 1, s + v)
        expected.append((k, v, *seen[k]))
    assert got == expected


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """A folder of parts is one file."""
    lines = [f"{i * 7}" + "x" * (i % 50) for i in range(3000)]
    for name in ("part-0", "part-1"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = readers.numbered(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert sorted((r["line"], r["value"]) for r in got) == sorted(enumerate(2 * lines))


def groomed(rows, target, most, share):
    """The rule as it is told, entity by entity: the counts of what a chosen entity touches fall."""
    entries, near = {}, {}
    for k, (a, b, _) in enumerate(rows):
        for x, y in ((a, b), (b, a)):
            entries.setdefault(x, []).append(k)
            near.setdefault(x, set()).add(y)
    count, around = {e: len(ks) for e, ks in entries.items()}, {e: len(n) for e, n in near.items()}
    left, taken, active, number = set(entries), {}, set(), 0
    while left and len(taken) < most:
        number += 1
        far = lambda e, n=len(taken), m=len(active): (abs(target - (n + count[e]) / (m + around[e] + 1)), e)
        best = sorted(left, key=far)[: max(1, int(share * len(left)))]
        for e in best:
            left.discard(e)
            for k in entries[e]:
                for x in rows[k][:2]:
                    count[x] -= 1
            for x in near[e]:
                around[x] -= 1
            for k in entries[e]:
                taken.setdefault(k, number)
            active |= near[e] | {e}
    return sorted((*rows[k], n) for k, n in taken.items())


@pytest.mark.parametrize(("most", "share", "names", "near", "degree"), [(12, 0.0, 1, 4, 2), (40, 0.0, 8, 512, 256), (1000, 0.0, 2, 8, 3), (40, 0.2, 8, 512, 256), (1000, 0.5, 8, 512, 256)])
def test_grooming(spark, monkeypatch, most, share, names, near, degree):
    """Batches of any size make the same rounds."""
    for name, value in (("NAMES", names), ("NEAR", near), ("DEGREE", degree)):
        monkeypatch.setattr(perturb, name, value)
    rows = [(f"e{i * i % 23}", f"e{i * 5 % 29 + 30}", "r") for i in range(60)] + [("x", "y", "q"), ("y", "z", "q"), ("l", "l", "r"), ("l", "l", "q"), ("e1", "e1", "r"), ("e1", "e30", "s")]
    rows = list(dict.fromkeys(rows))
    if most == 1000 and share == 0:
        rows = rows[:24] + rows[-6:]
    got = perturb.groomed(triples(spark, rows), 2.0, most, share).collect()
    assert sorted(tuple(r) for r in got) == groomed(rows, 2.0, most, share)


def test_grooming_of_nothing(spark):
    assert perturb.groomed(triples(spark, []), 2.0).count() == 0


def test_sparser_draw(spark):
    """The arrivals of each relation's clock, and of each relation the first triples in hash order; the last never goes."""
    rows = [(f"h{i}", f"t{i}", f"r{(i * i) % 5}") for i in range(80)]
    key = lambda x, seed="4": hashlib.md5(":".join([seed, *x]).encode()).hexdigest()
    arrivals = []
    for r in {x[2] for x in rows}:
        own, time = sorted((x for x in rows if x[2] == r), key=key), 0
        for place, x in enumerate(own[:-1], 1):
            time += math.floor(-math.log((int(key(x, "4:clock")[:8], 16) + 1) / 2**32) * perturb.TICKS)
            arrivals.append((time, key((r,)), place, x))
    gone = {x for *_, x in sorted(arrivals)[:50]}
    assert {tuple(r)[:3] for r in perturb.sparser(triples(spark, rows), 50).filter("removed").collect()} == gone


def test_sparser_draw_is_a_fair_draw(spark):
    """A relation with many triples loses as many as one with few, until that one has one left."""
    rows = triples(spark, [(f"h{i}", f"t{i}", f"r{min(i % 40, 3)}") for i in range(4000)])
    gone = {r["relation"]: r["count"] for r in perturb.sparser(rows, 200).filter("removed").groupBy("relation").count().collect()}
    assert sum(gone.values()) == 200 and all(30 <= gone[f"r{i}"] <= 70 for i in range(4))


@pytest.mark.parametrize("most", [1, 40, 700, 5000])
def test_cut_off(spark, most):
    """What is sorted for the first rows is at most twice as many, whatever kind the key is, unless keys are equal."""
    rows = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("m"), (F.col("id") * 37 % 3000 - 1500).alias("n"), F.pow(F.col("id") * 13 % 3000, 3.0).alias("x"), (F.col("id") % 2).alias("tie"))
    rows = rows.union(spark.createDataFrame([(3000, None, None, float("nan"), None), (3001, "", -(1 << 63), float("-inf"), 0), (3002, "é", (1 << 63) - 1, float("inf"), 1)], "id long, m string, n long, x double, tie long"))
    for order in (["m", "id"], ["n", "id"], ["x", "id"], ["tie", "n"]):
        columns = [F.col(c) for c in order]
        condition, kept = cut_off(rows, columns, most)
        first = [r["id"] for r in rows.orderBy(*columns).limit(most).collect()]
        held = [r["id"] for r in rows.filter(condition).collect()]
        assert set(first) <= set(held) and len(held) == kept <= max(2 * most, min(3003, 2 * most))
        assert {r["id"] for r in first_rows(rows, columns, most).collect()} == set(first)
    assert first_rows(rows, [F.col("id")], 0).count() == 0


def test_first_rows_sort_few(spark):
    """The plan of a small sample sorts only what is before the cut."""
    rows = triples(spark, [(f"h{i}", f"t{i % 70}", "r") for i in range(4000)])
    condition, kept = cut_off(rows, [C.hash_order(4, *map(F.col, ("head", "tail", "relation")))], 50)
    assert kept <= 100 and rows.filter(condition).count() == kept


def _space(spark, distance):
    """Clustered vectors, test triples, and the corruptions scored one by one."""
    rng = random.Random(6)
    middles = [[rng.uniform(-50, 50) for _ in range(6)] for _ in range(8)]
    entities = {f"e{i}": [x + rng.gauss(0, 1) for x in middles[i % 8]] for i in range(160)}
    relations = {f"r{j}": [x - y for x, y in zip(middles[j + 1], middles[j])] for j in range(3)}
    test = [(f"e{8 * k + j}", f"e{8 * (k + 3) + j + 1}", f"r{j}") for k in range(6) for j in range(3)] + [("e0", "gone", "r0")]
    frame = lambda held: spark.createDataFrame(list(held.items()), "key string, vec array<double>")
    universe = spark.createDataFrame([(e,) for e in [*entities, "gone"]], "entity string")
    return triples(spark, test), universe, frame(entities), frame(relations)


@pytest.mark.parametrize("distance", ["L1", "L2"])
def test_pruned_corruptions(spark, distance):
    """The metric index gives what the product gives, and scores a small part of it."""
    test, universe, vectors, relations = _space(spark, distance)
    product = scoring.scored_corruptions(test, universe, vectors, relations, "transe", distance).cache()
    want = scoring.skyline(scoring.score(test, vectors, relations, "transe", distance), product)
    rows = lambda d: sorted((r["head"], r["tail"], r["relation"], r["energy"]) for r in d.select("head", "tail", "relation", "energy").collect())
    small = {"pivots": 8, "rings": 4}
    assert rows(pruned.skyline(test, universe, vectors, relations, distance, **small)) == rows(want) and want.count() > 20
    most = 30.0
    assert rows(pruned.below(test, universe, vectors, relations, most, distance, **small)) == rows(product.filter(F.col("energy") <= most))
    limits = {side: test.select(side, "relation").distinct().withColumn("energy", F.lit(most)) for side in ("head", "tail")}
    scored = sum(d.count() for d in pruned.candidates(limits, universe, vectors, relations, distance, **small).values())
    assert scored < product.count() / 3


def _product_rows(test, universe, vectors, relations, distance):
    """All corruptions and their energies, one by one in Python."""
    vec, rel = ({r["key"]: r["vec"] for r in d.collect()} for d in (vectors, relations))
    names = [r["entity"] for r in universe.collect()]
    found = {x for h, t, r in map(tuple, test.collect()) for e in names for x in ((e, t, r), (h, e, r))}
    size = abs if distance == "L1" else lambda x: x * x
    far = lambda h, t, r: float(np.add.accumulate([size(c - (a + b)) for a, b, c in zip(vec[h], rel[r], vec[t])])[-1])  # noqa: E731  Python's sum rounds otherwise
    return {(h, t, r): far(h, t, r) for h, t, r in found if h in vec and t in vec and r in rel}


@pytest.mark.parametrize("distance", ["L1", "L2"])
def test_tiles(spark, monkeypatch, distance):
    """Small tiles give every corruption once, in many groups; no product is one task's."""
    monkeypatch.setattr(tiles.dealt, "__defaults__", ((7, 50),))
    monkeypatch.setattr(tiles, "SEARCHES", 7)
    test, universe, vectors, relations = _space(spark, distance)
    test = test.union(triples(spark, [("e1", "e1", "r0"), ("e9", "e0", "r0")]))
    want = _product_rows(test, universe, vectors, relations, distance)
    got = scoring.scored_corruptions(test, universe, vectors, relations, "transe", distance)
    assert sorted(map(tuple, got.collect())) == sorted((*k, v) for k, v in want.items())
    made = scoring.corruptions(test, universe)
    for rows in (got, made):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and rows.rdd.getNumPartitions() > 12
    assert made.count() == made.distinct().count() and made.intersect(got.drop("energy")).count() == len(want)
    counts = {r["energy"]: r["n"] for r in scoring.corruption_counts(test, universe, vectors, relations, distance).collect()}
    assert counts == {r["energy"]: r["n"] for r in scoring.targets(got, 1.0)[1].collect()}
    most = sorted(want.values())[len(want) // 3]
    below = pruned.below(test, universe, vectors, relations, most, distance, pivots=8, rings=4)
    assert sorted(map(tuple, below.collect())) == sorted((*k, v) for k, v in want.items() if v <= most)


def test_tiles_odd_vectors(spark):
    """Vectors of other lengths or with nulls have no energy, as in Spark's own expression."""
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0, 3.0]), ("c", [None, 2.0]), ("d", [float("nan"), 1.0]), ("e", None), ("f", [4.0, 0.5])], "key string, vec array<double>")
    relations = spark.createDataFrame([("r", [0.5, 0.25])], "key string, vec array<double>")
    universe, test = vectors.select(F.col("key").alias("entity")), triples(spark, [("a", "f", "r"), ("b", "a", "r"), ("d", "c", "r")])
    made = scoring.corruptions(test, universe)
    rows = lambda d: sorted(map(repr, map(tuple, d.collect())))
    want = scoring.score(made, vectors, relations)
    assert rows(scoring.scored_corruptions(test, universe, vectors, relations)) == rows(want)
    assert rows(scoring.scored_corruptions(test, universe, vectors, relations, below=5.0)) == rows(want.filter("energy <= 5"))


@pytest.mark.parametrize("distance", ["L1", "L2"])
def test_screens(monkeypatch, distance):
    """Single precision rules pairs out before their energies are computed, and none that is wanted; ties, odd and huge vectors included."""
    rng = np.random.default_rng(3)
    looked, one_by_one = [], tiles.energies_of
    monkeypatch.setattr(tiles, "energies_of", lambda *x: looked.append(x[3].shape[1]) or one_by_one(*x))
    wide = lambda x: pa.array([None if v is None else list(v) for v in x], pa.list_(pa.float64()))

    def table(others, own, r, most):
        n, m = len(others), len(own)
        entities = {"kind": [tiles.ENTITY] * n, "name": [f"e{i}" for i in range(n)], "item": range(n), "vec": wide(others), "r": wide([None] * n), "group": [None] * n, "most": [None] * n, "relation": [None] * n, "known": [None] * n}
        asked = {"kind": ["head", "tail"] * (m // 2), "name": [f"q{i}" for i in range(m)], "item": [None] * m, "vec": wide(own), "r": wide(r), "group": range(m), "most": most, "relation": ["x"] * m, "known": [False] * m}
        kinds = {"item": pa.int64(), "group": pa.int64(), "most": pa.float64(), "relation": pa.string(), "known": pa.bool_()}
        cells = {c: pa.chunked_array([x if isinstance(x, pa.Array) else pa.array(x, kinds.get(c)) for x in (entities[c], asked[c])]) for c in entities}
        return pa.table(cells)

    def rows(held, take, screen):
        out = pa.Table.from_batches(list(tiles.computed(held, take, distance, screen))).to_pylist()
        if take is tiles.corruptions:
            return sorted(map(repr, out))
        return [sorted((x["value"], x["item"]) for x in out if x["group"] == g and x["value"] == x["value"])[:20] for g in range(12)]

    others, own, r = (rng.normal(size=(n, 16)) * 3 for n in (3000, 12, 12))
    others[100:400] = others[0]  # ties
    want = np.sort(tiles.energies(True, own.T, r.T, others.T, distance), axis=1)
    plain = table(others, own, r, list(want[:, 10]))
    for take, screen in ((tiles.nearest(20), tiles.among(20)), (tiles.corruptions, tiles.within)):
        looked.clear()
        assert rows(plain, take, screen) == rows(plain, take, None)
        assert 0 < sum(looked) < 3000 * 12 / 10
    odd = [list(x) for x in others]
    odd[5], odd[6], odd[7] = None, [1.0], [None] * 16
    for held in (table(odd, own, r, [40.0] * 12), table(others * 1e30, own * 1e30, r, [1e31] * 12), table(np.vstack([others, [[np.nan] * 16]]), own, r, [30.0] * 12), table(others, own, r, [None] * 12)):
        for take, screen in ((tiles.nearest(20), tiles.among(20)), (tiles.corruptions, tiles.within)):
            assert rows(held, take, screen) == rows(held, take, None)


def test_tiles_grow_with_the_tables(spark):
    """Rows that are shuffled grow as the tables, not as their pairs: before, with sixteen times as many pairs they were sixteen times as many."""
    frame = lambda n: spark.range(n).withColumn("name", F.col("id").cast("string"))

    def shuffled(n):
        left, right, parts = tiles.dealt(frame(n), frame(2 * n), ["name"], "name", (64, 128))
        met = left.groupBy("place", "deal").count().join(right.groupBy("place", "deal").agg(F.count("name").alias("n")), ["place", "deal"])
        assert met.agg(F.sum(F.col("count") * F.col("n"))).first()[0] == 2 * n * n  # every pair once
        assert 48 <= left.select("part").distinct().count() <= parts <= 100
        return left.count() + right.count()

    small, large = shuffled(2000), shuffled(8000)
    assert large <= 4.5 * small


@pytest.mark.parametrize("distance", ["L1", "L2"])
def test_grown_tiles(spark, monkeypatch, distance):
    """Searches pass by held entities in batches, and vectors of single precision are sent as such: the energies stay the same."""
    monkeypatch.setattr(tiles.dealt, "__defaults__", ((3, 9),))
    monkeypatch.setattr(tiles.dealt, "__kwdefaults__", {"groups": 4})
    test, universe, vectors, relations = _space(spark, distance)
    some = F.when(F.hash("key") % 2 == 0, F.transform("vec", lambda x: x.cast("float").cast("double"))).otherwise(F.col("vec"))
    vectors = vectors.withColumn("vec", some).union(spark.createDataFrame([("short", [1.0]), ("hole", [None, 1.0]), ("none", None)], "key string, vec array<double>"))
    universe = vectors.select(F.col("key").alias("entity"))
    want = _product_rows(test, universe.filter("entity like 'e%'"), vectors, relations, distance)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        got = scoring.scored_corruptions(test, universe, vectors, relations, "transe", distance).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lost = [x for x in got if {x["head"], x["tail"]} & {"short", "hole", "none"}]
    assert sorted(tuple(x) for x in got if x not in lost) == sorted((*k, v) for k, v in want.items())
    assert {x["energy"] for x in lost} == {None} and len(set(lost)) == len(lost) > 50


def test_searches_pass_by(monkeypatch):
    """A task holds its tile's entities only: its searches are answered batch by batch, and entities in blocks."""
    rng = np.random.default_rng(2)
    listed = lambda x: pa.array([None if v is None else list(v) for v in x], pa.list_(pa.float64()))

    def batch(kind, at):
        own = rng.normal(size=(len(at), 4)).tolist()
        mine = kind != tiles.ENTITY
        cells = {"kind": [kind] * len(at), "name": [f"{kind}{i}" for i in at], "vec": listed(own), "r": listed(own if mine else [None] * len(at)), "relation": pa.array(["x" if mine else None] * len(at), pa.string())}
        return pa.RecordBatch.from_pydict(cells | {"most": pa.array([None] * len(at), pa.float64()), "known": pa.array([False if mine else None] * len(at), pa.bool_())})

    rows = [batch(tiles.ENTITY, range(30)), batch(tiles.ENTITY, range(30, 50)), *(batch("tail", range(8 * i, 8 * i + 8)) for i in range(5))]
    read = []
    out = tiles.computed((read.append(i) or x for i, x in enumerate(rows)), tiles.corruptions, "L1", None, 7)
    next(out)
    assert read == [0, 1, 2]
    got = sorted(map(repr, pa.Table.from_batches([*tiles.computed(rows, tiles.corruptions, "L1", None, 7)]).to_pylist()))
    want = sorted(map(repr, pa.Table.from_batches([*tiles.computed(pa.Table.from_batches(rows), tiles.corruptions, "L1")]).to_pylist()))
    assert got == want and len(got) == 40 * 50


def test_places_of_entities(spark, monkeypatch):
    """Where the index leaves few pairs, an entity is shuffled for few deals of the searches: before, once for each ``SEARCHES`` of them."""
    test, universe, vectors, relations = _space(spark, "L1")
    monkeypatch.setattr(tiles, "SEARCHES", 4)
    sent, taken = [], tiles.taken
    monkeypatch.setattr(tiles, "taken", lambda left, right, *x: sent.append((left.count(), right.count())) or taken(left, right, *x))
    monkeypatch.setattr(pruned, "SHARE", 1.0)
    got = pruned.skyline(test, universe, vectors, relations, pivots=8, rings=8)
    want = scoring.skyline(scoring.score(test, vectors, relations), scoring.scored_corruptions(test, universe, vectors, relations))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20
    assert sent[0][1] <= 3 * vectors.count()


def test_index_that_leaves_all(spark, monkeypatch):
    """Where the rings rule little out, searches go to tiles, not to each ring: before, a search's row was made for each of these."""
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(f"e{i}", rng.normal(size=16).tolist()) for i in range(300)], "key string, vec array<double>")
    relations = spark.createDataFrame([("r", rng.normal(size=16).tolist())], "key string, vec array<double>")
    universe, test = vectors.select(F.col("key").alias("entity")), triples(spark, [(f"e{i}", f"e{i + 9}", "r") for i in range(20)])
    made, taken = [], tiles.taken
    monkeypatch.setattr(tiles, "taken", lambda left, *x: made.append(left.count()) or taken(left, *x))
    got = pruned.below(test, universe, vectors, relations, 19.0)
    want = scoring.scored_corruptions(test, universe, vectors, relations).filter("energy <= 19")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20
    assert made[0] == 40


def test_link_ranks_by_tiles(spark):
    """Ranks from counts are those from all scored rows: ties, valid triples, hubs and triples without a vector."""
    test, universe, vectors, relations = _space(spark, "L1")
    vectors = vectors.withColumn("vec", F.transform("vec", lambda x: F.round(x / 20)))  # many ties
    relations = relations.withColumn("vec", F.transform("vec", lambda x: F.round(x / 20)))
    test = test.union(triples(spark, [(f"e{i}", "e3", "r1") for i in range(40)]))
    valid = test.union(triples(spark, [(f"e{i}", f"e{i % 9}", f"r{i % 3}") for i in range(100)]))
    want = evaluation.link_ranks(test, scoring.scored_corruptions(test, universe, vectors, relations), valid)
    got = evaluation.link_ranks_by_tiles(test, universe, vectors, relations, valid)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_partial_best():
    """No more rows of a group leave a task than are wanted, and groups that are many leave in turns."""
    rng = np.random.default_rng(1)
    group, item, value = rng.integers(0, 50, 30_000), rng.integers(0, 10**6, 30_000), rng.integers(0, 9, 30_000).astype(float)
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 1000]) for c in (group, item, value)], schema=SCHEMA) for i in range(0, 30_000, 1000)]
    want = {g: sorted(zip(value[group == g], item[group == g]))[:7] for g in range(50)}
    for held in (10**6, 100):
        out = pa.Table.from_batches(list(partial_best(iter(batches), 7, held))).to_pydict()
        got = {g: sorted((v, i) for h, i, v in zip(*out.values()) if h == g) for g in range(50)}
        assert all(got[g][:7] == want[g] for g in range(50)) and (held == 100 or all(len(got[g]) == 7 for g in range(50)))


def test_top_pairs(spark):
    test, universe, vectors, relations = _space(spark, "L1")
    product = [tuple(r) for r in scoring.scored_corruptions(test, universe, vectors, relations).select("head", "tail", "relation", "energy").collect()]
    want = set()
    for h, t, r in {tuple(x) for x in test.collect()}:
        own = [(e, a, b) for a, b, c, e in product if c == r and (a == h or b == t)]
        want |= {(a, b) for _, a, b in sorted(own)[:5]}
    got = scoring.top_pairs(test, universe, vectors, relations, 5)
    assert {tuple(x) for x in got.collect()} == want


def test_top_pairs_of_large_tables(spark):
    """The bytes of a search's best and of the entities grow as the tables: before, an entity was shuffled once for each 512 searches."""
    frame = lambda n: spark.range(n).withColumn("name", F.col("id").cast("string"))
    left, right, _ = tiles.dealt(frame(20_000), frame(200_000), ["name"], "name", scoring.TOP_SIZES)
    deals, places = (left.agg(F.count_distinct(c)).first()[0] for c in ("deal", "place"))
    assert deals <= 16 and places <= 8 and right.count() == deals * 200_000


def test_nearest_of_equal_ones():
    """A tile gives k rows of a search, also where very many are equal: before, all of them."""
    asked, met = pa.table({"group": [7, 9]}), pa.table({"item": list(range(100, 0, -1))})
    values = np.array([[1.0] * 100, [*range(98), np.nan, np.nan]])
    got = tiles.nearest(3)(asked, met, values, np.ones((2, 100), bool), {}).to_pylist()
    assert [(x["group"], x["item"], x["value"]) for x in got] == [(7, 1, 1.0), (7, 2, 1.0), (7, 3, 1.0), (9, 100, 0.0), (9, 99, 1.0), (9, 98, 2.0)]


def test_top_pairs_share_the_work(spark, monkeypatch):
    """Searches of both sides are one job of many groups, also where a tile would hold all: before, two jobs of a task each."""
    test, universe, vectors, relations = _space(spark, "L1")
    test = test.union(triples(spark, [(f"e{i}", f"e{i + 1}", f"r{i % 3}") for i in range(150)]))
    groups, taken = [], tiles.taken
    monkeypatch.setattr(tiles, "taken", lambda left, *x: groups.append(left.select("place", "deal").distinct().count()) or taken(left, *x))
    scoring.top_pairs(test, universe, vectors, relations, 5)
    assert len(groups) == 1 and groups[0] >= 8


def test_energy_cache(spark, tmp_path):
    """Only what is missing is added; the cache is not shuffled; another session opens it with its own buckets."""
    path, asked = f"file://{tmp_path}/cache", []
    held = triples(spark, [(f"h{i}", f"t{i % 5}", "r") for i in range(60)])
    score = lambda missing: (asked.append(missing.count()), missing.withColumn("energy", F.length("head") + 0.5))[1]
    cache = readers.energy_cache(spark, path)
    for rows, n in ((held.limit(20), 20), (held, 40), (held, None)):
        out = scored_with_cache(rows, cache, score)
        assert out.count() == rows.count() and asked[-1] == (n or 40)
    assert len(asked) == 2 and spark.table(cache).count() == 60
    plan = scoring.with_cache(held, spark.table(cache), readers.cache_buckets(spark, cache))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1
    spark.sql(f"DROP TABLE {cache}")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert spark.table(readers.energy_cache(spark, path)).count() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_dataset_folder(spark, tmp_path):
    """What is written is read back; a second writing does nothing; what did not change is copied."""
    at = f"file://{tmp_path}"
    whole = datasets.dataset(perturb.split(triples(spark, [(f"h{i}", f"t{i % 9}", f"r{i % 4}") for i in range(40)])))
    assert folder.write_dataset(whole, f"{at}/FB") and not folder.write_dataset(whole, f"{at}/FB")
    back = folder.read_dataset(spark, f"{at}/FB")
    for a, b in ((whole.triples, back.triples), (whole.entities, back.entities), (whole.relations, back.relations), (whole.dense(), back.dense())):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    bare = replace(whole, triples=whole.triples.filter("split = 'train'"))
    assert folder.write_dataset(bare, f"{at}/bare", f"{at}/FB", [folder.ENTITIES, folder.RELATIONS])
    assert {r["split"] for r in folder.read_dataset(spark, f"{at}/bare").triples.collect()} == {"train"}
    assert {p.name for p in (tmp_path / "bare").iterdir() if p.name[0] not in "._"} == {"entity2id.txt", "relation2id.txt", "train.txt", "test.txt", "valid.txt"}
    (tmp_path / "rdf").write_text("<a>\t<r>\t<b> .\n" * 2)
    assert compiled.rdf_to_folder(spark, f"{at}/rdf", f"{at}/X") and not compiled.rdf_to_folder(spark, f"{at}/rdf", f"{at}/X")
    assert [tuple(r) for r in folder.read_dataset(spark, f"{at}/X").dense().collect()] == []


def test_catalog(spark, tmp_path):
    (tmp_path / "a").write_text(" h \tt\tr\t0.5\nh\tt\tr\tx\n\n")
    (tmp_path / "b").write_text("h\tc\t0.9\n")
    got = readers.catalog(spark, f"file://{tmp_path}", [("triples", ["a"], False, 0.5), ("categories", ["b"], True, 0.95)])
    assert sorted(map(tuple, got.fillna(-1.0).collect())) == [("categories", "h", "c", "0", 0.9, False), ("triples", "h", "t", "r", -1.0, False), ("triples", "h", "t", "r", 0.5, True)]
    with pytest.raises(Exception, match="(?i)path"):
        readers.catalog(spark, f"file://{tmp_path}", [("triples", ["a", "c"], False, 0.5)]).collect()


def test_value_stats(spark):
    """Borders of quarters belong to the lower one."""
    rows = spark.createDataFrame([(float(i),) for i in range(5)], "energy double")
    got = stats.value_stats(rows).first()
    assert [got[f"quarter_{q}"] for q in (1, 2, 3, 4)] == [2, 1, 1, 1] and got["median"] == 1.0 and got["variance"] == 2.0
    same = stats.value_stats(spark.createDataFrame([(1.0,), (1.0,)], "energy double")).first()
    assert same["quarter_1"] == 2 and same["distinct_values"] == 1


def test_resolved_and_sets(spark):
    ids_ = spark.createDataFrame([(1, "a", "b", "r")], "id long, head string, tail string, relation string")
    with pytest.raises(Exception, match="no triple of id 2"):
        evaluation.resolved(spark.createDataFrame([(1, 0.5), (2, 0.1)], "id long, rank double"), ids_).collect()


def test_dataset_of_collapsed_relations(spark):
    rows = triples(spark, [(f"h{i}", f"t{i}", f"r{i % 4}") for i in range(40)])
    whole = datasets.dataset(perturb.split(rows))
    less, mapping = datasets.collapsed(whole, 1)
    assert mapping.count() == 1 and less.relations.count() == 3 and less.entities is whole.entities
    assert less.split("train").count() == whole.split("train").count() == 36
    fewer, removed = datasets.with_fewer_relations(whole, 1)
    assert removed.select("relation").distinct().count() == 1 and sorted(r["idx"] for r in fewer.relations.collect()) == [0, 1, 2]


@pytest.mark.parametrize(("n", "sizes"), [(20, (18, 1, 1)), (15, (13, 1, 1)), (10, (9, 0, 0))])
def test_split(spark, n, sizes):
    got = {r["split"]: r["count"] for r in perturb.split(triples(spark, [(f"h{i}", f"t{i}", "r") for i in range(n)])).groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "test", "valid")) == sizes


def test_auc(spark):
    rows = lambda p, n: spark.createDataFrame([("a", "b", "r", p, True), ("c", "d", "r", n, False)], "head string, tail string, relation string, energy double, is_positive boolean")
    assert evaluation.auc_pr(rows(1.0, 2.0)).first()[0] == 1.0
    assert evaluation.auc_pr(rows(2.0, 1.0)).first()[0] == 0.25


def test_histogram(spark):
    got = {r["bucket"]: r["n"] for r in stats.histogram(spark.range(11), F.col("id")).collect()}
    assert got == {0: 2, **{b: 1 for b in range(1, 10)}}


def test_ontology(spark):
    rules = spark.createDataFrame([("RSub", "r1", "r2"), ("RSub", "r2", "r3"), ("Inv", "r3", "back")], "type string, src string, dst string")
    got = {tuple(r) for r in ontology.expanded(triples(spark, [("a", "b", "r1")]), rules).collect()}
    assert got == {("a", "b", "r1"), ("a", "b", "r2"), ("a", "b", "r3"), ("b", "a", "back")}


def test_ontology_closure(spark):
    """Paths in a ring of rules end, and no path is longer than the rounds."""
    rules = spark.createDataFrame([("RSub", f"r{i}", f"r{(i + 1) % 4}") for i in range(4)] + [("Inv", "r0", "x")], "type string, src string, dst string")
    found = {(r["src"], r["dst"], r["swapped"]): r["steps"] for r in ontology.closure(rules).collect()}
    assert found["r0", "r0", False] == 2 and found["r1", "x", True] == 4 and found["x", "r1", True] == 2 and len(found) == 5 * 5 * 1
    start = triples(spark, [("a", "b", "r0"), ("a", "b", "r0"), ("a", "b", "z")])
    assert {tuple(r) for r in ontology.expanded(start, rules, 1).collect()} == {("a", "b", "r0"), ("a", "b", "z"), ("a", "b", "r1"), ("b", "a", "x")}
    assert ontology.expanded(start, rules.limit(0)).count() == 2


def test_skyline_and_ranks(spark):
    test = spark.createDataFrame([("a", "b", "r", 1.0), ("a", "c", "r", 3.0)], "head string, tail string, relation string, energy double")
    made = spark.createDataFrame([("a", "b", "r", 1.0), ("a", "c", "r", 3.0), ("a", "x", "r", 2.0), ("a", "y", "r", 4.0), ("y", "b", "r", 0.5)], "head string, tail string, relation string, energy double")
    assert {r["tail"] for r in scoring.skyline(test, made).filter("head = 'a'").collect()} == {"b", "c", "x"}
    ranks = {(r["tail"], r["side"]): (r["raw"], r["filtered"]) for r in evaluation.link_ranks(test, made, test).collect()}
    assert ranks == {("b", "head"): (2, 2), ("b", "tail"): (1, 1), ("c", "head"): (1, 1), ("c", "tail"): (3, 2)}


def test_ids_and_counts(spark):
    rows = spark.createDataFrame([("b", "a", "r", 1), ("a", "c", "q", 2), ("a", "a", "r", 3)], "head string, tail string, relation string, pos int")
    assert {r["key"]: r["idx"] for r in ids.entity_ids(rows).collect()} == {"b": 0, "a": 1, "c": 2}
    assert {r["entity"]: r["n"] for r in stats.entity_counts(rows).collect()}["a"] == 4
    assert {r["entity"]: r["n"] for r in stats.entity_counts(rows, once=True).collect()}["a"] == 3
    gone = spark.createDataFrame([("a",)], "key string")
    assert {r["key"]: r["idx"] for r in ids.redensified(ids.entity_ids(rows), gone).collect()} == {"b": 0, "c": 1}


def test_ids_are_hashed_not_sorted(spark, monkeypatch):
    """Repeated rows are made one by the sort that ranks them, and first places are minima of numbers: structs were aggregated by sorting."""
    rows = triples(spark, [("b", "a", "r"), ("b", "a", "r"), ("a", "c", "r"), (None, "a", "r"), (None, "a", "r"), ("a", "b", "q")])
    order = [F.col(c) for c in ("head", "tail", "relation")]
    placed = ranked(rows, order, rank="pos", distinct=True)
    want = [(None, "a", "r", 1), ("a", "b", "q", 2), ("a", "c", "r", 3), ("b", "a", "r", 4)]
    assert sorted(map(tuple, placed.collect()), key=lambda x: x[3]) == want
    seen = []
    monkeypatch.setattr(ids, "ranked", lambda df, *x, **y: seen.append(df) or ranked(df, *x, **y))
    assert sorted((r["idx"], r["key"]) for r in ids.entity_ids(placed).collect()) == [(0, None), (1, "a"), (2, "b"), (3, "c")]
    assert "SortAggregate" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ids, "MANY", 0)
    some = placed.filter("head is not null")
    dense = ids.to_dense(some, ids.entity_ids(some), ids.relation_ids(some))
    assert sorted(map(tuple, dense.collect())) == [(0, 1, 0, 2), (0, 2, 1, 3), (1, 0, 1, 4)]
    assert "ShuffledHashJoin" in dense._jdf.queryExecution().executedPlan().toString()


def test_structure_of_null_and_repeated_keys(spark, tmp_path):
    """A triple of two tables, their keys being null, is there once; heads are counted before a shuffle, as they are in one partition."""
    rows = {"customer": ("c_custkey", "c_nationkey", [(None, 1), (2, 1), (2, 1)]), "supplier": ("s_suppkey", "s_nationkey", [(None, 1), (2, 1)]), "nation": ("n_nationkey", "n_regionkey", [(1, 0)]), "orders": ("o_orderkey", "o_custkey", [(5, 2)])}
    for name, (a, b, held) in rows.items():
        spark.createDataFrame(held, f"{a} long, {b} long").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(5, 7, 2), (5, 7, 2), (5, 8, 2)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = fixture.structure(spark, str(tmp_path))
    want = [(None, "n:1", "in_nation"), ("c:2", "n:1", "in_nation"), ("n:1", "r:0", "in_region"), ("o:5", "c:2", "placed_by"), ("o:5", "p:7", "contains"), ("o:5", "p:8", "contains"), ("p:7", "s:2", "supplied_by"), ("p:8", "s:2", "supplied_by"), ("s:2", "n:1", "in_nation")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan  # by names of all three parts before


def test_perturbations(spark):
    rows = triples(spark, [(f"h{i}", f"t{i % 7}", f"r{i % 3}") for i in range(60)])
    drawn = perturb.sparser(rows, 40)
    assert drawn.filter("removed").count() == 40 and drawn.filter("not removed").select("relation").distinct().count() == 3
    with pytest.raises(ValueError):
        perturb.sparser(rows, 58)
    split = perturb.split(rows)
    bad = perturb.corrupted(split, 0.2)
    assert bad.count() == split.count() and bad.filter("corrupted").count() == int(54 * 0.2)
    assert bad.filter("corrupted").join(split, ["head", "tail", "relation"], "left_semi").count() == 0


def test_corrupted_dense(spark):
    """A triple for which every attempt is a triple stays, with its flag, and the job does not fail."""
    rows = triples(spark, [(f"e{i}", f"e{j}", f"r{k}") for i in range(4) for j in range(4) for k in range(3)]).withColumn("split", F.lit("train"))
    bad = perturb.corrupted(rows, 0.5)
    assert bad.filter("corrupted").count() == 24
    assert sorted(map(tuple, bad.drop("corrupted").collect())) == sorted(map(tuple, rows.collect()))


def test_readers(spark, tmp_path):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    got = readers.wordnet(lines("  licence", "00001740 03 n 01 entity 0 002 ~ 00001930 n 0000 @ 00002137 n 0000 | gloss"))
    assert {tuple(r) for r in got.collect()} == {("00001740", "00001930", "_hyponym"), ("00001740", "00002137", "_hypernym")}
    with pytest.raises(Exception, match="unknown pointer"):
        readers.wordnet(lines("1 03 n 01 e 0 001 ? 2 n 0000 | g")).collect()
    got = readers.freebase(lines("<http://rdf.freebase.com/ns/m.1>\t<http://rdf.freebase.com/ns/r>\t<http://rdf.freebase.com/ns/m.2> ."))
    assert tuple(got.first()) == ("m.1", "m.2", "r")
    got = readers.reverb_annotations(lines("1\t0.9\t(Big Cat; eats; Fish)", "0\t0.1\t(a; b)"))
    assert [tuple(r) for r in got.collect()] == [("big_cat", "fish", "eats", True, 0.9)]
    path = tmp_path / "v.txt"
    path.write_text("1 2\n3 4\n5 6\n7 8\n")
    assert {r["idx"]: r["w"] for r in readers.matrices(spark, str(path), 2).collect()} == {0: [[1, 2], [3, 4]], 1: [[5, 6], [7, 8]]}
    path.write_text("a\t1\nb\t2\na\t3\n")
    assert {r["id"]: r["value"] for r in readers.value_map(spark, str(path)).collect()} == {"a": 3.0, "b": 2.0}
    held = one(spark, readers.options_of(F.lit("Options: [size: 100, outdir: /x, datadir: /a/b]")))
    assert held == {"size": "100", "datadir": "b"}


#: One of each kind; the driver runs them all.
CHECKED = """score_transe_l1 score_stranse_l1 corruptions_made corruptions_skyline link_ranks auc_pr energy_stats threshold_sweep dataset_stats_row dense_triples centile_dataset corrupted sparser_rounds external_triples
dataset_compiled dataset_annotated confidences_replaced source_triples_with_id source_matrices source_all_confident source_freebase source_wordnet log_results dump_tables dump_built numbers triples_without targets_kept energies_cached
folder_corruptions_scored dataset_grid dataset_fewer_relations corruptions_below_maximum corruptions_top_pairs sparser_draw sample_entities ontology_expanded parameter_grid dataset_from_folder dataset_from_folder_strict dataset_folder_rdf
dataset_folder_lexical dataset_folder_derived dataset_from_replaced_folder density_groomed score_added_method""".split()


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = Q.queries()[name](spark, SF).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    rows = lambda d: sorted(tuple(repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in d[columns].itertuples(index=False))
    assert columns == sorted(want.columns) and rows(got) == rows(want)


def test_entry_needs_no_session():
    """The queries can be listed before there is a session."""
    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 80)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[1]).stdout.split()[-1:] == ["True"]
