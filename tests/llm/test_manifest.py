"""The manifest, sharding and clustering against plain Python."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivane.llm import ball_kmeans, manifest_queries, merkle, ring


def h(text):
    return sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """(root, siblings of each leaf upwards)."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for leaf, place in enumerate(at):
            if place ^ 1 < len(level):
                paths[leaf].append(level[place ^ 1])
        level, at = [h("".join(level[i : i + 2])) for i in range(0, len(level), 2)], [place // 2 for place in at]
    return level[0], paths


def plain_manifest(rows):
    """Of (doc_id, text, lang, source, n_chars): sorted (doc_id, leaf, subroot, root, proof)."""
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        trees.setdefault("" if lang is None else "=" + lang, []).append((doc_id is not None, doc_id or 0, h("".join(map(part, (doc_id, source, lang, n_chars, text)))), doc_id))
    held = {t: plain_tree([x[2] for x in sorted(v, key=lambda x: x[:3])]) for t, v in trees.items()}
    names = sorted(held, key=str.encode)
    root, above = plain_tree([held[t][0] for t in names])
    out = []
    for t, up in zip(names, above):
        for x, path in zip(sorted(trees[t], key=lambda x: x[:3]), held[t][1]):
            out.append((str(x[3]), x[2], held[t][0], root, h("".join(path + up))))
    return sorted(out)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 11])
def test_walk(n):
    leaves = [sha256(bytes([i])).digest() for i in range(n)]
    root, paths = merkle.walked(leaves, (n - 1).bit_length())
    expected, siblings = plain_tree([x.hex() for x in leaves])
    assert root.hex() == expected and [[s[1:].hex() for s in p if s] for p in paths] == siblings


@pytest.mark.parametrize("height", [1, 2, 12])
def test_manifest(spark, edge_rows, edge_documents, height):
    """Every proof leads to the root; a changed leaf leads elsewhere; blocks of any height give the same tree."""
    docs = edge_documents.withColumn("slot", F.lit("clash")).withColumn("tree", F.lit(1))
    changed = {"n_chars": F.lit(7).cast("long")}
    rows = merkle.manifest(docs, tampered=changed, height=height)
    own = merkle.digest(rows.withColumn("other", F.col("leaf"))).collect()
    assert sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in own) == plain_manifest([r[:5] for r in edge_rows])
    assert all(r["verified"] for r in own) and len(own) == len(edge_rows)
    assert not any(r["verified"] for r in merkle.digest(rows).collect())


def test_manifest_of_few_rows(spark, edge_documents):
    assert merkle.manifest(edge_documents.limit(0)).count() == 0
    one = merkle.digest(merkle.manifest(edge_documents.filter("doc_id = 1").limit(1))).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == h("")


def plain_ring(keys, shards, virtual, capacity):
    """Home and shard of each (place of the key, rank) by the rule as it is told."""
    hashed = lambda *x: int(__import__("hashlib").md5(":".join(map(str, x)).encode()).hexdigest()[:8], 16)
    nodes = sorted((hashed("node", s, c), s, c) for s in range(shards) for c in range(virtual))
    arcs = [[] for _ in nodes]
    for key in keys:
        place = hashed("key", *([] if key is None else [key]))
        arcs[next((i for i, n in enumerate(nodes) if n[0] >= place), 0)].append((place, key is not None, key or 0))
    room, out, queue = list(capacity), [], []
    for i, arc in enumerate(arcs):
        for key in sorted(arc):
            if room[nodes[i][1]] > 0:
                room[nodes[i][1]] -= 1
                out.append((key, nodes[i][1], nodes[i][1]))
            else:
                queue.append((i, key))
    waiting = []
    for step in range(2 * len(nodes)):
        i = step % len(nodes)
        while waiting and room[nodes[i][1]] > 0:
            j, key = waiting.pop(0)
            room[nodes[i][1]] -= 1
            out.append((key, nodes[j][1], nodes[i][1]))
        waiting += [x for x in queue if x[0] == i] if step < len(nodes) else []
    assert not waiting
    return Counter((key[2] if key[1] else None, home, shard) for key, home, shard in out)


@pytest.mark.parametrize(("n", "shards", "slack"), [(500, 7, 0.0), (500, 7, 0.25), (5, 8, 0.0), (0, 3, 0.0)])
def test_ring(spark, n, shards, slack):
    """A third of the rows have one key, some have none."""
    rng = random.Random(3)
    keys = [1000 if i % 3 == 0 else None if i % 11 == 0 else rng.randrange(400) for i in range(n)]
    rows = spark.createDataFrame([(k, "x", 5) for k in keys], "doc_id long, low string, shard int")
    got = ring.placed(rows, "doc_id", shards, 16, slack).collect()
    each, more = divmod(n, shards)
    capacity = [each + (s < more) for s in range(shards)] if slack == 0 else [int(-(-n * (1 + slack) // shards))] * shards
    assert Counter((r["doc_id"], r["home"], r["shard"]) for r in got) == plain_ring(keys, shards, 16, capacity)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(held) == list(range(len(held))) for held in slots.values())
    assert all(len(held) <= capacity[s] for s, held in slots.items())


def test_ring_moves_little(spark):
    """With one shard more, and with more room, most rows stay."""
    rows = spark.range(6000).select(F.col("id").alias("doc_id"))
    held = {key: {r["doc_id"]: r["shard"] for r in ring.placed(rows, "doc_id", *key).collect()} for key in ((24, 128, 0.0), (25, 128, 0.0), (24, 128, 0.25))}
    moved = sum(held[24, 128, 0.0][k] != held[25, 128, 0.0][k] for k in range(6000)) / 6000
    away = lambda key: sum(r["shard"] != r["home"] for r in ring.placed(rows, "doc_id", *key).select("shard", "home").collect()) / 6000
    assert 1 / 25 <= moved < 0.15 and away((24, 128, 0.25)) < away((24, 128, 0.0)) < 0.08


def test_sharded_documents(spark, edge_rows, edge_documents):
    got = ring.shard_documents(edge_documents.withColumn("slot", F.lit(9)), 5, 8).collect()
    measured = lambda text: (len((text or "").encode()) + 8, zlib.crc32((text or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], *measured(r[1])) for r in edge_rows)
    assert max(Counter(r["shard"] for r in got).values()) - min(Counter(r["shard"] for r in got).values()) <= 1


def plain_kmeans(rows, k, rounds):
    """(vec_id, cluster, distance) of (vec_id, integers), by all distances."""
    order = sorted(rows, key=lambda r: (r[0] is None, h(f"3:{r[0]}") if r[0] is not None else "", r[1]))
    centres = [list(r[1]) for r in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        held = [near(v)[1] for _, v in rows]
        for i in range(len(centres)):
            if members := [v for (_, v), c in zip(rows, held) if c == i]:
                centres[i] = [sum(x) // len(members) for x in zip(*members)]
    return Counter((r[0], near(r[1])[1], min(near(r[1])[0], 2**63 - 1)) for r in rows)


@pytest.mark.parametrize(("spreading", "scale"), [(0.02, 1.0), (1.0, 1.0), (1.0, 1e9)])
def test_ball_kmeans(spark, spreading, scale):
    """Tight and loose clusters, ties, repeated vectors, numbers beyond what longs can square, and rows that take no part."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(6, 64))
    vectors = [np.float32((middle[i % 6] + spreading * rng.normal(size=64)) * scale).tolist() for i in range(240)]
    vectors += [vectors[0]] * 30 + [[0.0] * 64, [-0.0001] * 64]
    rows = [(i if i % 50 else None, v, 1) for i, v in enumerate(vectors)]
    bad = [(1, None, 1), (2, [], 1), (3, [1.0] * 63, 1), (4, [1.0] * 63 + [None], 1), (5, [1.0] * 63 + [float("nan")], 1), (6, [float("inf")] * 64, 1)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, cluster int").repartition(5)
    got = ball_kmeans.cluster(frame, 8, 4).collect()
    exact = [(r[0], [int(np.floor(np.float64(1024) * np.float64(np.float32(x)))) for x in r[1]]) for r in rows]
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == plain_kmeans(exact, 8, 4)


def test_ball_kmeans_of_few(spark):
    frame = lambda *v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    assert ball_kmeans.cluster(frame()).count() == 0
    got = ball_kmeans.cluster(frame([1.0] * 64, [2.0] * 64)).collect()
    assert {r["cluster"] for r in got} == {0, 1} and {r["distance"] for r in got} == {0} == {r["inertia"] for r in got}


def test_balls_prune():
    """Of well separated clusters most members are compared with their own centroid only."""
    rng = np.random.default_rng(7)
    middle = rng.integers(-3000, 3000, size=(8, 64))
    x = (middle[np.arange(4000) % 8] + rng.integers(-60, 60, size=(4000, 64))).astype(np.int64)
    moved = (middle + 1).tolist()
    balls = ball_kmeans.Balls([tuple(c) for c in moved], [tuple(c) for c in middle.tolist()])
    held, distance = balls.assigned(x, (np.arange(4000) % 8).astype(np.int32))
    assert (held == np.arange(4000) % 8).all() and balls.compared == 4000
    still = ball_kmeans.Balls(balls.centres, balls.centres)
    noise = rng.integers(-3000, 3000, size=(1000, 64))
    labels, _ = ball_kmeans.Balls(balls.centres).assigned(noise, np.zeros(1000, np.int32))
    again, _ = still.assigned(noise, labels)
    assert (again == labels).all() and still.compared == 1000


@pytest.mark.parametrize("name", sorted(manifest_queries.QUERIES))
def test_query_matches_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = manifest_queries.QUERIES[name](spark, sf).toPandas(), con.execute(manifest_queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    rows = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert columns == sorted(want.columns) and rows(got) == rows(want)
