import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from trivane.llm import simhash
from trivane.llm.components import connected_components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(ids, fps, bits=4):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if i < j and (a ^ b).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def clusters(seed):
    """Fingerprints around and beyond the budgets, some of them equal."""
    rng = np.random.default_rng(seed)
    fps = []
    for c in rng.integers(0, 2**64, 40, dtype=np.uint64):
        for _ in range(rng.integers(1, 30)):
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                c = c ^ np.uint64(1 << int(b))
            fps.append(int(c))
    return np.array(fps, np.uint64)


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in links:
        x, y = find(u), find(v)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def joined(fps, bits, free, every=False, component=None, ends_only=False):
    """All rounds of the join in this process."""
    nodes = np.arange(len(fps))
    scheme, none = simhash.Exact(bits, free), np.zeros(0, simhash._SKETCH)
    rows, found = simhash._entries(fps, nodes, nodes if component is None else component, none, scheme.tries(), 0, 8), []
    for last in (False, True):
        again = []
        for bucket in {r[0] for r in rows}:
            table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[r for r in rows if r[0] == bucket]), simhash._DEALT_SCHEMA)], schema=simhash._DEALT_SCHEMA)
            for r in simhash._join(scheme, 8, every, last, table, ends_only).to_pylist():
                if r["u"] is not None:
                    found.append((r["u"], r["v"]))
                else:
                    again.append(tuple(r[c] for c in simhash._DEALT_SCHEMA.names))
        rows = again
    assert not rows
    return found


@pytest.mark.parametrize(("seed", "bits", "free", "hot"), [(0, 4, 2, 1 << 16), (1, 4, 2, 3), (2, 10, 3, 1 << 16), (3, 6, 2, 5)])
def test_trie_finds_all_links(seed, bits, free, hot, monkeypatch):
    """Few links connect what is near; with ``every`` all pairs of different components; hot subtrees are dealt out again."""
    monkeypatch.setattr(simhash, "HOT", hot)
    fps = clusters(seed)
    ids, values = list(range(len(fps))), fps.tolist()
    some = joined(fps, bits, free)
    assert all((values[u] ^ values[v]).bit_count() <= bits for u, v in some)
    assert components(ids, some) == brute(ids, values, bits)
    component = np.arange(len(fps)) // 7
    near = {(u, v) for u in ids for v in ids if u < v and u // 7 != v // 7 and (values[u] ^ values[v]).bit_count() <= bits}
    assert set(joined(fps, bits, free, True, component)) == near
    assert {u for u, v in joined(fps, bits, free, True, component, True) if u == v} == {x for pair in near for x in pair}


def test_drawn_tries_meet_most_pairs():
    """The chance that is promised for FAR differing bits; hot subtrees are dealt by bits that were not used."""
    rng = np.random.default_rng(3)
    for nodes in (1000, 10**6, 10**9):
        scheme = simhash.Drawn(simhash.levels_for(nodes))
        held = scheme.tries()
        masks = np.array([sum(1 << (63 - int(b)) for b in order[:levels]) for order, levels in held], np.uint64)
        apart = np.array([sum(1 << int(b) for b in rng.choice(64, simhash.FAR, replace=False)) for _ in range(400)], np.uint64)
        met = ((apart[:, None] & masks) == 0).any(axis=1).mean()
        assert simhash.CHANCE - 0.08 <= met < 1
    for order, levels in simhash.Drawn(14).tries(20):
        assert levels == 28 and order[:20].tolist() == list(range(20)) and sorted(order.tolist()) == list(range(64))


def test_dense_group_of_unlike_texts():
    """20,000 fingerprints within the budget, whose sets are not similar: pieces of bounded size, and no pair leaves the task."""
    rng = np.random.default_rng(5)
    fps = np.sort(np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 20_000, dtype=np.uint64)))
    sketches = np.zeros(len(fps), simhash._SKETCH)
    sketches["size"], sketches["bits"] = 200, rng.integers(0, 2**64, (len(fps), 2), dtype=np.uint64)
    whole, seen = np.array([0]), []

    def fits(x, y):
        seen.append(len(x))
        return simhash._fits(sketches, x, y)

    found = sum(len(x) for x, _ in simhash.near_pairs(fps, whole, np.array([len(fps)]), 0, 16, np.arange(len(fps)), True, fits))
    assert found == 0 and sum(seen) == 20_000 * 19_999 // 2 and max(seen) <= 2 * simhash.FRONTIER + len(fps)


def test_near_duplicates(spark, edge_documents):
    got = simhash.near_duplicates(edge_documents).collect()
    rows = edge_documents.collect()
    assert len(got) == len(rows)
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in rows if r["doc_id"] is not None}
    by_text = {(r["doc_id"], f"{fingerprint(r['text']):016x}") for r in rows}
    assert {(r["doc_id"], r["fingerprint"]) for r in got} == by_text
    unique = [i for i in fps if sum(r["doc_id"] == i for r in rows) == 1 or len({r["text"] for r in rows if r["doc_id"] == i}) == 1]
    assert set(unique) == set(fps)
    expected = brute(sorted(fps), [fps[i] for i in sorted(fps)])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected


def test_empty(spark, edge_documents):
    assert simhash.near_duplicates(edge_documents.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}
