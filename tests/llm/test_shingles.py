"""Near copies by fingerprints and shingle similarity against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from trivane.llm import shingles, simhash


def shingle_set(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def fingerprints(texts):
    """The majority of each bit over the names of a text's distinct shingles, and their sketch."""
    names, first = shingles.shingle_sets(pa.array(texts, pa.string()))
    out = []
    for a, b in zip(first, first[1:]):
        own = names[a:b].tolist()
        out.append(sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in own) > len(own)))
    return out, [int(x) << 64 | int(y) for x, y in shingles.sketches(names, first)]


def brute(rows, levels):
    """Components of all pairs of similar texts that share the first levels of a drawn trie, within both budgets."""
    rows = [r for r in rows if r[0] is not None]
    sets = [(i, shingle_set(t)) for i, t in rows]
    prints, sketches = fingerprints([t for _, t in rows])
    masks = [sum(1 << (63 - int(b)) for b in order[:n]) for order, n in simhash.Drawn(levels).tries()]

    def met(x, y):
        apart = prints[x] ^ prints[y]
        return apart.bit_count() <= simhash.COPY_BITS and (sketches[x] ^ sketches[y]).bit_count() <= shingles.SKETCH_BITS and any(apart & m == 0 for m in masks)

    part = list(range(len(sets)))
    for y in range(len(sets)):
        for x in range(y):
            if part[x] != part[y] and (sets[x][1] == sets[y][1] or met(x, y) and similar(sets[x][1], sets[y][1])):
                old, new = part[y], part[x]
                part = [new if p == old else p for p in part]
    least = {p: min(sets[k][0] for k in range(len(sets)) if part[k] == p) for p in set(part)}
    return sorted((i, least[p]) for (i, _), p in zip(sets, part))


def texts(seed):
    """Texts around the similarity looked for, chains of edits, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(400))
    passage, out = [word() for _ in range(30)], []
    for _ in range(12):
        words = [word() for _ in range(rng.randint(4, 160))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 8)):
            out.append(" ".join(words))
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = word()
            words = list(words) if rng.random() < 0.5 else words[: rng.randint(4, len(words))]
    return out


def test_parities_never_rule_out_similar_sets():
    """Sets around the similarity: what is similar passes the bound, and most of what is not does not."""
    rng = random.Random(11)
    pairs = []
    for _ in range(400):
        common, extra = [f"c{rng.random()}" for _ in range(rng.randint(20, 300))], rng.random() * 0.4
        pairs.append(tuple(" ".join(common + [f"x{rng.random()}" for _ in range(int(len(common) * extra))]) for _ in range(2)))
    names, first = shingles.shingle_sets(pa.array([t for pair in pairs for t in pair]))
    held = np.zeros(len(first) - 1, simhash._WIDE)
    held["size"], held["parities"] = np.diff(first), shingles.parities(names, first).view(np.uint64)
    passed = simhash._fits(held, np.arange(0, 800, 2), np.arange(1, 800, 2))
    true = np.array([similar(*map(shingle_set, pair)) for pair in pairs])
    assert 50 < true.sum() < 350 and passed[true].all() and passed[~true].mean() < 0.35


def test_recall():
    """Of pairs of a similarity of 0.8 or a little more nine of ten are met, of pairs of 0.6 few pass."""
    rng = random.Random(9)
    masks = [sum(1 << (63 - int(b)) for b in order[:n]) for order, n in simhash.Drawn(simhash.levels_for(10**6)).tries()]
    for share, low, high in ((0.89, 0.85, 1.0), (0.7, 0.0, 0.25)):
        pairs = []
        for _ in range(300):
            common, n = [f"c{rng.random()}" for _ in range(400)], 400
            cut = int(n * share)
            pairs.append((" ".join(common), " ".join(common[:cut] + [f"x{rng.random()}" for _ in range(n - cut)])))
        prints, sketches = fingerprints([t for pair in pairs for t in pair])
        met = sum((prints[i] ^ prints[i + 1]).bit_count() <= simhash.COPY_BITS and (sketches[i] ^ sketches[i + 1]).bit_count() <= shingles.SKETCH_BITS and any((prints[i] ^ prints[i + 1]) & m == 0 for m in masks) for i in range(0, 600, 2))
        assert low <= met / 300 <= high


def test_near_copies(spark, edge_rows):
    rows = [(i, t) for i, t, *_ in edge_rows] + [(1000 + i, t) for seed in range(3) for i, t in enumerate(texts(seed), 200 * seed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in simhash.near_copies(docs, levels=10).collect()) == brute(rows, 10)
    assert brute(rows, 10) != sorted((i, i) for i, _ in rows if i is not None)
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_stage_drops_near_copies_and_nothing_else(spark):
    """One changed word of 200 is a near copy; a tenth of the words changed is none. Of several texts of one id the first stays."""
    rng = random.Random(2)
    base = [f"a{rng.randrange(10**6)}" for _ in range(200)]
    near = [*base[:30], "other", *base[31:]]
    half = [f"b{i}" if i % 10 == 0 else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(half)), (None, " ".join(base)), (1, " ".join(base)), (4, "one text"), (4, "another text")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] for r in got), key=str) == [1, 3, 4, None]
    assert {r["text"] for r in got if r["doc_id"] == 4} == {"another text"}
