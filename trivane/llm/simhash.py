"""SimHash near duplicates by binary trie self-join.

Two fingerprints with at most k differing bits agree in at least f of k + f blocks of bits, so for each f blocks there
is a trie whose first levels are these blocks: in it, only pairs of nodes without a difference so far go on from those
levels, and the others are found in another trie. A trie's subtrees below these levels are spread over the
cluster; one with very many fingerprints is dealt out again by tries over the other bits. In a subtree, pairs of
nodes are traversed together, differing bits add up, and a pair is pruned when they exceed the budget or when all
that stands below both is known to be connected already. So a group of copies gives links that connect it, not all
its pairs.

``near_duplicates`` links by fingerprints alone. ``near_copies`` takes links of a much wider budget as candidates and keeps
those whose sets of word shingles are similar enough. So wide a budget would need very many tries to meet every pair
for certain; there, the first levels are bits drawn by chance, of as many tries as meet most pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm import shingles
from trivane.llm.components import connected_components
from trivane.llm.exchange import by_bucket, joined
from trivane.llm.words import NOT_SPACE, find_words, mix, text_slices
from trivane.llm.workspace import materialise, ship

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Blocks without a difference at the head of a trie.
FREE = 2
#: Node pairs that are held at a time, entries that are dealt at a time and of a bucket, and fingerprints of a subtree that is
#: dealt out again.
FRONTIER, DEALT, BUCKET, HOT = 1 << 17, 1 << 19, 1 << 18, 1 << 16
#: The share of the tries that look for links that connect, before all look for what is left.
SOME = 0.25
#: Budget of ``near_copies``; its tries meet a pair of FAR differing bits with this chance at least.
COPY_BITS, FAR, CHANCE = 16, 12, 0.9


def majority(hashes: np.ndarray, each: np.ndarray) -> np.ndarray:
    """For each run of ``each[i]`` hashes the bits that are set in over half of them; zero for an empty run."""
    out = np.zeros(len(each), np.uint64)
    full = np.flatnonzero(each)
    if len(full):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, (np.cumsum(each) - each)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > each[full][:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)
    return out


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    words = find_words(column, NOT_SPACE, lower=True)
    keep = np.zeros(len(words.data) + 1, bool)
    inner = np.ones(len(words.starts), bool)
    inner[words.first[1:][words.counts > 0] - 1] = False
    depth = np.zeros(len(words.data) + 1, np.int8)
    depth[words.starts] += 1
    depth[words.ends] -= 1
    inside = np.cumsum(depth)[:-1] > 0 if len(words.data) else np.zeros(0, bool)
    keep[:-1] = inside
    keep[words.ends[inner]] = True  # one separator after each word but the last of a document
    new = np.cumsum(keep) - keep
    flat = np.where(inside, words.data, np.uint8(32))[keep[:-1]].tobytes()
    starts, ends = new[words.starts], new[words.ends - 1] + 1
    each = np.where(words.counts > 0, np.maximum(words.counts - shingle + 1, 1), 0)
    at = np.repeat(words.first[:-1], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    last = np.minimum(at + shingle, np.repeat(words.first[1:], each)) - 1
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(flat[s:e], SEED) for s, e in zip(starts[at].tolist(), ends[last].tolist())], np.uint64)
    return majority(hashes, each)


def _fingerprint(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                found = fingerprints_of(piece.column("text"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return run


def tries(max_bits: int = MAX_BITS, free: int = FREE, skip: int = 0) -> list[tuple[np.ndarray, int]]:
    """For each trie the order of the fingerprint's bits, most significant first, and the levels without a difference.

    The first ``skip`` bits are without a difference already and stay first.
    """
    blocks = np.array_split(np.arange(skip, 64), max_bits + free)
    out = []
    for chosen in combinations(range(max_bits + free), free):
        head = np.concatenate([np.arange(skip), *(blocks[b] for b in chosen)])
        rest = np.concatenate([blocks[b] for b in range(max_bits + free) if b not in chosen])
        out.append((np.concatenate([head, rest]), len(head)))
    return out


#: What an entry may tell of its set: size and sketch, and more exactly also its parities.
_SKETCH = np.dtype([("size", np.uint32), ("bits", np.uint64, shingles.SKETCH // 64)])
_WIDE = np.dtype([*_SKETCH.descr, ("parities", np.uint64, shingles.PARITIES // 64)])


@dataclass(frozen=True)
class Exact:
    """Tries that meet every pair of at most ``max_bits`` differing bits."""

    max_bits: int = MAX_BITS
    free: int = FREE
    sketch: np.dtype = _SKETCH

    def tries(self, skip: int = 0) -> list[tuple[np.ndarray, int]]:
        return tries(self.max_bits, FREE if skip else self.free, skip)


def meeting(levels: int, bits: int, room: int = 64) -> float:
    """The chance that ``levels`` bits drawn of ``room`` hold none of ``bits`` that differ."""
    return math.prod(max(room - levels - i, 0) / (room - i) for i in range(bits))


@dataclass(frozen=True)
class Drawn:
    """Tries whose first ``levels`` bits are drawn by chance, always the same, so many that a pair of FAR differing bits shares
    the first levels of one with the chance CHANCE; nearer pairs with more."""

    levels: int
    max_bits: int = COPY_BITS
    sketch: np.dtype = _SKETCH
    share: float = 1.0  # of the tries, where only some links are looked for

    def tries(self, skip: int = 0) -> list[tuple[np.ndarray, int]]:
        room = 64 - skip
        levels = min(self.levels if not skip else 8, max(1, room - self.max_bits))
        number = math.ceil(self.share * math.log(1 - CHANCE) / math.log(1 - meeting(levels, FAR, room)))
        orders = (np.random.default_rng([skip, levels, i]).permutation(room) + skip for i in range(number))
        return [(np.concatenate([np.arange(skip), order]), skip + levels) for order in orders]


def unpacked(fingerprints: np.ndarray) -> np.ndarray:
    return np.unpackbits(fingerprints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def rotated(bits: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Fingerprints of unpacked ``bits`` in another order."""
    return np.packbits(bits[:, order], axis=1).reshape(-1).view(">u8").astype(np.uint64)


#: Entries of subtrees, packed by bucket: fingerprints in a trie's order, the trie, its levels, nodes, and their components as
#: the bits in which they differ from the node, which are mostly none and take no room in the shuffle; and where sets
#: are compared, their sizes and sketches.
_DEALT = "bucket int, fps binary, tries binary, levels binary, nodes binary, components binary, sketches binary"
_KINDS = {"fps": np.uint64, "tries": np.uint32, "levels": np.uint8, "nodes": np.int64, "components": np.int64}
_DEALT_SCHEMA = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in (*_KINDS, "sketches")])
_JOINED = "u long, v long, " + _DEALT
_JOINED_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64()), *_DEALT_SCHEMA])


def _entries(fps: np.ndarray, nodes: np.ndarray, components: np.ndarray, sketches: np.ndarray, held: list[tuple[np.ndarray, int]], first: int, buckets: int) -> list[tuple]:
    """Rows of _DEALT with the entries of all tries; tries are numbered from ``first``. ``sketches`` may be empty."""
    bits, parts = unpacked(fps), []
    for number, (order, levels) in enumerate(held, first):
        turned = rotated(bits, order)
        parts.append((turned, np.full(len(fps), number, np.uint32), np.full(len(fps), levels, np.uint8), mix((turned >> np.uint64(64 - levels)) ^ mix(np.full(1, number, np.uint64)))))
    turned, number, levels, keys = (np.concatenate(x) for x in zip(*parts))
    nodes, components = np.tile(nodes, len(held)), np.tile(nodes ^ components, len(held))
    order, cuts = by_bucket(keys, buckets)
    columns = [x[order] for x in (turned, number, levels, nodes, components, *([np.tile(sketches, len(held))] if len(sketches) else []))]
    return [(b, *(x[lo:hi].tobytes() for x in columns), *([] if len(sketches) else [b""])) for b, lo, hi in cuts]


def _deal(buckets: int, scheme: Exact | Drawn, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, node, component, sketch) rows to the entries of all tries."""
    held = scheme.tries()
    room = max(1, DEALT * _SKETCH.itemsize // (scheme.sketch.itemsize * len(held)))
    waiting, size = [], 0

    def dealt() -> pa.RecordBatch:
        fps, nodes, components, sketches = (np.concatenate(x) for x in zip(*waiting))
        rows = _entries(fps.view(np.uint64), nodes, components, sketches, held, 0, buckets)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DEALT_SCHEMA)], schema=_DEALT_SCHEMA)

    for batch in batches:
        for at in range(0, batch.num_rows, room):
            piece = batch.slice(at, room)
            waiting.append((*(piece.column(c).to_numpy() for c in ("fp", "node", "component")), joined(piece.column("sketch").to_pylist(), scheme.sketch)))
            size += piece.num_rows
            if size >= room:
                yield dealt()
                waiting, size = [], 0
    if size:
        yield dealt()


def _flatten(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The forest (each place points to the smallest place of its component) after new links."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent = _flatten(parent)


def near_pairs(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, levels: int, max_bits: int, parent: np.ndarray, every: bool, fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places x, y) of at most ``max_bits`` differing bits in subtrees of ascending fingerprints.

    The subtrees are the places from ``starts`` to ``ends``, which agree in ``levels`` bits. ``parent`` has for each place
    the smallest place of its component. With ``every`` all pairs of different components are given, else only as
    many as connect what can be connected. Pairs that do not pass ``fits`` are none.
    """
    ones: dict[int, np.ndarray] = {}
    some = ends - starts > 1
    lo, hi = starts[some], ends[some]
    stack = [(levels, np.stack([lo, hi, lo, hi, np.zeros(len(lo), np.int64)])[:, i : i + FRONTIER]) for i in range(0, len(lo), FRONTIER)]
    change = None

    def chosen(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal parent, change
        near = (parent[x] != parent[y]) & (np.bitwise_count(fps[x] ^ fps[y]) <= max_bits)
        x, y = x[near], y[near]
        if len(x) and fits is not None:
            good = fits(x, y)
            x, y = x[good], y[good]
        if len(x) and not every:  # one pair for each two components
            ends_ = np.sort(np.stack([parent[x], parent[y]]), axis=0)
            _, at = np.unique(ends_[0] * len(fps) + ends_[1], return_index=True)
            x, y = x[at], y[at]
            parent, change = _unite(parent, x, y), None
        if len(x):
            yield x, y

    while stack:
        depth, pairs = stack.pop()
        if change is None:
            change = np.concatenate([[0], np.cumsum(parent[1:] != parent[:-1])])
        a, ah, b, bh, _ = pairs  # what is one component already needs no further look
        pairs = pairs[:, ~((parent[a] == parent[b]) & (change[ah - 1] == change[a]) & (change[bh - 1] == change[b]))]
        a, ah, b, bh, diff = pairs
        single = (ah - a == 1) & (bh - b == 1)
        if single.any():
            yield from chosen(a[single], b[single])
            a, ah, b, bh, diff = pairs[:, ~single]
        if not len(a):
            continue
        if depth == 64:  # equal fingerprints on each side
            own = a == b
            for x, y in _within(a[own], ah[own], every):
                yield from chosen(x, y)
            for x, y in _between(a[~own], ah[~own], b[~own], bh[~own], every):
                yield from chosen(x, y)
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([np.zeros(1, np.int32), np.cumsum((fps >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int32)])
        count = ones[depth]
        am, bm = ah - (count[ah] - count[a]), bh - (count[bh] - count[b])
        cross = a != b
        near = np.concatenate([np.stack([a, am, b, bm, diff]), np.stack([am, ah, bm, bh, diff])], axis=1)
        far = np.concatenate([np.stack([a, am, bm, bh, diff + 1]), np.stack([am, ah, b, bm, diff + 1])[:, cross]], axis=1)
        alive = lambda p: p[:, (p[1] > p[0]) & (p[3] > p[2]) & (p[4] <= max_bits) & ~((p[0] == p[2]) & (p[1] - p[0] == 1))]
        near, far = alive(near), alive(far)
        if near.shape[1] + far.shape[1] <= FRONTIER:
            stack.append((depth + 1, np.concatenate([far, near], axis=1)))
        else:  # pairs with fewer differences come first, as what they connect prunes the others
            for part in (far, near):
                stack += [(depth + 1, part[:, i : i + FRONTIER // 2]) for i in range(0, part.shape[1], FRONTIER // 2)]


def _pieces(rows: Iterator[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a place with each place of a range (place, from, to), some FRONTIER at a time."""
    held, n = [], 0
    for place, lo, hi in rows:
        held.append((np.full(hi - lo, place), np.arange(lo, hi)))
        n += hi - lo
        if n >= FRONTIER:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _within(a: np.ndarray, ah: np.ndarray, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of each range: all, or the first with each other."""
    last = (lambda lo, h: h - 1) if every else (lambda lo, h: lo + 1)
    yield from _pieces((one, one + 1, h) for lo, h in zip(a.tolist(), ah.tolist()) for one in range(lo, last(lo, h)))


def _between(a: np.ndarray, ah: np.ndarray, b: np.ndarray, bh: np.ndarray, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a place of each first and each second range: all, or those of the first places."""
    if not every:
        yield a, b
        return
    yield from _pieces((one, x, y) for lo, h, x, y in zip(a.tolist(), ah.tolist(), b.tolist(), bh.tolist()) for one in range(lo, h))


def _fits(sketches: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sets may be similar, by their sizes and parities for certain and by their sketches with great likelihood."""
    sizes, others = (sketches["size"][z].astype(np.int64) for z in (x, y))
    p, q = shingles.SIMILARITY
    differ = np.bitwise_count(sketches["bits"][x] ^ sketches["bits"][y]).sum(axis=1, dtype=np.int64)
    may = (q * np.minimum(sizes, others) >= p * np.maximum(sizes, others)) & (differ <= shingles.SKETCH_BITS)
    if "parities" in sketches.dtype.names:
        at = np.flatnonzero(may)
        odd = np.bitwise_count(sketches["parities"][x[at]] ^ sketches["parities"][y[at]]).sum(axis=1, dtype=np.int64)
        may[at] = odd <= sizes[at] + others[at] - 2 * shingles.required(sizes[at], others[at])
    return may


def _join(scheme: Exact | Drawn, buckets: int, every: bool, last: bool, table: pa.Table, ends_only: bool = False) -> pa.Table:
    """The subtrees of a bucket to links (u, v) between nodes; subtrees that are too large are dealt out again. With ``ends_only``
    each node that has a link is there once, as u and v."""
    fps, trie, level, nodes, component, sketches = (joined(table.column(c).to_pylist(), k) for c, k in (*_KINDS.items(), ("sketches", scheme.sketch)))
    order = np.lexsort((fps, trie, level))
    fps, trie, level, nodes, component = (x[order] for x in (fps, trie, level, nodes, component))
    sketches = sketches[order] if len(sketches) else sketches
    component = component ^ nodes
    links, again = [np.zeros((2, 0), np.int64)], []
    for levels in np.unique(level).tolist():
        lo, hi = np.searchsorted(level, [levels, levels + 1])
        own, names, groups, sketched = fps[lo:hi], nodes[lo:hi], component[lo:hi], sketches[lo:hi]
        key = own >> np.uint64(64 - levels)
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (trie[lo + 1 : hi] != trie[lo : hi - 1])]))
        ends = np.append(starts[1:], hi - lo)
        hot = (ends - starts > HOT) & (not last)
        for s, e in zip(starts[hot].tolist(), ends[hot].tolist()):
            number = int(mix(np.array([(int(trie[lo + s]) << 32) + int(key[s] >> np.uint64(max(0, levels - 32)))], np.uint64))[0] >> np.uint64(33))
            again += _entries(own[s:e], names[s:e], groups[s:e], sketched[s:e], scheme.tries(levels), number, buckets)
        _, first, place = np.unique(groups, return_index=True, return_inverse=True)
        fits = partial(_fits, sketched) if len(sketches) else None
        touched = np.zeros(len(own), bool)
        for x, y in near_pairs(own, starts[~hot], ends[~hot], levels, scheme.max_bits, first[place], every, fits):
            if ends_only:
                touched[x] = touched[y] = True
            else:
                links.append(np.stack([names[x], names[y]]))
        links.append(np.stack([names[touched], names[touched]]))
    u, v = np.unique(np.sort(np.concatenate(links, axis=1), axis=0), axis=1)
    rows = pa.table([u, v], ["u", "v"])
    if not again:
        return pa.table([*rows.columns, *(pa.nulls(len(u), f.type) for f in _DEALT_SCHEMA)], schema=_JOINED_SCHEMA)
    dealt = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*again), _DEALT_SCHEMA)], schema=_DEALT_SCHEMA)
    return pa.concat_tables([rows, dealt], promote_options="default").select(_JOINED_SCHEMA.names).cast(_JOINED_SCHEMA)


def _of_table(f):
    def run(table: pa.Table) -> pa.Table:
        return f(table)

    return run


def links(nodes: DataFrame, scheme: Exact | Drawn = Exact(), every: bool = False, ends_only: bool = False) -> DataFrame:
    """(u, v): nodes of (fp, node, component) whose fingerprints differ in few bits, of different components.

    Without ``every`` only as many as connect each subtree. With ``ends_only`` only the nodes that have a link, as u and v. With a column ``sketch`` of sizes and sketches only those whose sets may
    be similar.
    """
    spark = nodes.sparkSession
    nodes = nodes if "sketch" in nodes.columns else nodes.withColumn("sketch", F.lit(b""))
    entries = nodes.count() * len(scheme.tries())
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), entries * scheme.sketch.itemsize // (BUCKET * _SKETCH.itemsize) + 1)
    dealt = nodes.select("fp", "node", "component", "sketch").mapInArrow(partial(_deal, buckets, scheme), _DEALT)
    found = None
    for last in (False, True):
        joiner = partial(_join, scheme, buckets, every, last, ends_only=ends_only)
        both = materialise(dealt.groupBy("bucket").applyInArrow(_of_table(joiner), _JOINED), "links")
        own = both.filter("u is not null").select("u", "v")
        found = own if found is None else found.union(own)
        dealt = both.filter("bucket is not null").drop("u", "v")
        if last or dealt.isEmpty():
            return found.distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Texts are linked if their fingerprints differ in at most MAX_BITS bits; component_id is the smallest doc_id
    that can be reached. Null and empty texts have fingerprint zero and are linked like any other. Repeated rows
    are all returned. A row with a null doc_id has the component of its fingerprint, which is null if no other
    document is in it. Only doc_id and text are read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprint(shingle), "doc_id long, fp long")
    rows = materialise(rows, "fingerprints")
    nodes = materialise(rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = connected_components(links(nodes.withColumn("component", F.col("node"))))
    placed = nodes.join(found, "node", "left").select(F.col("fp").alias("node_fp"), F.coalesce("component", "node").alias("component_id"))
    placed = materialise(placed, "components")
    return rows.join(placed, F.col("fp") == F.col("node_fp"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _nodes(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch):
            names, first = shingles.shingle_sets(piece.column("text"), shingle)
            sizes = np.diff(first)
            held = [shingles.set_names(names, first).view(np.int64), majority(names, sizes).view(np.int64), sizes.astype(np.int32)]
            sketch = np.zeros(len(sizes), _SKETCH)
            sketch["size"], sketch["bits"] = sizes, shingles.sketches(names, first)
            packed = [pa.array([x.tobytes() for x in column], pa.binary()) for column in (shingles.parities(names, first), sketch)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *map(pa.array, held), *packed], ["doc_id", "node", "fp", "size", "parities", "sketch"])


def levels_for(nodes: int) -> int:
    """First levels of drawn tries: subtrees grow much more slowly than the nodes, and the tries with them."""
    return max(8, math.ceil(0.7 * math.log2(max(nodes, 2))))


def _placed(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes with their components so far, written."""
    out = nodes.join(found.hint("shuffle_hash"), "node", "left").select("fp", "node", "sketch", F.coalesce("component", "node").alias("component"))
    return materialise(out, "placed")


def near_copies(docs: DataFrame, shingle: int = shingles.SHINGLE, levels: int | None = None) -> DataFrame:
    """doc_id and component_id of every row with a doc_id.

    Texts are linked if the Jaccard similarity of their sets of shingles is ``shingles.SIMILARITY`` at least, their
    fingerprints differ in at most COPY_BITS bits and not in the first ``levels`` of one of the drawn tries, and their sketches in at most
    ``shingles.SKETCH_BITS``; component_id is the smallest doc_id that can be reached. The levels grow with the documents, so that
    subtrees stay small, and with them the tries, so that about as many pairs meet.
    Texts of equal sets are one node, so are all without a word. Repeated rows are all returned. Only doc_id and
    text are read. An empty table gives an empty table.

    Links that connect are looked at first; then all pairs of fingerprints whose nodes are still in different components. In
    a large group of texts that are somewhat less similar these are very many. So the nodes that have any are found first, and
    of their pairs none leaves its subtree that the sets' parities rule out, which leave few that are not similar.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    rows = materialise(docs.mapInArrow(partial(_nodes, shingle), "doc_id long, node long, fp long, size int, parities binary, sketch binary"), "rows")
    heads = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("parities").alias("parities"), F.first("sketch").alias("sketch"))
    heads = materialise(heads, "heads")
    kept = heads.filter("size > 0").select("fp", "node", "sketch")
    scheme = Drawn(levels or levels_for(kept.count()))
    some = replace(scheme, share=SOME)
    first = shingles.similar(docs, heads, links(kept.withColumn("component", F.col("node")), some), shingle)
    found = materialise(connected_components(first), "found")
    placed = _placed(kept, found)
    # nodes that have pairs still apart; their entries carry parities too, so that few pairs leave a subtree that are not similar
    ends = materialise(links(placed, scheme, every=True, ends_only=True).select(F.col("u").alias("node")), "ends")
    wide = kept.join(ends.hint("shuffle_hash"), "node").join(heads.select("node", "parities").hint("shuffle_hash"), "node")
    wide = materialise(wide.select("fp", "node", F.concat("sketch", "parities").alias("sketch")), "wide")
    for connect in (True, False):  # first what connects, then all that is still apart
        tried = links(_placed(wide, found), replace(some if connect else scheme, sketch=_WIDE), every=not connect)
        more = shingles.similar(docs, heads, tried, shingle, possible=True)
        if not more.isEmpty():
            found = materialise(connected_components(more.union(found.select("node", "component"))), "found")
    named = heads.select("node", "least").join(found.hint("shuffle_hash"), "node", "left")
    named = materialise(named.select("node", "least", F.coalesce("component", "node").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = named.join(least.hint("shuffle_hash"), "component").select("node", "component_id")
    return rows.join(placed.hint("shuffle_hash"), "node").select("doc_id", "component_id")
