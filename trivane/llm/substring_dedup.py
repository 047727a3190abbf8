"""Removal of word sequences that another document has before, found by recompression.

Every text becomes a sequence of symbols. Spark rounds name them for all documents at once (``blocks``): the first
round names runs of one word, each further one names pairs of a left-hand and a right-hand symbol, where the side of
a symbol is a bit of its name. A name is a number that the round's bucket gives to a key that several documents
have; what only one document has gets none. As names are the same everywhere, a long repeat has the same symbols
inside wherever it stands: only symbols at its borders depend on what is around. For each symbol the words are known
that decided it.

1. Reveal. A window of words that contains all that decided a symbol without a name cannot stand in another
   document. So after each round fewer windows are left, and only pairs inside these are asked for.
2. Verify. The windows that are left are exchanged by names of 128 bits of their words, and each is held against the
   smallest document that has it.

A round handles a key once for each block of documents, so a passage that very many documents share costs no more
than one that each block has once.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm import blocks as B
from trivane.llm.words import NOT_SPACE, Words, find_words, mix, phrase_names, span_names
from trivane.llm.workspace import NO_ID, bucket_count, materialise, ship

WINDOW, ROUNDS = 13, 2
_FAR = 1 << 40
_STEP = np.uint64(0x9FB21C651E98DF25)


class Symbols:
    """Symbols of a block: names (0: none), words ``lo`` to ``hi``, and words ``left`` to ``right`` that decide them."""

    def __init__(self, words: Words):
        self.words = words
        n = len(words.starts)
        self.names, self.lo, self.hi = np.zeros(n, np.uint64), np.arange(n), np.arange(1, n + 1)
        self.left, self.right = self.lo.copy(), self.hi.copy()
        self.first = np.zeros(n, bool)  # of its document
        self.first[words.first[:-1][words.counts > 0]] = True
        self.alive = words.room < 0

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """How far left and right one must see to know the neighbours; beyond a document nothing is known."""
        before = np.concatenate([[-_FAR], self.left[:-1]])
        after = np.concatenate([self.right[1:], [_FAR]])
        return np.where(self.first, -_FAR, before), np.where(np.concatenate([self.first[1:], [True]]), _FAR, after)

    def _merge(self, start: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(start)
        self.hi = np.append(self.lo[at[1:]], self.hi[-1:])
        self.lo, self.names = self.lo[at], self.names[at]
        self.left, self.right = np.minimum.reduceat(left, at), np.maximum.reduceat(right, at)
        self.first = self.first[at]
        return at

    def run_keys(self, names: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of one word become one symbol; their keys. To be sure of a run's length one must see both neighbours."""
        start = np.ones(len(names), bool)
        start[1:] = (names[1:] != names[:-1]) | (second[1:] != second[:-1]) | self.first[1:]
        before, after = self._neighbours()
        at = self._merge(start, np.minimum(self.left, before), np.maximum(self.right, after))
        more = np.diff(np.append(at, len(start))).astype(np.uint64) - np.uint64(1)
        return names[at] + more * _STEP, second[at] ^ mix(more) * (more > 0)

    def pair_keys(self, level: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each left-hand symbol and the right-hand symbol after it become one; others must see the one they face.

        Returns the pairs inside windows that are left (their indices among the symbols) and their keys; the names
        of all pairs become 0 until they are given.
        """
        if not len(self.names):
            return np.zeros(0, np.int64), self.names, self.names
        side = mix(self.names ^ np.uint64(0x51_7C_C1_B7 * (level + 1))) & np.uint64(1)  # 0: left-hand
        joins = np.zeros(len(side), bool)
        joins[1:] = (side[:-1] == 0) & (side[1:] == 1) & ~self.first[1:] & (self.names[:-1] > 0) & (self.names[1:] > 0)
        before, after = self._neighbours()
        alone = ~joins & ~np.concatenate([joins[1:], [False]])
        left = np.where(alone & (side == 1), np.minimum(self.left, before), self.left)
        right = np.where(alone & (side == 0), np.maximum(self.right, after), self.right)
        a, b = self.names, np.concatenate([self.names[1:], [np.uint64(0)]])
        at = self._merge(~joins, left, right)
        pair = np.diff(np.append(at, len(joins))) == 2
        self.names[pair] = 0
        count = np.concatenate([[0], np.cumsum(self.alive)])
        lo, hi = np.maximum(self.right - window, 0), self.left + 1
        inside = pair & (self.left >= 0) & (self.right <= len(self.alive)) & (hi > lo)
        asked = np.flatnonzero(inside)
        asked = asked[count[hi[asked]] > count[lo[asked]]]
        return asked, a[at[asked]], b[at[asked]]

    def prune(self, window: int) -> None:
        """Windows that contain what decided a symbol without a name are no longer left."""
        dead = (self.names == 0) & (self.left >= 0) & (self.right <= len(self.alive)) & (self.right - self.left <= window)
        cover = np.zeros(len(self.alive) + 1, np.int64)
        np.add.at(cover, np.maximum(self.right[dead] - window, 0), 1)
        np.add.at(cover, self.left[dead] + 1, -1)
        self.alive &= np.cumsum(cover[:-1]) == 0


def _names_of(held: bytes) -> np.ndarray:
    """An answer of a naming round: names in key order, 0 for keys that only one document has."""
    n = int.from_bytes(held[:4], "little")
    plain = zstandard.ZstdDecompressor().decompress(held[4:])
    size = (n + 7) // 8
    shared = np.unpackbits(np.frombuffer(plain[:size], np.uint8), count=n).astype(bool)
    out = np.zeros(n, np.uint64)
    out[shared] = np.cumsum(np.frombuffer(plain[size:], np.uint64))
    return out


def _packed_names(names: np.ndarray) -> bytes:
    shared = names > 0
    steps = np.diff(names[shared], prepend=np.uint64(0))
    return len(names).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(np.packbits(shared).tobytes() + steps.tobytes())


def _played(row: dict, answers: list[dict], levels: int, window: int, further: bool = True):
    """The block's texts, and its symbols after the answered ``levels``; with ``further`` the keys of the next round.

    Returns (texts, words, word names of two salts, symbols, keys or None).
    """
    texts = B.Texts(row)
    words = find_words(texts.column, NOT_SPACE, lower=False)
    names = [span_names(words.data, words.starts, words.ends, salt) for salt in (0, 1)]
    symbols = Symbols(words)
    symbols.alive = words.room >= window
    if not len(words.starts):
        return texts, words, names, symbols, None
    known = texts.ids[words.document] != NO_ID  # a document without an id is compared with none
    symbols.alive &= known
    keys = None
    for level in range(levels + further):
        if level == 0:
            asked = slice(None)
            keys = B.Keys(*symbols.run_keys(*names))
        else:
            asked, a, b = symbols.pair_keys(level, window)
            keys = B.Keys(a, b)
        symbols.owner = np.searchsorted(words.first, symbols.lo[asked], side="right")
        if level < levels:
            given = [_names_of(x) for x in B.answers_of(answers, level)]
            symbols.names[asked] = (np.concatenate(given) if given else np.zeros(0, np.uint64))[keys.place]
            symbols.prune(window)
    return texts, words, names, symbols, keys


def _ask(level: int, buckets: int, window: int, row: dict, answers: list[dict]) -> pa.Table:
    """The keys of a round, and of each whether several documents of the block have it."""
    _, _, _, symbols, keys = _played(row, answers, level, window)
    if keys is None:
        return B.Keys(np.zeros(0, np.uint64), np.zeros(0, np.uint64)).questions(0, buckets, B.pack_whole, None)
    several = keys.reduced(np.minimum, symbols.owner) != keys.reduced(np.maximum, symbols.owner)
    return keys.questions(row["block"], buckets, B.pack_small if level else B.pack_whole, lambda lo, hi: np.packbits(several[lo:hi]).tobytes())


def _name(level: int, levels: int, buckets: int, table: pa.Table) -> pa.Table:
    """Names for the keys of a bucket that several documents have: numbers that no other bucket or level gives."""
    rows = table.to_pylist()
    held = [(B.unpack_small if level else B.unpack_whole)(r["keys"]) for r in rows]
    sizes = [len(a) for a, _ in held]
    several = np.concatenate([np.unpackbits(np.frombuffer(r["more"], np.uint8), count=n) for r, n in zip(rows, sizes)])
    keys = B.Keys(*(np.concatenate(x) for x in zip(*held)))
    shared = keys.reduced(np.add, 1 + several.astype(np.int64)) > 1
    names = np.zeros(len(shared), np.uint64)
    bucket = rows[0]["bucket"]
    names[shared] = 1 + level + levels * (bucket + buckets * np.arange(shared.sum(), dtype=np.uint64))
    ends = np.cumsum(sizes)
    out = [(r["block"], bucket, level, _packed_names(names[keys.place[hi - n : hi]])) for r, n, hi in zip(rows, sizes, ends)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), B.ANSWERS)], schema=B.ANSWERS)


def _windows(row: dict, answers: list[dict], levels: int, window: int):
    """(texts, words, first words of the windows that are left, their documents, their keys)."""
    texts, words, names, symbols, _ = _played(row, [r for r in answers if r["level"] < levels], levels, window, False)
    at = np.flatnonzero(symbols.alive)
    document = np.searchsorted(words.first, at, side="right") - 1
    return texts, words, at, document, B.Keys(*(phrase_names(names[salt], at, at + window, salt) for salt in (0, 1)))


def _ask_windows(levels: int, buckets: int, window: int, row: dict, answers: list[dict]) -> pa.Table:
    """The windows that are left, and the smallest document of the block that has each."""
    texts, _, _, document, keys = _windows(row, answers, levels, window)
    least = keys.reduced(np.minimum, texts.ids[document])
    return keys.questions(row["block"], buckets, B.pack_whole, lambda lo, hi: B.squeeze_planes(least[lo:hi]))


def _least(levels: int, table: pa.Table) -> pa.Table:
    """The smallest document of all that has each window."""
    rows = table.to_pylist()
    held = [B.unpack_whole(r["keys"]) for r in rows]
    keys = B.Keys(*(np.concatenate(x) for x in zip(*held)))
    least = keys.reduced(np.minimum, np.concatenate([B.unsqueeze_planes(r["more"], np.int64) for r in rows]))[keys.place]
    ends = np.cumsum([len(a) for a, _ in held])
    out = [(r["block"], r["bucket"], levels, B.squeeze_planes(least[hi - len(a) : hi])) for r, (a, _), hi in zip(rows, held, ends)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), B.ANSWERS)], schema=B.ANSWERS)


_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _removed(levels: int, window: int, row: dict, answers: list[dict]) -> pa.Table:
    texts, words, at, document, keys = _windows(row, answers, levels, window)
    given = [B.unsqueeze_planes(x, np.int64) for x in B.answers_of(answers, levels)]
    least = (np.concatenate(given) if given else np.zeros(0, np.int64))[keys.place]
    at = at[texts.ids[document] > least]
    cover = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    gone = np.cumsum(cover[:-1]) > 0
    raw, kept = words.data.tobytes(), []
    starts, ends = words.starts.tolist(), words.ends.tolist()
    for lo, hi in zip(words.first, words.first[1:]):
        kept.append(b" ".join([raw[starts[i] : ends[i]] for i in (np.flatnonzero(~gone[lo:hi]) + lo).tolist()]).decode())
    total = np.concatenate([[0], np.cumsum(gone)])
    ids = pa.array(texts.ids, mask=texts.ids == NO_ID)
    return pa.table([ids, pa.array(words.counts), pa.array(total[words.first[1:]] - total[words.first[:-1]]), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces, for every row of ``docs``.

    A word goes if it is in a window of ``window`` words of its document that a document with a smaller doc_id
    has too. Windows are judged on the input. Null and empty texts have no words. Rows of one doc_id are
    not smaller than one another. A row with a null doc_id is compared with none and stays whole. Only doc_id
    and text are read. Words and windows are known by names of 128 bits, symbols by numbers that Spark gives out.

    Each round and the blocks are written to the shared folder; the rounds are jobs of their own, and what is
    returned is read once more from these files, which are left there.
    """
    ship(docs.sparkSession)
    buckets = bucket_count(docs)
    blocks = B.packed(docs)
    levels = rounds + 1
    answers = None
    for level in range(levels):
        asked = B.with_answers(blocks, answers, partial(_ask, level, buckets, window), B.ASKED)
        named = materialise(B.answered(asked, partial(_name, level, levels, buckets)), "names")
        answers = named if answers is None else answers.unionByName(named)
    asked = B.with_answers(blocks, answers, partial(_ask_windows, levels, buckets, window), B.ASKED)
    least = materialise(B.answered(asked, partial(_least, levels)), "least")
    return B.with_answers(blocks, answers.unionByName(least), partial(_removed, levels, window), _KEPT)


def digest(kept: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
