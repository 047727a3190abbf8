"""Byte-level BPE by prefix-sharing trie traversal.

The last token of the encoding of a prefix decides how it goes on: a token t that ends a longer prefix is its
last token exactly if the last token of what stands before t and t itself would not be merged across their
border. So the distinct words of a batch are put into a trie (here: sorted, which is the trie's depth-first
order), each node keeps the last token of its prefix, and shared prefixes are computed once. A word's
encoding is read back along the last tokens.

Words are found as the tokenizer's pattern does, but for a whole buffer of texts at once.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from trivane.llm.words import same_spans, span_names, text_buffer

#: The characters with Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What the pattern splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

OTHER, SPACE, LETTER, NUMBER = range(4)


def character_classes() -> np.ndarray:
    """The pattern's class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first == "L":
            out[c] = LETTER
        elif first == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(extra)) for b in range(256)]


class Vocabulary:
    """Tokens as bytes, and whether two tokens may stand side by side in an encoding."""

    #: Answers about pairs of tokens that are kept.
    pairs_kept = 500_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        self.added = {t["content"].encode(): t["id"] for t in model.get("added_tokens", [])}
        vocab = model["model"]["vocab"]
        as_bytes = lambda token: bytes(to_byte[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in vocab.items() if t not in {c.decode() for c in self.added}}
        self.parts: dict[int, tuple[int, int]] = {}  # the two tokens that a token was merged from
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.merged[pair] = rank
            if whole not in self.rank:
                self.parts[whole], self.rank[whole] = pair, rank
        self.bytes = [b""] * (max([*self.ids.values(), *self.added.values()]) + 1)
        for t, i in [*self.ids.items(), *self.added.items()]:
            self.bytes[i] = t
        self.prefixes = {t[:i] for t in self.ids for i in range(1, len(t) + 1)}
        self._fits: dict[int, bool] = {}
        self._states: dict[bytes, int] = {b"": 0}  # each is a prefix of a token, and the longest that ends a text
        self._texts: list[bytes] = [b""]
        self._ends: list[tuple[tuple[int, int], ...]] = [()]  # (token, bytes) of all tokens that end it, longest first
        self._steps: dict[int, int] = {}

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte; states are made as they are met."""
        text = self._texts[state] + bytes([byte])
        while text and text not in self.prefixes:
            text = text[1:]
        new = self._states.get(text)
        if new is None:
            new = self._states[text] = len(self._texts)
            self._texts.append(text)
            tails = (text[i:] for i in range(len(text)))
            self._ends.append(tuple((self.ids[t], len(t)) for t in tails if t in self.ids))
        self._steps[state << 8 | byte] = new
        return new

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between two tokens.

        The border falls if, while both sides are still in pieces, a merge across it comes before the merges that
        built the pieces beside it. So the newer of both sides is taken apart again and again, and the pair at the
        border must never merge before what was taken apart.
        """
        known = self._fits.get(left << 20 | right)
        if known is None:
            a, b, limit, known = left, right, len(self.merged), True
            while True:
                across = self.merged.get((a, b))
                if across is not None and across < limit:
                    known = False
                    break
                newest_a, newest_b = self.rank.get(a, -1), self.rank.get(b, -1)
                if newest_a < 0 and newest_b < 0:
                    break
                if newest_a > newest_b:
                    # merges of one rank run from the left, so an equal pair across the border comes after
                    limit, a = newest_a, self.parts[a][1]
                else:
                    limit, b = newest_b + 1, self.parts[b][0]
            if len(self._fits) >= self.pairs_kept:
                self._fits.clear()
            self._fits[left << 20 | right] = known
        return known

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of distinct words in ascending order, by depth-first traversal of their trie."""
        out, path = [], b""
        last, states = [0], [0]  # last[i]: the last token of path[:i]; states[i]: the automaton's state there
        fits, steps, all_ends, held = self._fits, self._steps, self._ends, self.bytes
        for word in words:
            shared, top = 0, min(len(path), len(word))
            if path[:top] == word[:top]:
                shared = top
            else:
                while path[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state, end = states[-1], shared
            for byte in word[shared:]:
                end += 1
                following = steps.get(state << 8 | byte)
                state = self.step(state, byte) if following is None else following
                for token, size in all_ends[state]:
                    if size == end:
                        break
                    left = last[end - size]
                    good = fits.get(left << 20 | token)
                    if self.fits(left, token) if good is None else good:
                        break
                last.append(token)
                states.append(state)
            path = word
            tokens, at = [], len(word)
            while at:
                tokens.append(last[at])
                at -= len(held[last[at]])
            out.append(tokens[::-1])
        return out


@dataclass
class Pieces:
    """Words of the pattern and added tokens: byte spans, and how many stand in each document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    added: np.ndarray  # ids of added tokens, -1 for words


def split(column: pa.Array, classes: np.ndarray, added: dict[bytes, int]) -> Pieces:
    """Cut every text as the pattern does; added tokens are cut out first, wherever they stand."""
    data, offsets = text_buffer(column)
    raw = data.tobytes()
    marks: list[tuple[int, int, int]] = []
    for token, i in added.items():
        at = raw.find(token)
        while at >= 0:
            if offsets[np.searchsorted(offsets, at, side="right")] >= at + len(token):
                marks.append((at, at + len(token), i))
                at = raw.find(token, at + len(token))
            else:
                at = raw.find(token, at + 1)
    marks.sort()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes[points]
    n = len(points)
    fence = np.zeros(n + 1, bool)  # a text or added token begins here, so nothing reaches across
    fence[np.searchsorted(lead, offsets)] = True
    for lo, hi, _ in marks:
        fence[np.searchsorted(lead, [lo, hi])] = True
    space = kind == SPACE
    blank = points == 0x20
    start = np.zeros(n, bool)
    if n:
        start[0] = True
        a, b = kind[:-1], kind[1:]
        after_space = (a == SPACE) & (b != SPACE)
        start[1:] = (a != b) & ~(after_space & blank[:-1])
        # the last of several white-space characters before a word stands alone or goes with the word
        start[1:-1] |= space[:-2] & space[1:-1] & ~space[2:] & ~fence[2:-1]
        start |= fence[:-1]
        # an apostrophe that begins a piece takes the letters of a contraction with it
        quote = np.flatnonzero(points == 0x27)
        if len(quote):
            before = quote - 1
            free = fence[quote] | ((kind[before] != OTHER) & ~blank[before])
            quote = quote[free]
            padded = np.concatenate([points, np.zeros(2, np.uint32)])
            limit = np.concatenate([fence, [True, True]])
            for text in CONTRACTIONS:
                hit = quote[(padded[quote + 1] == ord(text[0])) & ~limit[quote + 1]]
                if len(text) == 2:
                    hit = hit[(padded[hit + 2] == ord(text[1])) & ~limit[hit + 2]]
                start[hit] = True
                start[hit + 1] = False
                nxt = hit + 1 + len(text)
                if len(text) == 2:
                    start[hit + 2] = False
                nxt = nxt[nxt < n]
                # a blank after it begins a piece anyway; a letter or apostrophe does so now
                start[nxt] = True
    at = np.flatnonzero(start)
    starts = lead[at] if n else np.zeros(0, np.int64)
    for lo, hi, _ in marks:  # nothing is cut inside an added token
        inside = (starts > lo) & (starts < hi)
        starts = starts[~inside]
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    ids = np.full(len(starts), -1, np.int64)
    for lo, _, i in marks:
        ids[np.searchsorted(starts, lo)] = i
    return Pieces(data, starts, ends, np.diff(np.searchsorted(starts, offsets)), ids)


class Encoder:
    """Texts to token ids and back. Encodings of words met before are kept, up to ``room`` words.

    Words are found among those kept by 64-bit names, and then their bytes are compared.
    """

    def __init__(self, path: str, room: int = 1_000_000, vocabulary=None, name=span_names):
        self.vocabulary, self.classes, self.room, self.name = vocabulary or Vocabulary(path), character_classes(), room, name
        self.forget()

    def forget(self) -> None:
        self.names = np.zeros(0, np.uint64)  # ascending, with the place of each word's ids in ``flat`` and bytes in ``raw``
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.starts, self.ends, self.raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _encodings(self, pieces: Pieces, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces ``at`` in another order, how many ids each has, their ids)."""
        raw = pieces.data.tobytes()
        ordinary, special = at[pieces.added[at] < 0], at[pieces.added[at] >= 0]
        words = [raw[s:e] for s, e in zip(pieces.starts[ordinary].tolist(), pieces.ends[ordinary].tolist())]
        order = sorted(range(len(words)), key=words.__getitem__)
        encoded = self.vocabulary.encode_words([words[i] for i in order])
        encoded += [[int(pieces.added[i])] for i in special]
        return np.concatenate([ordinary[order], special]), np.array([len(x) for x in encoded], np.int64), np.array([t for x in encoded for t in x], np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has). Null is empty."""
        pieces = split(column, self.classes, self.vocabulary.added)
        if not len(pieces.starts):
            return np.zeros(0, np.int32), np.zeros(len(pieces.counts), np.int64)
        names = self.name(pieces.data, pieces.starts, pieces.ends)
        distinct, first, place = np.unique(names, return_index=True, return_inverse=True)
        alike = same_spans(pieces.data, pieces.starts, pieces.ends, pieces.data, pieces.starts[first][place], pieces.ends[first][place])
        known = np.minimum(np.searchsorted(self.names, distinct), max(0, len(self.names) - 1))
        held = self.names[known] == distinct if len(self.names) else np.zeros(len(distinct), bool)
        old = first[held]
        if not alike.all() or not same_spans(pieces.data, pieces.starts[old], pieces.ends[old], self.raw, self.starts[known[held]], self.ends[known[held]]).all():
            return self._encode_each(pieces)  # two words of one name
        new = first[~held]
        if len(new):
            if len(self.names) and len(self.names) + len(new) > self.room:
                self.forget()
                return self.encode(column)
            rows, size, flat = self._encodings(pieces, new)
            self._keep(pieces, names, rows, size, flat)
            known = np.searchsorted(self.names, distinct)
        own = known[place]
        return self._laid_out(pieces, self.at[own], self.size[own], self.flat)

    def _keep(self, pieces: Pieces, names: np.ndarray, rows: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        order = np.argsort(names[rows], kind="stable")
        where = np.searchsorted(self.names, names[rows][order])
        length = pieces.ends[rows] - pieces.starts[rows]
        until = len(self.raw) + np.cumsum(length)
        put = lambda kept, values: np.insert(kept, where, values[order])
        self.at, self.size = put(self.at, len(self.flat) + np.cumsum(size) - size), put(self.size, size)
        self.starts, self.ends = put(self.starts, until - length), put(self.ends, until)
        self.names, self.flat = put(self.names, names[rows]), np.concatenate([self.flat, flat])
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        self.raw = np.concatenate([self.raw, pieces.data[np.repeat(pieces.starts[rows], length) + inner]])

    def _encode_each(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with words known by their bytes alone."""
        raw, seen = pieces.data.tobytes(), {}
        place = np.array([seen.setdefault(raw[s:e], i) for i, (s, e) in enumerate(zip(pieces.starts.tolist(), pieces.ends.tolist()))], np.int64)
        rows, size, flat = self._encodings(pieces, np.unique(place))
        at, sizes = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        at[rows], sizes[rows] = np.cumsum(size) - size, size
        return self._laid_out(pieces, at[place], sizes[place], flat)

    @staticmethod
    def _laid_out(pieces: Pieces, at: np.ndarray, size: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each text has."""
        ends = np.cumsum(size)
        ids = flat[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pieces.counts)])]
        return ids, np.diff(bounds)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        held = self.vocabulary.bytes
        return b"".join([held[i] for i in ids]).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file; it stays with the worker from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
