"""Words of whole text columns as numpy arrays: positions, 64-bit names, phrases.

A batch of texts is one byte buffer with document offsets. Everything here is a pass over such a buffer,
so that a word costs some nanoseconds and no Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer text is handled whole.
SLICE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes: all but space and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False

#: Word bytes: 0-9, a-z and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers_of(base: int):
    inverse = pow(base, -1, 1 << 64)
    kept: list[np.ndarray] = []

    def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        if not kept or len(kept[0]) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
            up[0] = down[0] = 1
            kept[:] = [np.cumprod(up), np.cumprod(down)]
        return kept[0], kept[1]

    return powers


#: Two bases, so that a phrase can have two names that nothing ties together.
word_powers = (_powers_of(0xA0761D6478BD642F), _powers_of(0xE7037ED1A0B428DB))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in slices of about ``most`` bytes of text; a text is never cut."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(lengths) - lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(lengths)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one more entry at the end). Null is empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice: ``data[starts[i]:ends[i]]`` is word i; document d has words ``first[d]`` to ``first[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @property
    def room(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))


def find_words(column: pa.Array, kind: np.ndarray, lower: bool) -> Words:
    """Words of every text of ``column``: longest runs of the bytes of ``kind``."""
    data, offsets = text_buffer(column)
    if lower:
        data = LOWER[data]
    inside = kind[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | begins[:-1]))
    ends = np.flatnonzero(inside & (~after | begins[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def blocks_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as one number, zeros beyond its end; a view of a padded copy."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _first_bytes(blocks: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The blocks without what lies beyond their ``left`` first bytes (one at least)."""
    return blocks & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)))


def _inner_blocks(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of spans of over eight bytes: (their indices, where each one's blocks begin, number of each block, its place)."""
    long = np.flatnonzero(lengths > 8)
    each = (lengths[long] - 1) // 8
    begin = np.cumsum(each) - each
    number = np.arange(each.sum()) - np.repeat(begin, each) + 1
    return long, begin, number, np.repeat(starts[long], each) + 8 * number


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit name for each byte span, none of them empty; equal bytes have equal names in every task.

    Blocks of eight bytes are mixed with their number before they are added up, so that no regular text gives
    equal sums. Names by two salts are as good as one of 128 bits.
    """
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.uint64)
    blocks, key = blocks_at(data), np.uint64((2 * salt + 1) * 0xD6E8FEB86659FD93 % 2**64)
    sums = mix(_first_bytes(blocks[starts], lengths) ^ key)
    long, begin, number, at = _inner_blocks(starts, lengths)
    if len(long):
        left = np.repeat(lengths[long], np.diff(np.append(begin, len(number)))) - 8 * number
        sums[long] += np.add.reduceat(mix(_first_bytes(blocks[at], left) ^ mix(key + number.astype(np.uint64))), begin)
    return mix(sums + lengths.astype(np.uint64) * _STEP)


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Whether span i of ``data`` and span i of ``other`` are the same bytes; none is empty."""
    lengths = ends - starts
    same = lengths == until - at
    kept = np.flatnonzero(same)
    starts, at, lengths = starts[kept], at[kept], lengths[kept]
    a, b = blocks_at(data), blocks_at(other)
    good = _first_bytes(a[starts] ^ b[at], lengths) == 0
    long, begin, number, place = _inner_blocks(starts, lengths)
    if len(long):
        sizes = np.diff(np.append(begin, len(number)))
        differ = _first_bytes(a[place] ^ b[np.repeat(at[long], sizes) + 8 * number], np.repeat(lengths[long], sizes) - 8 * number) != 0
        good[long] &= ~np.logical_or.reduceat(differ, begin)
    same[kept] = good
    return same


def phrase_names(names: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit name for each run ``names[lo[i]:hi[i]]`` of a few names; equal runs have equal names in every task.

    With names and phrase names of two salts a run is named by 128 bits.
    """
    up, down = word_powers[salt](len(names) + 1)
    sums = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(mix(names) * up[: len(names)], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64) * _STEP)
