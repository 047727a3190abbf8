"""A hash exchange of packed arrays.

Tasks often must bring equal 64-bit names of all documents together. One Spark row for each name would spend
microseconds where the arrays need nanoseconds, so a row carries all names that a block of documents has in a
bucket of the name space. Spark shuffles and groups the rows; a bucket holds names by hash, so it is even
unless one name makes up much of the input, and callers combine equal names of a block first where they can.
"""

from __future__ import annotations

import numpy as np


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each name, from its upper 32 bits."""
    return (((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def by_bucket(names: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that brings the names of a bucket together and keeps theirs, and (bucket, from, to) of each."""
    bucket = bucket_of(names, buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
    held = bucket[order]
    cuts = np.flatnonzero(np.diff(held, prepend=-1, append=-1)) if len(held) else np.zeros(0, np.int64)
    return order, [(int(held[lo]), int(lo), int(hi)) for lo, hi in zip(cuts, cuts[1:])]


def joined(parts: list[bytes], kind: type | np.dtype) -> np.ndarray:
    """Packed arrays of several rows as one array."""
    held = b"".join(parts)
    return np.frombuffer(held, kind) if held else np.zeros(0, kind)
