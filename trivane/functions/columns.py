"""Column functions: numbers, hashes, strings and embedding energies, all inside Spark's own expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cantor(a: Column, b: Column) -> Column:
    """Exact Cantor pairing of two longs from 0, as long as it fits in one."""
    total = a.cast("long") + b.cast("long")
    even = F.when(total % 2 == 0, F.shiftright(total, 1) * (total + 1)).otherwise(total * F.shiftright(total + 1, 1))
    return even + b.cast("long")


def cantor_real(a: Column, b: Column) -> Column:
    total = a.cast("double") + b.cast("double")
    return total * (total + 1) / 2 + b


def f1(precision: Column, recall: Column) -> Column:
    """The harmonic mean; 0 if both are 0."""
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def ratio(part: Column, whole: Column) -> Column:
    """A share that is 0 where there is nothing to share."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def hash_order(seed: int | str, *keys: Column) -> Column:
    """Deterministic randomness: rows in the order of this text are shuffled alike in any engine and partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_int(seed: int | str, *keys: Column) -> Column:
    """A number from 0 to 2**32 - 1."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("long")


def stripped(text: Column | str) -> Column:
    """The text without white space at its ends."""
    return F.trim(text, F.lit(" \t\r\n\f\x0b"))


def lenient_int(text: Column) -> Column:
    """The number that a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(F.trim(text), r"^([+-]?\d+)", 1).try_cast("long"), F.lit(0))


def lenient_float(text: Column) -> Column:
    found = F.regexp_extract(F.trim(text), r"^([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def url_decoded(text: Column) -> Column:
    """Percent escapes decoded; a plus sign stays one."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def not_a_number_to_null(text: Column) -> Column:
    return F.when(F.lower(F.trim(text)) != "nan", text)


def without(text: Column, *parts: str) -> Column:
    """The text without the first occurrence of each part, wherever it stands."""
    for part in parts:
        text = F.transform(F.array(text), _cutter(part))[0]  # so the text is computed once for each part
    return text


def _cutter(part: str) -> Callable[[Column], Column]:
    def cut(text: Column) -> Column:
        at = F.instr(text, part)
        return F.when(at > 0, F.concat(text.substr(F.lit(1), at - 1), text.substr(at + len(part), F.length(text)))).otherwise(text)

    return cut


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def length(differences: Column, distance: str) -> Column:
    """The sum of absolute values (L1) or of squares (L2)."""
    if distance == "L1":
        return _sum(F.transform(differences, F.abs))
    if distance == "L2":
        return _sum(F.transform(differences, lambda x: x * x))
    raise ValueError(f"unknown distance: {distance}")


def transe_energy(h: Column, r: Column, t: Column, distance: str = "L1") -> Column:
    """Sum of |t - (h + r)|, or of its squares without a root."""
    moved = F.zip_with(h, r, lambda x, y: x + y)
    return length(F.zip_with(t, moved, lambda x, y: x - y), distance)


def transh_energy(h: Column, r: Column, t: Column, w: Column) -> Column:
    """Head and tail projected off the hyperplane with normal w; always the sum of absolute differences."""
    on_t, on_h = dot(w, t), dot(w, h)
    flat_t = F.zip_with(t, w, lambda x, y: x - on_t * y)
    flat_h = F.zip_with(h, w, lambda x, y: x - on_h * y)
    return _sum(F.transform(F.zip_with(F.zip_with(flat_t, flat_h, lambda x, y: x - y), r, lambda x, y: x - y), F.abs))


def times(matrix: Column, vector: Column) -> Column:
    return F.transform(matrix, lambda row: dot(row, vector))


def stranse_energy(h: Column, r: Column, t: Column, w1: Column, w2: Column, distance: str = "L1") -> Column:
    """Length of W1 h + r - W2 t: a sum, or a root of the sum of squares."""
    moved = F.zip_with(times(w1, h), r, lambda x, y: x + y)
    found = length(F.zip_with(moved, times(w2, t), lambda x, y: x - y), distance)
    return F.sqrt(found) if distance == "L2" else found


#: Energies beyond which a triple counts as false.
MAX_ENERGY = {("transe", "L1"): 10.0, ("transe", "L2"): 1.0, ("transh", "L1"): 10.0, ("transh", "L2"): 10.0}


def max_energy(method: str, distance: str) -> float:
    try:
        return MAX_ENERGY[method.lower(), distance]
    except KeyError:
        raise ValueError(f"no maximum energy for {method} with {distance}") from None


#: Energies by method: a function of the columns h, r, t and the relation's weights. Others may be added.
METHODS: dict[str, Callable[..., Column]] = {
    "transe": lambda distance, h, r, t, **_: transe_energy(h, r, t, distance),
    "transh": lambda distance, h, r, t, w=None, **_: transh_energy(h, r, t, w),
    "stranse": lambda distance, h, r, t, w1=None, w2=None, **_: stranse_energy(h, r, t, w1, w2, distance),
}


@contextmanager
def added_method(name: str, energy: Callable[..., Column]) -> Iterator[None]:
    """A method that is known only inside the block, in which plans are made that use it."""
    if name in METHODS:
        raise ValueError(f"there is a method {name} already")
    METHODS[name] = energy
    try:
        yield
    finally:
        del METHODS[name]


def energy(method: str, distance: str, **columns: Column) -> Column:
    if method.lower() not in METHODS:
        raise ValueError(f"unknown method: {method}")
    return METHODS[method.lower()](distance, **columns)


def method_of_path(path: str) -> tuple[str, str]:
    """(method, distance) from an embedding folder's name such as ``TransE_data_[size:100,distance:1]``."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    method = next((m for m in ("STransE", "TransE", "TransH") if name.startswith(m)), None)
    number = re.search(r"distance:(\d)", name)
    if method is None or number is None:
        raise ValueError(f"method or distance are not in the name: {name}")
    return method.lower(), {"0": "L1", "1": "L2"}[number[1]]
