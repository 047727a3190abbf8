"""SQL that several oracles share."""

from __future__ import annotations

POLYNOMIAL = 0xEDB88320
#: Bytes that are reduced as one piece.
PIECE = 256


def _after(register: int, zeros: int) -> int:
    """The CRC-32 register after as many zero bytes."""
    for _ in range(8 * zeros):
        register = (register >> 1) ^ (POLYNOMIAL * (register & 1))
    return register


def _opening() -> str:
    """Four bytes, in hex, that bring an empty register to the one that CRC-32 begins with."""
    register = 0xFFFFFFFF
    for _ in range(32):  # backwards
        high = register >> 31
        register = (((register ^ (POLYNOMIAL * high)) << 1) | high) & 0xFFFFFFFF
    return register.to_bytes(4, "little").hex()


def _mapped(value: str, images: list[int]) -> str:
    """The xor of the images of the bits that are set."""
    out = "0"
    for i, image in enumerate(images):
        out = f"xor({out}, (({value} >> {i}) & 1) * {image})"
    return out


def crc32_ctes(name: str, source: str) -> str:
    """CTEs that end in ``name`` (k, crc): the unsigned CRC-32 of the UTF-8 bytes of the texts of ``source`` (k, t), null as empty.

    ``k`` must be a key. Texts are cut into pieces, with zeros in front, which change nothing; each is reduced byte by
    byte, and pieces are put together by what their length does to a register.
    """
    step = f"xor(c >> 8, {_mapped('xor(c, b)', [_after(1 << i, 1) for i in range(8)])})"
    put = f"xor({_mapped('a', [_after(1 << i, PIECE) for i in range(32)])}, b)"
    octets = f"list_transform(range(0, {PIECE}), lambda i: ('0x' || substr(piece, 2 * i + 1, 2))::bigint)"
    return f"""{name}_h AS (SELECT k, '{_opening()}' || hex(encode(coalesce(t, ''))) AS h FROM ({source})),
{name}_p AS (SELECT k, p, substr(h, {2 * PIECE} * p + 1, {2 * PIECE}) AS piece FROM (SELECT k, h, unnest(range(0, length(h) // {2 * PIECE})) AS p
  FROM (SELECT k, lpad(h, (length(h) + {2 * PIECE - 1})::int // {2 * PIECE} * {2 * PIECE}, '0') AS h FROM {name}_h))),
{name}_r AS (SELECT k, p, list_reduce(list_concat([0::bigint], {octets}), lambda c, b: {step}) AS c FROM {name}_p),
{name} AS (SELECT k, xor(list_reduce(list(c ORDER BY p), lambda a, b: {put}), 4294967295) AS crc FROM {name}_r GROUP BY k)"""
