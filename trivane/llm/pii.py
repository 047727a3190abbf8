"""Personal data: exact patterns, and what a character tagger finds beside them.

The patterns give the base spans. The tagger (``tagger.Tagger``) is trained on labelled spans: sentences of
invented words with personal data in usual and unusual writings, and with numbers that are none. It reads
overlapping windows around every digit, at sign, "(at)" and "[at]" of a text. The spans of all windows are reconciled over the
whole document: of a span that two windows see, the one further from a window's border counts, base spans stay,
and a found span must not touch another, and must hold what its kind needs (a card's check digit, a phone
number's digits, and so on).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trivane.llm.tagger import Tagger, character_ids
from trivane.llm.words import text_slices
from trivane.llm.workspace import ship

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 96, 48
#: Windows that the tagger reads together.
TOGETHER = 512

#: Every span that holds has one of these, so no other window can add a span.
_CUE = re.compile(r"[0-9@]|\(at\)|\[at\]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str]


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(doubled) + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the at signs, so that long words cost no more than their length."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str | None) -> list[Span]:
    """(start, end, kind) of the patterns' matches, by start and kind."""
    if not text or not _CUE.search(text):
        return []
    found = [(s, e, 0) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = digits_of(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            found.append((m.start(), m.end(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+")
_SPELLED_IP = re.compile(r"[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}")


def holds(kind: str, text: str) -> bool:
    """Whether a found span has what its kind needs."""
    digits = digits_of(text)
    if kind == "email":
        return bool(_SPELLED.fullmatch(text))
    if kind == "ip":
        return bool(_SPELLED_IP.fullmatch(text)) and all(int(x) <= 255 for x in re.findall("[0-9]+", text))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 ./-]", text)
    groups = re.findall("[0-9]+", text)
    return 10 <= len(digits) <= 15 and len(groups) >= 3 and not re.search(r"[^0-9 ()./+-]", text) and not re.match(r"[0-9]{4}[-./][0-9]{2}[-./][0-9]{2}", text)


def labelled_sentences(count: int = 900, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Sentences of invented words with labelled spans, and others with numbers that are no personal data."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiounrstlmdhcgpéäñß") for _ in range(rng.randint(1, 9)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    plain = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 7)))

    def card() -> str:
        body = number(15)
        check = next(d for d in "0123456789" if luhn(body + d))
        digits, gap = body + check, rng.choice(["", "", " ", "-", ".", "  "])
        return gap.join(digits[i : i + 4] for i in range(0, 16, 4)) if gap else digits

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        body = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}"])
        return rng.choice(["+1 ", f"+{number(2)} ", "", ""]) + body

    def ip() -> str:
        dot = rng.choice([".", ".", ".", "[.]"])
        return dot.join(str(rng.randint(0, 255)) for _ in range(4))

    def email() -> str:
        at, dot = rng.choice([("@", "."), ("@", "."), ("@", "."), (" @ ", "."), ("(at)", "."), ("[at]", "[dot]")])
        return plain() + rng.choice(["", ".", "_"]) + rng.choice(["", number(2)]) + plain() + at + plain() + rng.choice(["", number(1)]) + dot + rng.choice(["com", "org", "net", "example.com"])

    def none() -> str:
        return rng.choice([
            number(rng.randint(1, 8)), number(rng.randint(9, 20)), f"20{number(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}",
            "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 32, 40]))), f"{number(1)}.{number(1)}", f"{number(1)}.{number(2)}.{number(1)}",
            f"{number(2)}:{number(2)}", f"{number(3)} 000", f"{number(2)}%", f"@{plain()}", f"{number(3)}-{number(2)}", f"{number(1)},{number(3)},{number(3)}",
        ])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for i in range(count):
        text, spans = "", []
        while len(text) < WIDTH + 10:
            text += " ".join(word() for _ in range(rng.randint(1, 6))) + rng.choice([" ", " ", ". ", ", ", ": ", "\n"])
            kind = rng.choice([*KINDS, "none", "none"])
            piece = none() if kind == "none" else makers[kind]()
            if kind != "none":
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece + rng.choice([" ", " ", ". ", ", ", "### "])
        shift = rng.randint(0, max(0, len(text) - WIDTH))
        out.append((text[shift : shift + WIDTH], [(max(0, s - shift), min(WIDTH, e - shift), k) for s, e, k in spans if s - shift < WIDTH and e - shift > 0]))
    return out


def train(sentences: list[tuple[str, list[Span]]], epochs: int = 10) -> Tagger:
    """A tagger of windows of WIDTH characters; tag 0 is outside, 2k + 1 begins kind k and 2k + 2 goes on in it."""
    ids, gold = np.zeros((len(sentences), WIDTH), np.int64), np.zeros((len(sentences), WIDTH), np.int64)
    for n, (text, spans) in enumerate(sentences):
        own = character_ids(text[:WIDTH])
        ids[n, : len(own)] = own
        for start, end, kind in spans:
            k = KINDS.index(kind)
            gold[n, start:end] = 2 * k + 2
            gold[n, start : start + 1] = 2 * k + 1
    tagger = Tagger(2 * len(KINDS) + 1)
    tagger.train(ids, gold, epochs=epochs)
    return tagger


@cache
def default_tagger() -> Tagger:
    """The tagger of the default sentences, trained once in a process."""
    return train(labelled_sentences())


def window_starts(text: str) -> list[int]:
    """Where windows begin: all multiples of STRIDE from which a window holds the start of a cue."""
    at = sorted({m.start() // STRIDE for m in _CUE.finditer(text)})
    return sorted({STRIDE * x for k in at for x in (k - 1, k) if x >= 0})


def spans_of_tags(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the spans in one window's tags."""
    out, start, kind = [], -1, -1
    for i, tag in enumerate([*tags.tolist(), 0]):
        k = (tag - 1) // 2 if tag else -1
        if start >= 0 and (k != kind or tag % 2 == 1):
            out.append((start, i, kind))
            start = -1
        if k >= 0 and start < 0:
            start, kind = i, k
    return out


def reconcile(text: str, base: list[Span], seen: list[tuple[int, int, int, int]]) -> list[Span]:
    """Base spans, and of the spans (start, end, kind, distance to its window's border) those that hold beside them."""
    taken = bytearray(len(text))  # a mark for each character of a span
    for start, end, _ in base:
        taken[start:end] = b"\1" * (end - start)
    out = list(base)
    for start, end, k, _ in sorted(set(seen), key=lambda x: (-x[3], x[0], x[1], x[2])):
        end = min(end, len(text))
        while end > start and text[end - 1] in " .,;:\n":
            end -= 1
        while end > start and text[start] in " .,;:\n":
            start += 1
        if end > start and taken.find(1, start, end) < 0 and holds(KINDS[k], text[start:end]):
            beside = text[start - 1 : start] + text[end : end + 1]
            if not any(c.isalnum() or c == "@" for c in beside):
                taken[start:end] = b"\1" * (end - start)
                out.append((start, end, KINDS[k]))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_all(texts: list[str | None], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    seen: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    places: list[tuple[int, int]] = []
    rows: list[np.ndarray] = []

    def flush() -> None:
        if rows:
            for (d, start), tags in zip(places, tagger.decode(np.stack(rows))):
                for s, e, k in spans_of_tags(tags):
                    seen[d].append((start + s, start + e, k, min(s, WIDTH - e)))
        places.clear()
        rows.clear()

    for d, text in enumerate(texts):
        if text and _CUE.search(text):
            for start in window_starts(text):
                own = character_ids(text[start : start + WIDTH])
                places.append((d, start))
                rows.append(np.pad(own, (0, WIDTH - len(own))))
                if len(rows) == TOGETHER:
                    flush()
    flush()
    return [(b, reconcile(t or "", b, s)) for t, b, s in zip(texts, base, seen)]


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span as <KIND>; spans that overlap become one, named by the first."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_FOUND = "base array<struct<start:long,end:long,kind:string>>, spans array<struct<start:long,end:long,kind:string>>, redacted string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _find(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch, "_text"):
            texts = piece.column("_text").to_pylist()
            found = find_all(texts, model.value)
            lists = [pa.array([[dict(zip(("start", "end", "kind"), x)) for x in f[i]] for f in found], _SPANS) for i in (0, 1)]
            kept = piece.drop_columns(["_text"])
            clean = pa.array([redacted(t, f[1]) for t, f in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([*kept.columns, *lists, clean], [*kept.schema.names, "base", "spans", "redacted"])


def find(docs: DataFrame, tagger: Tagger, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row with the personal data of its whole text.

    Adds base (the patterns' spans), spans (with what the tagger adds; start and end in code points, end exclusive)
    and redacted (the text with <KIND> for each span). A null text has no spans and stays null; an empty one stays
    empty. Repeated rows are all read. ``keep`` must not name the added columns.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(tagger)  # some ten thousand weights
    rows = docs.select(*keep, docs["text"].alias("_text"))
    schema = ", ".join([f"`{n}` {t}" for n, t in rows.drop("_text").dtypes] + [_FOUND])
    return rows.mapInArrow(partial(_find, model), schema)


def joined(spans: list[dict]) -> str:
    return ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in spans)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, spans = batch.column("base").to_pylist(), batch.column("spans").to_pylist()
        counts = [pa.array([sum(x["kind"] == kind for x in b) for b in base], pa.int64()) for kind in KINDS]
        shas = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, shas, pa.array([joined(s) for s in spans], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return found.select("doc_id", "base", "spans").mapInArrow(_digest, f"doc_id long, {counts}, base_sha256 string, spans string")
