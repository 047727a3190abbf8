"""Language identification by compression with per-language zstandard dictionaries.

A language's dictionary is raw text of labelled documents, all dictionaries of one size. Texts are lower-cased
and anything but letters becomes a space. A text is compressed in chunks against each dictionary; the language whose
dictionary gives the smallest size is chosen. The margin to the second smallest, in proportion to it, is the
confidence, and a text whose margin is narrow is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.workspace import ship

#: The bounded sample that dictionaries are made of: documents for each language, and characters in a row of each.
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS = 64, 3000
#: Bytes of a dictionary, and of a chunk that is compressed against it.
DICTIONARY, CHUNK = 64 << 10, 8 << 10
#: Languages that are learned at most.
LANGUAGES = 256
#: A language with less text of its own does not shorten the dictionaries of others.
USEFUL = 16 << 10
#: Greedy matching of four bytes or more with small tables: about as exact here as slower settings.
PARAMETERS = dict(window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY)
#: A text is accepted if the best size is smaller than the second by this share at least.
MIN_MARGIN = 0.002

NO_LETTERS = re.compile(r"[\W\d_]+")
SENTENCE = re.compile(r"[\n.]+")


def plain(text: str) -> str:
    """Lower-case letters, and one space for all that stands between."""
    found = NO_LETTERS.sub(" ", text.lower()).strip()
    if found and not found.replace(" ", "").isalpha():  # it has numbers beyond the decimal digits
        found = " ".join("".join(c if c.isalpha() else " " for c in found).split())
    return found


def learn(labelled: DataFrame, documents: int = SAMPLE_DOCUMENTS, characters: int = SAMPLE_CHARACTERS, languages: int = LANGUAGES) -> dict[str, bytes]:
    """A dictionary for each language from (doc_id, text, lang).

    Copies of a text count once for a language. A sentence is taken once for a language, and not at all if sampled
    documents of another language have it too, as licence lines do. All dictionaries are as long as the shortest, but
    a language with less than USEFUL bytes (and less than half of the longest) does not count for that length: its
    dictionary is all it has. A language of less than eight bytes is not learned.

    Of more than ``languages`` languages those of the most documents are learned, ties by name: each text is compressed once
    for each. The texts of a language are thinned by their hash to about twice ``documents``, and of each ``characters`` in a row
    are taken, from a place that its hash gives. So what comes to the driver is bounded by languages x documents x
    characters, however many rows there are.
    """
    rows = labelled.select(F.xxhash64("text").alias("h"), "lang", "text").filter("lang is not null and text is not null and text != ''")
    counts = rows.groupBy("lang").agg(F.count_distinct("h").alias("n"))
    few = counts.orderBy(F.desc("n"), "lang").limit(languages).collect()
    counts = F.broadcast(labelled.sparkSession.createDataFrame(few, counts.schema))  # so the texts are not shuffled
    share = F.least(F.lit(1.0), F.lit(2.0 * documents) / F.col("n"))
    thinned = rows.join(counts, "lang").filter(F.pmod(F.col("h"), F.lit(1 << 30)) < (share * (1 << 30)).cast("long"))
    start = 1 + F.pmod(F.shiftright("h", 30), F.greatest(F.length("text") - characters + 1, F.lit(1)))  # anywhere in the text
    some = thinned.select("h", "lang", F.substring("text", start.cast("int"), F.lit(characters)).alias("text"))
    picked = some.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    sentences: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["h"])):
        held = sentences.setdefault(r["lang"], [])
        if len(held) < documents:
            held.append(r["text"])
    once = {lang: dict.fromkeys(plain(x) for t in sentences[lang] for x in SENTENCE.split(t)) for lang in sorted(sentences)}
    seen = Counter(x for held in once.values() for x in held)
    own = {lang: " ".join(x for x in held if x and seen[x] == 1).encode() for lang, held in once.items()}
    own = {lang: x for lang, x in own.items() if len(x) >= 8}
    useful = min(USEFUL, max(map(len, own.values()), default=0) // 2)
    size = min([DICTIONARY, *(len(x) for x in own.values() if len(x) >= useful)])
    return {lang: x[:size] for lang, x in own.items()}


def _compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, held in sorted(dictionaries.items()):
        d = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters(**PARAMETERS, write_content_size=0, write_checksum=0, write_dict_id=0)
        d.precompute_compress(compression_params=parameters)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=parameters)))
    return out


def classify(text: str | None, compressors: list) -> tuple[str, float, float]:
    """(language, score, margin): score is 0.5 at no margin and tends to 1, as bytes saved grow."""
    data = plain(text or "").encode()
    if not data or not compressors:
        return "und", 0.0, 0.0
    chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    sizes = [sum(len(c.compress(x)) for x in chunks) for _, c in compressors]
    order = np.argsort(sizes, kind="stable")
    best = sizes[order[0]]
    second = sizes[order[1]] if len(sizes) > 1 else best + len(data)
    margin = (second - best) / second
    return compressors[order[0]][0], float(1 - 0.5 * 2.0 ** -(min(second - best, 60) / 4)), margin


def _predict(dictionaries, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressors = _compressors(dictionaries.value)
    for batch in batches:
        langs, scores, margins = [], [], []
        for text in batch.column("_text"):
            lang, score, margin = classify(text.as_py(), compressors)
            langs.append(lang)
            scores.append(score)
            margins.append(margin)
        kept = batch.drop_columns(["_text"])
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
            [*kept.schema.names, "lang_pred", "score", "margin"],
        )


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str]) -> DataFrame:
    """The language of every whole text, beside the columns ``keep`` of ``docs``.

    Adds lang_pred (``und`` where the text is null or has no letter, or nothing was learned), score (0 to 1)
    and margin (0 to 1). Of equal sizes the alphabetically first language is chosen. Repeated rows are all judged;
    columns of ``docs`` named like the added ones must not be in ``keep``.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # languages x DICTIONARY bytes
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join([f"`{n}` {t}" for n, t in rows.drop("_text").dtypes] + ["lang_pred string", "score double", "margin double"])
    return rows.mapInArrow(partial(_predict, held), schema)


def accepted(predicted: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows with a language and a margin that is not narrow."""
    return predicted.filter((F.col("lang_pred") != "und") & (F.col("margin") >= min_margin))
