import random

import pytest


def thue_morse(n, first="a"):
    """2**n letters; with its complement equal under any polynomial hash modulo 2**64."""
    text = first
    for _ in range(n):
        text += text.translate(str.maketrans("ab", "ba"))
    return text


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, tag int, bucket int, ids string"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    vocabulary = ["The", "of", "and", "blé", "straße", "x", "run", "run", "Lane", "it's", "a b", "zeta", "alpha", "don't"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(40)
    texts = [base, base, base + " end", base.replace("zeta", "ZETA"), None, "", "   \n\t ", "one", "two words", "!!! ???", "word " * 40, prose(9000), "z" * 30000]
    texts += [prose(60) + " " + passage + "\n" + prose(50) for _ in range(6)] + [prose(rng.randint(1, 200)) for _ in range(20)]
    texts += [" ".join([thue_morse(10, c)] * 14 + [thue_morse(11, c)]) for c in "ab"]
    langs = ["en", "de", None]
    rows = [(3 * i + 1, t, rng.choice(langs), "s", None, "q", 1, 2, "z") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def edge_documents(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()
