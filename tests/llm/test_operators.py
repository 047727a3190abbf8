"""The text operators on rows with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from math import log2, log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow import orc
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import thue_morse
from tests.llm.test_shingles import brute as near_components
from trivane.llm import bpe, bpe_corpus, decontamination, language, lm_scoring, pii, simhash, substring_dedup, token_files, topk, url_reputation
from trivane.llm.queries import URL_RULES
from trivane.llm.words import NOT_SPACE, find_words, same_spans, span_names

PATH = public_tokenizers.path("byte_bpe_50k.json")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False


@pytest.mark.parametrize("filter_bytes", [1 << 20, 100])
def test_lm(spark, edge_documents, edge_rows, filter_bytes):
    """Broadcast filter, and levels by exchange: both against exact tables, at so many bits that no probe is false."""
    got = lm_scoring.score(edge_documents, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, max_filter_bytes=filter_bytes, bits=200).collect()
    tokens = [(r[0], [*re.findall(r"[^\x20\x09-\x0D]+", lower(r[1])), None]) for r in edge_rows]
    counts = Counter(t for i, ts in tokens if not held_out(i) for t in ts)
    pairs = Counter(p for i, ts in tokens if not held_out(i) for p in zip([None, *ts], ts))
    n, v = sum(counts.values()), len(counts)

    def read(c):
        return [0, 1][c] if c < 2 else 1.4 * 2 ** int(log2(c))

    def probability(h, w):
        alone, before = (read(counts[w]) + 1) / (n + v + 1), read(counts[h])
        return 0.4 * min(read(pairs[h, w]), before) / before + 0.6 * alone if before else alone

    key = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2:4], r[4], r[5]))
    expected = key([(i, held_out(i), len(ts), sum(t in counts for t in ts), n, sum(log10((counts[t] + 1) / (n + v + 1)) for t in ts), sum(log10(probability(*p)) for p in zip([None, *ts], ts))) for i, ts in tokens])
    found = key([tuple(r) for r in got])
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in expected])


def test_lm_empty(edge_documents):
    assert lm_scoring.score(edge_documents.limit(0), F.lit(False)).count() == 0


@pytest.mark.parametrize("patterns", [1000, 7])
def test_decontamination(spark, edge_documents, edge_rows, patterns):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    texts = [r[1] for r in edge_rows]
    items = [(10, " ".join(words(texts[0])[5:40])), (9, texts[13]), (2, "One"), (3, None), (4, ""), (5, "two  WORDS!"), (None, texts[0]), (10, " ".join(words(texts[0])[5:40]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    windows = defaultdict(set)
    for i, t in items:
        own = words(t)
        if own and i is not None:
            for k in range(max(1, len(own) - 9)):
                windows[tuple(own[k : k + 10])].add(str(i))
    expected = []
    for r in edge_rows:
        own, hit, found = words(r[1]), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(own) - size + 1):
                if (w := tuple(own[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[w]
        ids = ",".join(sorted(found))
        expected.append((r[0], len(own), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in decontamination.digest(decontamination.search(edge_documents, benchmark, patterns=patterns)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_decontamination_empty(spark, edge_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["hits"] for r in decontamination.search(edge_documents, none).collect()} == {b""}
    assert decontamination.search(edge_documents.limit(0), none).count() == 0


@pytest.mark.parametrize("parts", [1, 20])
def test_substring_dedup(edge_documents, edge_rows, parts):
    """In one block, and in blocks of a few documents."""
    rows = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in edge_rows]
    least = {}
    for i, ws in rows:
        for k in range(len(ws) - 12):
            if i is not None:
                least[tuple(ws[k : k + 13])] = min(i, least.get(tuple(ws[k : k + 13]), i))
    expected = []
    for i, ws in rows:
        gone = {j for k in range(len(ws) - 12) if i is not None and least[tuple(ws[k : k + 13])] < i for j in range(k, k + 13)}
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        expected.append((i, len(ws), len(gone), kept))
    got = [tuple(r) for r in substring_dedup.remove_repeats(edge_documents.repartition(parts)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert any(r[2] for r in got)
    assert substring_dedup.remove_repeats(edge_documents.limit(0)).count() == 0


def test_names_of_regular_words():
    texts = [thue_morse(n, c) for c in "ab" for n in (10, 11)]
    words = find_words(pa.array([" ".join(texts)]), NOT_SPACE, lower=False)
    assert len(set(span_names(words.data, words.starts, words.ends).tolist())) == 4
    other = find_words(pa.array(["x " + " ".join(reversed(texts))]), NOT_SPACE, lower=False)
    same = same_spans(words.data, words.starts, words.ends, other.data, other.starts[:0:-1].copy(), other.ends[:0:-1].copy())
    assert same.all()
    assert not same_spans(words.data, words.starts[:2], words.ends[:2], words.data, words.starts[2:], words.ends[2:]).any()


def random_texts(count, seed):
    """Texts of code points from all of Unicode, white space, marks, numbers and contractions among them."""
    rng = np.random.default_rng(seed)
    pools = [list(range(32, 127)), list(range(128, 0x250)), list(range(0x300, 0x370)), list(range(0x600, 0x700)), [*range(0x2000, 0x2070), 0x3000, 0x85, 0xA0], list(range(0x2150, 0x2190)), list(range(0x4E00, 0x4F00)), list(range(0x1F300, 0x1F700)), list(range(0x1D400, 0x1D800)), [9, 10, 11, 12, 13, 28, 31, 32, 39]]
    out = []
    for _ in range(count):
        some = [pools[i] for i in rng.integers(0, len(pools), 3)]
        text = "".join(chr(rng.choice(some[rng.integers(0, 3)])) for _ in range(rng.integers(0, 60)))
        out.append(text + rng.choice(["", "'s", "'ll x", "<|endoftext|>", "  ", "\n\n a"]))
    return out


@pytest.mark.parametrize("name", [span_names, lambda data, starts, ends: (ends - starts).astype(np.uint64) // np.uint64(4)])
def test_bpe_against_the_library(name):
    """Whole texts, also where words of different bytes have one name; the words of token files are encoded alike."""
    library = Tokenizer.from_file(PATH)
    texts = [*random_texts(1500, 12), thue_morse(10), thue_morse(10, "b"), None, ""]
    for encoder in (bpe.Encoder(PATH, room=3000, name=name), bpe.Encoder(PATH, vocabulary=token_files.LibraryWords(PATH), name=name)):
        for lo in range(0, len(texts), 200):
            ids, counts = encoder.encode(pa.array(texts[lo : lo + 200], pa.string()))
            ends = np.cumsum(counts)
            for t, a, b in zip(texts[lo : lo + 200], ends - counts, ends):
                want = library.encode(t or "", add_special_tokens=False).ids
                assert ids[a:b].tolist() == want
                assert encoder is None or bpe.encoder(PATH).decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_and_token_files(spark, edge_documents, edge_rows, tmp_path):
    """Repeated rows, null ids, ties of ids, clashing columns; digests of both queries; stripes that a filter skips."""
    library = Tokenizer.from_file(PATH)
    rows = [*[r[:2] for r in edge_rows], (1000, "a<|endoftext|>b<|endof"), (1000, "can't  I'm\n\n x"), (1000, "can't  I'm\n\n x"), (1001, "é" * 300), (None, "\x00١²"), (1002, thue_morse(10)), (1003, thue_morse(10, "b"))]
    docs = spark.createDataFrame([(i, t, [1], "x", 5) for i, t in rows], "doc_id long, text string, ids array<int>, n_tokens string, part int").repartition(3)
    encoded = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in rows}
    key = lambda x: sorted(x, key=str)
    got = bpe_corpus.encode(docs, PATH, ["doc_id", "text"], decoded=True).collect()
    assert key((r["doc_id"], r["text"]) for r in got) == key(rows)
    assert all(r["ids"] == encoded[r["text"]] and r["n_tokens"] == len(r["ids"]) for r in got)
    assert all(r["decoded"] == library.decode(encoded[r["text"]], skip_special_tokens=False) for r in got)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = [(i, len(encoded[t]), sha(",".join(map(str, encoded[t]))), sha(library.decode(encoded[t], skip_special_tokens=False))) for i, t in rows]
    assert key(tuple(r) for r in bpe_corpus.digest(docs, PATH).collect()) == key(digests)
    assert all(r["round_trip"] for r in bpe_corpus.encode(docs, PATH, ["doc_id"], verify=True).collect())
    again = bpe_corpus.decode(bpe_corpus.encode(docs, PATH, ["doc_id"]), PATH).collect()
    assert key((r["doc_id"], r["decoded"]) for r in again) == key((r["doc_id"], r["decoded"]) for r in got)
    assert bpe_corpus.digest(docs.limit(0), PATH).count() == 0

    token_files.write_tokens(docs, PATH, str(tmp_path / "tokens"))
    read = token_files.read_tokens(spark, str(tmp_path / "tokens"))
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*encoded[t], 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert key(tuple(r) for r in token_files.checksums(read).collect()) == key(want)
    assert read.filter("doc_id = 7").collect()[0]["ids"] == [*encoded[dict(rows)[7]], 0]
    token_files.write_tokens(docs.limit(0), PATH, str(tmp_path / "none"))
    assert token_files.checksums(token_files.read_tokens(spark, str(tmp_path / "none"))).count() == 0


def test_token_files_skip_rows(spark, tmp_path, monkeypatch):
    """A filter on doc_id reads some groups of the row index, and none for an id that only the Bloom filter tells apart."""
    monkeypatch.setattr(token_files, "INDEX_ROWS", 1000)
    docs = spark.createDataFrame([(2 * i, f"text {i}") for i in range(20000)], "doc_id long, text string").repartition(2)
    token_files.write_tokens(docs, PATH, str(tmp_path / "t"))
    assert all(orc.ORCFile(f).row_index_stride == 1000 for f in (tmp_path / "t").glob("*.orc"))
    read = {}
    for doc_id in (4320, 4321):
        held = spark.read.schema(token_files._ROWS).orc(str(tmp_path / "t")).filter(F.col("doc_id") == doc_id)
        plan = held._jdf.queryExecution().executedPlan()
        found = len(plan.executeCollect())
        read[doc_id] = (found, plan.collectLeaves().head().metrics().apply("numOutputRows").value())
    assert read[4320][0] == 1 and read[4320][1] <= 1000 and read[4321] == (0, 0)


def test_language(spark, edge_documents):
    words = {"aa": "the and of with from that this have will", "bb": "der und mit von dass nicht haben wird eine", "cc": "les des pour dans avec vous nous cette mais"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 40)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = language.learn(docs.filter("doc_id % 5 != 0"))
    got = language.predict(docs.filter("doc_id % 5 = 0"), held, ["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    odd = language.predict(edge_documents, held, ["doc_id", "text"]).collect()
    assert len(odd) == edge_documents.count()
    for r in odd:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    numbers = spark.createDataFrame([(0, "²"), (1, "½ Ⅷ ٣"), (2, "_1²"), (3, "²a")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in language.predict(numbers, held, ["doc_id"]).collect()} == {0: True, 1: True, 2: True, 3: False}
    assert {r["lang_pred"] for r in language.predict(edge_documents, {}, ["doc_id"]).collect()} == {"und"}
    assert language.learn(docs.limit(0)) == {}


def test_language_against_plain_compression(spark, edge_rows):
    """Sizes text by text and dictionary by dictionary."""
    held = {"aa": b"the and of with from that this have will " * 40, "bb": "der und mit blé straße dass nicht haben ".encode() * 40, "cc": b"les des pour dans avec"}
    rows = [r for r in edge_rows if r[0] is not None]
    docs = spark.createDataFrame([(r[0], r[1], 1.0) for r in rows], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in language.predict(docs, held, ["doc_id"]).collect()}
    for i, text, *_ in rows:
        data = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()).encode()
        sizes = {}
        for lang, d in held.items():
            options = zstandard.ZstdCompressionParameters(**language.PARAMETERS, write_content_size=0, write_checksum=0, write_dict_id=0)
            kept = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(compression_params=options)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=kept, compression_params=options).compress(data[k : k + language.CHUNK])) for k in range(0, len(data), language.CHUNK))
        order = sorted(sizes, key=lambda lang: (sizes[lang], lang))
        assert got[i]["lang_pred"] == (order[0] if data else "und")
        if data:
            assert np.isclose(got[i]["margin"], 1 - sizes[order[0]] / sizes[order[1]])
            assert np.isclose(got[i]["score"], 1 - 0.5 / 2 ** (min(sizes[order[1]] - sizes[order[0]], 60) / 4))
        else:
            assert got[i]["score"] == 0


def made_of(words, lang, count, start, rng):
    return [(start + i, " ".join(rng.choice(words, 200)), lang) for i in range(count)]


def test_language_with_a_rare_label_and_with_copies(spark):
    """A short label leaves the others' dictionaries whole; copies and near copies are learned from like one document."""
    rng = np.random.default_rng(4)
    letters = {"aa": "abcdefg", "bb": "abcdehi", "cc": "abcdejk"}
    words = {lang: ["".join(rng.choice(list(x), 4)) for _ in range(400)] for lang, x in letters.items()}
    plenty = made_of(words["aa"], "aa", 60, 0, rng) + made_of(words["bb"], "bb", 60, 100, rng)
    read = lambda rows: language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    whole, rare = read(plenty), read([*plenty, (900, "xyz zyx yxz xzy", "zz")])
    assert min(map(len, whole.values())) > 16 << 10
    assert {lang: x for lang, x in rare.items() if lang != "zz"} == whole and len(rare["zz"]) == 15
    one = " ".join(rng.choice(words["cc"], 590))
    sentences = [" ".join(rng.choice(words["cc"], 20)) for _ in range(25)]
    near = [(2000 + i, ". ".join([*sentences, f"{words['cc'][i]} {words['cc'][i + 1]}"]), "cc") for i in range(60)]
    for copies in ([(1000 + i, one, "cc") for i in range(300)], near):
        held = read([*plenty, *copies])
        assert {lang: x for lang, x in held.items() if lang != "cc"} == whole and len(held["cc"]) > 2000
        fresh = spark.createDataFrame([r for lang in words for r in made_of(words[lang], lang, 10, 0, rng)], "doc_id long, text string, lang string")
        got = language.predict(fresh, held, ["lang"]).collect()
        assert np.mean([r["lang"] == r["lang_pred"] for r in got if r["lang"] != "cc"]) == 1


def test_url_rules(spark):
    urls = ["http://A.example.org/es/x?y", "https://example.org/en/12#z", "http://b.org", "http://x.com/fr/1", "http://x.com/de/1", "ftp://bad.net/p", "http://good.net", None, "no scheme", "http://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("own"))
    outcomes = spark.createDataFrame([("bad.net", 1)] * 40 + [("good.net", 0)] * 60 + [(None, None)], "host string, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.filter_urls(pages, outcomes, URL_RULES).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("b.org", "", None, "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == ("bad.net", "/p", None, "block") and got[6][3] == "allow"
    assert got[7][:2] == got[8][:2] == got[9][:2] == ("", "")
    assert url_reputation.filter_urls(pages.limit(0), outcomes.limit(0), URL_RULES).count() == 0


def test_url_repeats_ports_and_long_urls(spark):
    """Repeated pages are all judged; a port is no part of the suffix; a url of a million characters is read whole."""
    long = "http://bad.net/" + "x/" * 500_000
    urls = ["http://bad.net:8080/p", "http://bad.net:8080/p", "http://a.co.uk/", "http://b.co.uk:81", long, long]
    pages = spark.createDataFrame([(1, u, "own", 5) for u in urls], "page_id long, url string, verdict string, n int")
    outcomes = spark.createDataFrame([("bad.net", 1)] * 60 + [("ok.org", 0)] * 300 + [("ok.co.uk", 0)] * 60, "host string, bad int")
    got = url_reputation.filter_urls(pages, outcomes, URL_RULES).collect()
    assert Counter((r["host"], len(r["path"]), r["verdict"]) for r in got) == {("bad.net:8080", 2, "block"): 2, ("a.co.uk", 1, "allow"): 1, ("b.co.uk:81", 0, "allow"): 1, ("bad.net", 1_000_001, "block"): 2}
    suffix = lambda h, *a: url_reputation.suffix_of(url_reputation.without_port(F.lit(h)), *a)
    row = spark.range(1).select(suffix("a.b.co.uk:81").alias("a"), suffix("a.com:1").alias("b"), suffix("a.gen.tr", ["gen"]).alias("c")).first()
    assert tuple(row) == ("co.uk", "com", "gen.tr")


@pytest.fixture(scope="session")
def tagger():
    return pii.default_tagger()  # the model of the query


def test_pii_patterns():
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = np.random.default_rng(2)
    parts = ["a", "b.", "@", "1", "24", "9", ".", " ", "-", "+", "(", ")", "255", "256", "4111111111111111", "é", "com"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(0, 25)))
        expected = []
        for k, (kind, pattern) in enumerate(kinds.items()):
            for m in re.finditer(pattern, text):
                digits = pii.digits_of(m[0])
                good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
                expected += [(m.start(), k, m.end())] * good
        assert pii.base_spans(text) == [(s, e, pii.KINDS[k]) for s, k, e in sorted(expected)]


def test_pii_tagger_gradient():
    from trivane.llm.tagger import Tagger

    t = Tagger(3, hidden=3, embedding=2)
    t.w = {k: v.astype(np.float64) for k, v in t.w.items()}
    rng = np.random.default_rng(0)
    ids, gold = rng.integers(1, 130, (6, 2)), rng.integers(0, 3, (6, 2))
    for name, g in t.gradients(ids, gold)[1].items():
        at = (int(ids[0, 0]), 0) if name == "embed" else (0,) * g.ndim
        t.w[name][at] += 1e-3
        up = t.gradients(ids, gold)[0]
        t.w[name][at] -= 2e-3
        down = t.gradients(ids, gold)[0]
        t.w[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[at]) < 5e-3


def test_pii_held_out(tagger):
    sentences = pii.labelled_sentences(120, seed=77)
    hit = missed = false = 0
    for (text, spans), (_, found) in zip(sentences, pii.find_all([s for s, _ in sentences], tagger)):
        inner, got = {s for s in spans if s[0] > 0 and s[1] < len(text)}, {s for s in found if s[0] > 0 and s[1] < len(text)}
        hit, missed, false = hit + len(inner & got), missed + len(inner - got), false + len(got - set(spans))
    assert hit / (hit + missed) > 0.85 and hit / (hit + false) > 0.9


def test_pii_spelled_without_digits(tagger, monkeypatch):
    """Addresses without a digit or at sign near; windows over whole texts find nothing more."""
    filler = "pelo nasti morut gandel " * 8
    texts = [f"{filler}: {x} {filler}" for x in ("morine(at)delta.org", "lato.nide[at]bort[dot]com", "hano_tirel(at)sumol.net")]
    texts += [a + b for (a, _), (b, _) in zip(pii.labelled_sentences(60, seed=8), pii.labelled_sentences(60, seed=9))] + [filler]
    found = pii.find_all(texts, tagger)
    for text, (base, spans) in zip(texts[:3], found):
        assert base == [] and [(text[s:e], k) for s, e, k in spans] == [(text.split(": ")[1].split(" ")[0], "email")]
    monkeypatch.setattr(pii, "_CUE", re.compile("(?s)."))
    assert pii.find_all(texts, tagger) == found


def test_pii_many_spans():
    """100,000 spans in one text, of the patterns and of windows that overlap them or not, in some seconds."""
    text = "1.2.3.4 m(at)n.org " * 50_000
    base = pii.base_spans(text)
    assert len(base) == 50_000
    seen = [(19 * i + a, 19 * i + b, k, d) for i in range(50_000) for a, b, k, d in ((8, 18, 0, 5), (8, 18, 0, 9), (9, 18, 0, 3), (0, 7, 1, 4))]
    began = time.time()
    found = pii.reconcile(text, base, seen)
    assert len(found) == 100_000 and time.time() - began < 20
    assert found[:3] == [(0, 7, "ip"), (8, 18, "email"), (19, 26, "ip")]


def test_pii_digest(spark, tagger):
    """Counts, digest and spans of the patterns by plain search, and spans of the tagger in their place."""
    filler = "pelo nasti morut gandel " * 8
    texts = [None, "", "no data", "ip 10.0.0.1 and a.b@c.org, +1 (521) 555-2373; 4111 1111 1111 1111 and 256.1.1.1", "é 10.0.0.1 📧 x@y.z", f"{filler}: morine(at)delta.org {filler} x@y.zz now"]
    docs = spark.createDataFrame([*((i, t, "s", 1) for i, t in enumerate(texts)), (3, texts[3], "s", 1), (None, texts[4], "s", 1)], "doc_id long, text string, spans string, n_ip int")
    got = pii.digest(pii.find(docs, tagger, ["doc_id"])).collect()
    want = {}
    for i, t in enumerate(texts):
        base = [(m.start(), k, m.end()) for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"\b10\.0\.0\.1\b", "4111 1111 1111 1111", r"\+1 \(521\) 555-2373")) for m in re.finditer(p, t or "")]
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base))
        want[i] = (*(sum(k == kind for _, k, _ in base) for kind in range(4)), hashlib.sha256(line.encode()).hexdigest()), line
    at = texts[5].find("morine")
    want[5] = want[5][0], f"email:{at}:{at + 19}," + want[5][1]
    for r in got:
        held = want[4 if r["doc_id"] is None else r["doc_id"]]
        assert (tuple(r)[1:6], r["spans"]) == held
    assert len(got) == len(texts) + 2 and pii.digest(pii.find(docs.limit(0), tagger, ["doc_id"])).count() == 0


def test_pii_table(spark, edge_documents, tagger):
    got = pii.find(edge_documents, tagger, ["doc_id", "text", "ids"]).collect()
    assert len(got) == edge_documents.count()
    assert all((r["redacted"] is None) == (r["text"] is None) for r in got)
    assert all(r["redacted"] == r["text"] for r in got if not r["spans"])
    one = spark.createDataFrame([(1, "mail a.b@c.org or +1 (521) 555-2373, 4111 1111 1111 1111 at 10.0.0.1.")], "doc_id long, text string")
    row = pii.find(one, tagger, ["doc_id"]).first()
    assert row["redacted"] == "mail <EMAIL> or <PHONE>, <CARD> at <IP>."
    assert tuple(pii.digest(pii.find(one, tagger, ["doc_id"])).first())[1:5] == (1, 1, 1, 1)


def brute_top(rows, k=10):
    """(query_id, rank, vec_id, score) of all query rows, each against every row but itself."""
    fine = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    out = []
    for a, (q, v) in enumerate(fine):
        if q is not None and q % 100 == 0:
            best = sorted((-int(v @ w), i is None, i or 0) for b, (i, w) in enumerate(fine) if a != b)[:k]
            out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(best)]
    return Counter(out)


def test_topk(spark, monkeypatch):
    """Nulls, not finite and repeated vectors, repeated ids of queries, clashing columns; blocks of queries and of vectors."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(700)]
    rows += [(800, rows[3][1]), (900, [0.0] * 8), (901, [float("nan")] * 8), (902, None), (903, [None] * 8), (904, [float("inf")] + [0.0] * 7), (1000, rows[5][1]), (None, rows[5][1]), (None, rows[5][1]), rows[7], rows[100], rows[100], (200, rows[8][1]), (905, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"query_id": F.lit(1), "rank": F.lit(2), "v": F.lit("x")}).repartition(2).cache()
    for queries, block in ((2048, 8192), (6, 64)):
        monkeypatch.setattr(topk, "QUERIES", queries)
        monkeypatch.setattr(topk, "BLOCK", block)
        assert Counter(tuple(r) for r in topk.top_k(table.filter("vec_id % 100 = 0"), table).collect()) == brute_top(rows)
    assert topk.top_k(table.limit(0), table).count() == 0 and topk.top_k(table, table.limit(0)).count() == 0


@pytest.mark.parametrize(("dimensions", "most"), [(2, 0.1), (4, 0.4), (8, 0.9)])
def test_topk_ends_by_its_bound(dimensions, most):
    """The share of the vectors that a search scores before its bound ends it."""
    rng = np.random.default_rng(6)
    vectors = np.floor(rng.normal(0, 300, (8192, dimensions))).astype(np.int64)
    lists = topk.Lists(np.arange(8192), vectors)
    for q in range(20):
        best = topk.Best(10)
        lists.search(-1, vectors[q], best)
        assert best.scores.tolist() == sorted((vectors @ vectors[q]).tolist())[::-1][:10]
    assert lists.scored < most * 20 * 8192


def test_languages_are_bounded(spark):
    """Of more labels than are learned those of the most documents are."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "".join(letters[(i // 26**k) % 26] for k in range(4))
    rows = [(i, " ".join(word(977 * i + 31 * j + 7 * len(x)) for j in range(40)), x) for i, x in enumerate(["en"] * 5 + ["de"] * 4 + ["fr"] * 3 + [f"x{i}" for i in range(20)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language.learn(docs, languages=2)) == {"de", "en"} and len(language.learn(docs, languages=4)) == 4


def item_windows(items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    return words, {tuple(own[k : k + 10]) for t in items if (own := words(t)) for k in range(max(1, len(own) - 9))}


def test_pipeline_against_brute_force(spark, edge_documents, edge_rows, tmp_path):
    """Every stage on all that the one before kept, row by row in plain Python; columns that clash are left out."""
    item = " ".join(edge_rows[13][1].split()[60:75])
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = edge_documents.withColumn("text", F.when(F.col("doc_id") == 58, F.concat("text", F.lit(" mail a.b@c.org now"))).otherwise(F.col("text")))
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    run = dict(corpus_pipeline.STAGES)
    key = lambda rows: sorted(map(str, rows))
    rows = [tuple(r) for r in docs.select(*names).collect()]

    def stage(name, docs, expected):
        out = run[name](spark, docs, str(tmp_path))
        got = [tuple(r) for r in out.collect()]
        assert key(got) == key(expected), name
        assert run[name](spark, docs.limit(0), str(tmp_path)).count() == 0
        return out, got

    learned = language.learn(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    compressors = language._compressors(learned)
    judged = [(r, language.classify(r[1], compressors)) for r in rows]
    docs, rows = stage("language", docs.withColumns({"lang_pred": F.lit(1), "margin": F.lit("x")}), [(i, t, lang or pred, s, n) for (i, t, lang, s, n), (pred, _, margin) in judged if pred != "und" and margin >= language.MIN_MARGIN])
    assert len(rows) > 10

    least = dict(near_components([r[:2] for r in rows], simhash.levels_for(len(rows))))
    kept = [r for r in rows if r[0] is None] + [min((r for r in rows if r[0] == i), key=lambda r: r[1].encode()) for i in sorted({r[0] for r in rows if r[0] is not None}) if least[i] == i]
    docs, rows = stage("near_duplicates", docs.withColumns({"component_id": F.lit(1), "row": F.lit("x"), "_id": F.lit(3)}), kept)

    words, windows = item_windows([item])
    leaks = {r[0] for r in rows for own in [words(r[1])] for k in range(len(own)) if any(tuple(own[k : k + n]) in windows for n in {len(w) for w in windows})}
    assert leaks
    docs, rows = stage("decontamination", docs, [r for r in rows if r[0] not in leaks])

    found = pii.find_all([r[1] for r in rows], pii.default_tagger())
    clean = [(i, pii.redacted(t, spans), lang, s, len(pii.redacted(t, spans))) for (i, t, lang, s, _), (_, spans) in zip(rows, found)]
    assert any("<EMAIL>" in r[1] for r in clean)
    docs, rows = stage("personal_data", docs.withColumn("spans", F.lit(1)), clean)

    library = Tokenizer.from_file(PATH)
    ids = [library.encode(r[1], add_special_tokens=False).ids for r in rows]
    stage("encoding", docs.withColumn("ids", F.lit(1)), [(r[0], r[2], r[3], r[4], len(x), x, True) for r, x in zip(rows, ids)])
