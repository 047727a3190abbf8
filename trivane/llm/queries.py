"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.llm import bpe_corpus, decontamination, language, lm_scoring, manifest_queries, pii, simhash, substring_dedup, token_files, topk, url_reputation
from trivane.shared import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), remainder(7) == 2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


OP2_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n,
              array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, ns WHERE len(ws) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::varchar AS x FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw ON w.doc_id = hw.doc_id LEFT JOIN hi ON w.doc_id = hi.doc_id
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_corpus.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    dictionaries = language.learn(docs.filter(~held_out))
    judged = language.predict(docs, dictionaries, ["doc_id"])
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.checksums(token_files.read_tokens(spark, folder))


#: Fixed values of the query: rules that come before the method.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: A page's outcome is that of the labelled document of the same id: bad if toxic or of low quality.
MAX_BAD = 0.3


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    outcomes = pages.join(labels, pages.page_id == labels.doc_id).select(
        url_reputation.url_host(F.col("url")).alias("host"), bad.alias("bad")
    )
    judged = url_reputation.filter_urls(pages, outcomes, URL_RULES, max_bad=MAX_BAD)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
o AS (SELECT host, CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END AS bad
      FROM p JOIN labels ON page_id = doc_id),
h0 AS (SELECT host, sum(n)::double AS n, sum(k)::double AS k FROM (
         SELECT host, 0 AS n, 0 AS k FROM p UNION ALL SELECT host, 1, bad FROM o) GROUP BY host),
h2 AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare FROM h0),
h1 AS (SELECT *, CASE WHEN regexp_matches(bare, '(^|\\.)(ac|co|com|edu|gov|net|org)\\.[a-z]{2}$')
                      THEN regexp_extract(bare, '([^.]*\\.[^.]*)$', 1)
                      ELSE regexp_extract(bare, '([^.]*)$', 1) END AS suffix FROM h2),
h AS (SELECT *, CASE WHEN contains(suffix, '.') THEN regexp_extract(bare, '((?:[^.]*\\.)?[^.]*\\.[^.]*)$', 1)
                     WHEN contains(bare, '.') THEN regexp_extract(bare, '([^.]*\\.[^.]*)$', 1)
                     ELSE bare END AS domain FROM h1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
m AS (SELECT (sum(k) + 1.0) / (sum(n) + 2.0) AS mean FROM h),
g AS (
  SELECT level, 1 / least(greatest(coalesce(CASE WHEN room <> 0 THEN (s / greatest(mean * (1 - mean), 1e-9) - (g - 1)) / room END,
         0.01), 0.001), 0.999) - 1 AS strength
  FROM (SELECT level, any_value(mean) AS mean, sum((k - n * mean) * (k - n * mean) / n) AS s, count(*)::double AS g,
               sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room
        FROM (SELECT 'host' AS level, n, k FROM h UNION ALL SELECT 'domain', n, k FROM d UNION ALL SELECT 'suffix', n, k FROM s), m
        WHERE n > 0 GROUP BY level)),
gs AS (SELECT max(strength) FILTER (level = 'host') AS sh, max(strength) FILTER (level = 'domain') AS sd,
              max(strength) FILTER (level = 'suffix') AS ss FROM g),
ms AS (SELECT suffix, (k + ss * mean) / (n + ss) AS suffix_mean FROM s, gs, m),
md AS (SELECT domain, (k + sd * suffix_mean) / (n + sd) AS domain_mean FROM d JOIN ms USING (suffix), gs),
ab AS (SELECT host, k + sh * domain_mean AS a, n - k + sh * (1 - domain_mean) AS b FROM h JOIN md USING (domain), gs),
bh AS (SELECT host FROM ab WHERE a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.3),
r(rule, action, rhost, rpath) AS (VALUES
  ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
f AS (SELECT p.*, (SELECT max_by(rule, length(rule)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule FROM p)
SELECT page_id, f.host, path, f.rule, coalesce(r.action, CASE WHEN bh.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM f LEFT JOIN r ON f.rule = r.rule LEFT JOIN bh ON f.host = bh.host
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


OP3_SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT win, min(doc_id) AS least FROM n GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM n JOIN m USING (win) WHERE doc_id > least),
p AS (SELECT doc_id, len(ws) AS n_words, ws, coalesce(js, []) AS js
      FROM w LEFT JOIN (SELECT doc_id, list(j) AS js FROM g GROUP BY doc_id) USING (doc_id))
SELECT p.doc_id, any_value(n_words)::bigint AS n_words, any_value(len(js))::bigint AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM p LEFT JOIN (
  SELECT e.doc_id, e.i, e.word, g.j IS NOT NULL AS gone
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) e
  LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.j) x ON p.doc_id = x.doc_id
GROUP BY p.doc_id
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), pii.default_tagger(), ["doc_id"]))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors)


OP10_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r)
SELECT query_id, rank::int AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_bloom": op1_lm_bloom,
        "op2_decontamination": op2_decontamination,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_bpe": op4_bpe,
        "op5_language": op5_language,
        "op6_token_files": op6_token_files,
        "op7_url_reputation": op7_url_reputation,
        "op8_simhash": op8_simhash,
        "op9_pii": op9_pii,
        "op10_topk": op10_topk,
        **manifest_queries.QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": OP2_SQL,
        "op3_substring_dedup": OP3_SQL,
        "op7_url_reputation": OP7_SQL,
        "op10_topk": OP10_SQL,
        **manifest_queries.ORACLES,
    }
