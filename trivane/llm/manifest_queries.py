"""The registered queries of the manifest, of sharding and of clustering, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.llm import ball_kmeans, merkle, ring
from trivane.llm.sql_parts import crc32_ctes

SHARDS, VIRTUAL = 24, 128
CLUSTERS, ROUNDS = 8, 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's CRC-32 is a multiple of 7 prove a changed leaf, the others their own."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    tampered = {"n_chars": F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return merkle.digest(merkle.manifest(_table(spark, sf_dir, "documents"), tampered=tampered))


def _leaf(chars: str) -> str:
    part = lambda x: f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
    return f"sha256({' || '.join(part(x) for x in ('doc_id', 'source', 'lang', chars, 'text'))})"


def _levels(name: str, leaves: str) -> str:
    """The nodes of all levels (tree, level, pos, n, digest) above ``leaves`` (tree, slot, n, leaf), and paths (tree, slot, steps)."""
    return f"""{name}(tree, level, pos, n, digest) AS (SELECT tree, 0, slot, n, leaf FROM {leaves} UNION ALL
  SELECT tree, level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2),
{name}_path AS (SELECT l.tree, l.slot, list(CASE WHEN s.digest IS NULL THEN '' WHEN s.pos < o.pos THEN 'L' || s.digest ELSE 'R' || s.digest END ORDER BY o.level) AS steps
  FROM {leaves} l JOIN {name} o ON o.tree = l.tree AND o.n > 1 AND o.pos = l.slot >> o.level LEFT JOIN {name} s ON s.tree = o.tree AND s.level = o.level AND s.pos = xor(o.pos, 1) GROUP BY ALL)"""


OP11_SQL = f"""
WITH RECURSIVE {crc32_ctes('cr', 'SELECT DISTINCT doc_id AS k, doc_id::varchar AS t FROM documents WHERE doc_id IS NOT NULL')},
d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('n_chars')} AS leaf, {_leaf('(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)')} AS other FROM documents LEFT JOIN cr ON k = doc_id),
lf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_levels('lv', 'lf')},
tl AS MATERIALIZED (SELECT '' AS tree, tree AS own, row_number() OVER (ORDER BY tree) - 1 AS slot, count(*) OVER () AS n, digest AS leaf FROM lv WHERE n = 1),
{_levels('tv', 'tl')},
p AS (SELECT doc_id, lf.leaf, other, tl.leaf AS subroot, (SELECT digest FROM tv WHERE n = 1) AS root, list_concat(coalesce(lp.steps, []), coalesce(tp.steps, [])) AS steps
  FROM lf JOIN tl ON tl.own = lf.tree LEFT JOIN lv_path lp ON lp.tree = lf.tree AND lp.slot = lf.slot LEFT JOIN tv_path tp ON tp.slot = tl.slot),
f AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256,
  list_reduce(list_concat([other], steps), lambda a, s: sha256(CASE WHEN s = '' THEN a WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root FROM p)
SELECT *, folded_root = root AS verified FROM f
"""


def op12_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads are bounded by rows: without slack the shards' counts are at most one apart."""
    out = ring.shard_documents(_table(spark, sf_dir, "documents"), SHARDS, VIRTUAL, slack=0.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")


_PLACE = "('0x' || substr(md5(concat_ws(':', {0})), 1, 8))::bigint"
OP12_SQL = f"""
WITH RECURSIVE rw AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, text, strlen(coalesce(text, '')) + 8 AS size FROM documents),
{crc32_ctes('cr', 'SELECT k, text AS t FROM rw')},
ri AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY place, shard, copy) - 1)::int AS arc, shard, place FROM
  (SELECT s::int AS shard, c::int AS copy, {_PLACE.format("'node', s, c")} AS place FROM range(0, {SHARDS}) a(s), range(0, {VIRTUAL}) b(c))),
ke AS (SELECT rw.*, crc, {_PLACE.format("'key', doc_id")} AS place FROM rw JOIN cr USING (k)),
ka AS MATERIALIZED (SELECT ke.*, coalesce(arc, 0) AS arc FROM ke ASOF LEFT JOIN (SELECT place, min(arc) AS arc FROM ri GROUP BY place) r ON ke.place <= r.place),
kr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY place, doc_id NULLS FIRST, size, crc) - 1 AS pos FROM ka),
co AS (SELECT ri.arc, shard, coalesce(n, 0) AS n, (SELECT count(*) FROM rw) AS total FROM ri LEFT JOIN (SELECT arc, count(*) AS n FROM ka GROUP BY arc) c ON c.arc = ri.arc),
cb AS (SELECT *, total // {SHARDS} + CASE WHEN shard < total % {SHARDS} THEN 1 ELSE 0 END AS room, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM co),
ow AS MATERIALIZED (SELECT *, n - own AS over, coalesce(sum(n - own) OVER (ORDER BY arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_before
  FROM (SELECT arc, shard, n, room, greatest(0, least(n, room - before)) AS own FROM cb)),
wk(i, carried, taken, rooms, shard, take) AS (SELECT -1, 0::bigint, 0::bigint, (SELECT list(r ORDER BY shard) FROM (SELECT shard, (max(room) - sum(own))::bigint AS r FROM ow GROUP BY shard)), -1, 0::bigint
  UNION ALL SELECT i + 1, (carried - t + CASE WHEN i + 1 < {SHARDS * VIRTUAL} THEN over ELSE 0 END)::bigint, taken + t, list_concat(rooms[:s], [rooms[s + 1] - t], rooms[s + 2:]), s, t
  FROM (SELECT wk.i, carried, taken, rooms, ow.shard AS s, over, least(rooms[ow.shard + 1], carried) AS t FROM wk JOIN ow ON ow.arc = (wk.i + 1) % {SHARDS * VIRTUAL} WHERE wk.i + 1 < {2 * SHARDS * VIRTUAL})),
st AS (SELECT taken - take AS since, shard FROM wk WHERE take > 0),
kk AS (SELECT kr.*, ow.shard AS home, kr.pos >= own AS moves, over_before + kr.pos - own AS queued FROM kr JOIN ow USING (arc)),
mv AS (SELECT kk.*, st.shard FROM kk ASOF JOIN st ON kk.queued >= st.since WHERE moves UNION ALL SELECT *, home FROM kk WHERE NOT moves)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY moves, arc, pos) - 1 AS slot, NULL::int AS grown_shard, home FROM mv
"""


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ball_kmeans.cluster(_table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS)
    text = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))


def _kmeans_sql() -> str:
    parts = ["""x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)"""]
    parts.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM x ORDER BY h, v LIMIT {CLUSTERS}))")
    for i in range(ROUNDS + 1):
        d = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::bigint"
        parts.append(f"d{i} AS (SELECT r, c, {d} AS d FROM x, c{i} c)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY r)")
        if i < ROUNDS:
            parts.append(f"s{i} AS (SELECT c, i, sum(v[i])::bigint AS s, count(*) AS n FROM x JOIN a{i} USING (r), range(1, 65) t(i) GROUP BY c, i)")
            parts.append(f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))")
    return f"""WITH {', '.join(parts)} SELECT vec_id, c::int AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::bigint AS cluster_inertia, (sum(d) OVER ())::bigint AS inertia,
sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256 FROM x JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} USING (c)"""


OP13_SQL = _kmeans_sql()

QUERIES = {"op11_merkle": op11_merkle, "op12_ring": op12_ring, "op13_ball_kmeans": op13_ball_kmeans}
ORACLES = {"op11_merkle": OP11_SQL, "op12_ring": OP12_SQL, "op13_ball_kmeans": OP13_SQL}
