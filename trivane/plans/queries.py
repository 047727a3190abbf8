"""Registered queries over the driver's tables, each with the same query in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.functions import columns as C
from trivane.operators import evaluation, ids, ontology, perturb, pruned, relational, scoring, stats
from trivane.operators.ranking import settled
from trivane.plans import compiled
from trivane.plans import fixture as X

KEY = ["head", "tail", "relation"]
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _md5(seed: str, *columns: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(columns)}))"


_ORDER = _md5("4", *KEY)


def _energy(body: str) -> str:
    return f"list_sum(list_transform(range(1, len(h.vec) + 1), lambda i: {body}))"


_L1 = _energy("abs(t.vec[i] - (h.vec[i] + r.vec[i]))")
_JOINS = "JOIN ev h ON h.key = x.head JOIN ev t ON t.key = x.tail JOIN rv r ON r.key = x.relation"


def _scored(spark: SparkSession, d: str, triples: DataFrame, method: str = "transe", distance: str = "L1") -> DataFrame:
    relations = X.relation_vectors(spark, d)
    return scoring.score(triples, X.entity_vectors(spark, d), relations if method == "transh" else relations.drop("w"), method, distance)


@query(f"WITH {X.VECTORS} SELECT DISTINCT head, tail, relation, {_L1} AS energy FROM et x {_JOINS}")
def score_transe_l1(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, X.embedded_triples(spark, d))


@query(f"WITH {X.VECTORS} SELECT DISTINCT head, tail, relation, round({_energy('(t.vec[i] - (h.vec[i] + r.vec[i])) * (t.vec[i] - (h.vec[i] + r.vec[i]))')}, 6) AS energy FROM et x {_JOINS}")
def score_transe_l2(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, X.embedded_triples(spark, d), distance="L2").withColumn("energy", F.round("energy", 6))


@query(f"""WITH {X.VECTORS}, p AS (SELECT head, tail, relation, h.vec AS hv, t.vec AS tv, r.vec AS rvec, r.w AS w,
  list_sum(list_transform(range(1, len(h.vec) + 1), lambda i: r.w[i] * t.vec[i])) AS wt,
  list_sum(list_transform(range(1, len(h.vec) + 1), lambda i: r.w[i] * h.vec[i])) AS wh FROM et x {_JOINS})
SELECT DISTINCT head, tail, relation, round(list_sum(list_transform(range(1, len(hv) + 1),
  lambda i: abs((tv[i] - wt * w[i]) - (hv[i] - wh * w[i]) - rvec[i]))), 6) AS energy FROM p""")
def score_transh(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, X.embedded_triples(spark, d), "transh").withColumn("energy", F.round("energy", 6))


_STRANSE = """WITH {0}, q AS (SELECT head, tail, relation, r.vec AS rv, r.w AS w, list_sum(list_transform(range(1, len(h.vec) + 1), lambda j: r.vec[j] * h.vec[j])) AS rh,
  list_sum(list_transform(range(1, len(h.vec) + 1), lambda j: r.w[j] * t.vec[j])) AS wt FROM et x {1})
SELECT DISTINCT head, tail, relation, round({2}(list_sum(list_transform(range(1, len(rv) + 1), lambda i: {3}(w[i] * rh + rv[i] - rv[i] * wt{4})))), 6) AS energy FROM q"""


def _stranse(spark: SparkSession, d: str, distance: str) -> DataFrame:
    """W1 and W2 are outer products of the relation's two vectors."""
    outer = lambda a, b: F.transform(a, lambda x: F.transform(b, lambda y: x * y))
    r = X.relation_vectors(spark, d)
    r = r.select("key", "vec", outer(F.col("w"), F.col("vec")).alias("w1"), outer(F.col("vec"), F.col("w")).alias("w2"))
    return scoring.score(X.embedded_triples(spark, d), X.entity_vectors(spark, d), r, "stranse", distance).withColumn("energy", F.round("energy", 6))


@query(_STRANSE.format(X.VECTORS, _JOINS, "", "abs", ""))
def score_stranse_l1(spark: SparkSession, d: str) -> DataFrame:
    return _stranse(spark, d, "L1")


@query(_STRANSE.format(X.VECTORS, _JOINS, "sqrt", "pow", ", 2"))
def score_stranse_l2(spark: SparkSession, d: str) -> DataFrame:
    return _stranse(spark, d, "L2")


_SPLIT = f"""o AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}, head, tail, relation) AS rank, count(*) OVER () AS n FROM {{0}}),
sp AS (SELECT * FROM (SELECT head, tail, relation, CASE WHEN rank <= floor(n * 0.9) THEN 'train'
  WHEN rank <= floor(n * 0.9) + (n - floor(n * 0.9)::bigint) // 2 THEN 'test'
  WHEN rank <= floor(n * 0.9) + 2 * ((n - floor(n * 0.9)::bigint) // 2) THEN 'valid' END AS split FROM o) WHERE split IS NOT NULL)"""


@query(f"WITH {X.STRUCTURE}, {_SPLIT.format('tri')} SELECT * FROM sp")
def split_90_5_5(spark: SparkSession, d: str) -> DataFrame:
    return perturb.split(X.structure(spark, d))


_CORRUPT = f"""te AS (SELECT head, tail, relation FROM sp WHERE split = 'test'),
en AS (SELECT DISTINCT unnest([head, tail]) AS e FROM et),
co AS (SELECT e AS head, tail, relation FROM (SELECT DISTINCT tail, relation FROM te), en
       UNION SELECT head, e AS tail, relation FROM (SELECT DISTINCT head, relation FROM te), en),
cs AS (SELECT head, tail, relation, {_L1} AS energy FROM co x {_JOINS}),
ts AS (SELECT head, tail, relation, {_L1} AS energy FROM te x {_JOINS})"""
_LINKS = f"{X.VECTORS}, {_SPLIT.format('et')}, {_CORRUPT}"


def _link_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(test triples, all entities, vectors of entities, of relations)."""
    triples = X.embedded_triples(spark, d)
    test = settled(perturb.split(triples).filter("split = 'test'").select(*KEY))
    return test, scoring.entity_universe(triples), X.entity_vectors(spark, d), X.relation_vectors(spark, d).drop("w")


@query(f"WITH {_LINKS} SELECT * FROM co")
def corruptions_made(spark: SparkSession, d: str) -> DataFrame:
    return scoring.corruptions(*_link_inputs(spark, d)[:2])


@query(f"WITH {_LINKS} SELECT * FROM cs")
def corruptions_scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scored_corruptions(*_link_inputs(spark, d))


@query(f"""WITH {_LINKS}, h AS (SELECT head, relation, max(energy) AS c FROM ts GROUP BY ALL), t AS (SELECT tail, relation, max(energy) AS c FROM ts GROUP BY ALL)
SELECT cs.head, cs.tail, cs.relation, energy FROM cs LEFT JOIN h ON h.head = cs.head AND h.relation = cs.relation
LEFT JOIN t ON t.tail = cs.tail AND t.relation = cs.relation WHERE energy <= h.c OR energy <= t.c""")
def corruptions_skyline(spark: SparkSession, d: str) -> DataFrame:
    """Only what a metric index does not rule out is scored."""
    test, universe, vectors, relations = _link_inputs(spark, d)
    return pruned.skyline(test, universe, vectors, relations)


@query(f"WITH {_LINKS} SELECT * FROM cs WHERE energy <= 10.0")
def corruptions_below_maximum(spark: SparkSession, d: str) -> DataFrame:
    test, universe, vectors, relations = _link_inputs(spark, d)
    return pruned.below(test, universe, vectors, relations, C.max_energy("transe", "L1"))


@query(f"""WITH {_LINKS}, e AS (SELECT DISTINCT cs.*, te.head AS a, te.tail AS b FROM cs JOIN te ON te.relation = cs.relation AND (te.tail = cs.tail OR te.head = cs.head)),
p AS (SELECT *, row_number() OVER (PARTITION BY a, b, relation ORDER BY energy, head, tail) AS place FROM e) SELECT DISTINCT head, tail FROM p WHERE place <= 500""")
def corruptions_top_pairs(spark: SparkSession, d: str) -> DataFrame:
    return scoring.top_pairs(*_link_inputs(spark, d))


def _link_ranks(spark: SparkSession, d: str) -> DataFrame:
    triples = settled(perturb.split(X.embedded_triples(spark, d)))
    vectors, relations = X.entity_vectors(spark, d), X.relation_vectors(spark, d).drop("w")
    universe = scoring.entity_universe(X.embedded_triples(spark, d))
    return evaluation.link_ranks_by_tiles(triples.filter("split = 'test'").select(*KEY), universe, vectors, relations, triples)


_RANKS = """fl AS (SELECT cs.*, CASE WHEN v.head IS NULL THEN 1 ELSE 0 END AS other FROM cs LEFT JOIN (SELECT DISTINCT head, tail, relation FROM sp) v USING (head, tail, relation)),
ra AS (SELECT head, tail, relation, 'head' AS side, row_number() OVER w AS raw, 1 + coalesce(sum(other) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filtered
       FROM fl WINDOW w AS (PARTITION BY tail, relation ORDER BY energy, head)
       UNION ALL SELECT head, tail, relation, 'tail', row_number() OVER w, 1 + coalesce(sum(other) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
       FROM fl WINDOW w AS (PARTITION BY head, relation ORDER BY energy, tail)),
lr AS (SELECT head, tail, relation, side, raw::bigint AS raw, filtered::bigint AS filtered FROM te JOIN ra USING (head, tail, relation))"""


@query(f"WITH {_LINKS}, {_RANKS} SELECT *, false AS missing FROM lr")
def link_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _link_ranks(spark, d)


@query(f"""WITH {_LINKS}, {_RANKS} SELECT avg(raw) AS mean_rank_raw, avg(filtered) AS mean_rank_filtered, avg(CASE WHEN raw <= 10 THEN 1.0 ELSE 0.0 END) AS hits_raw,
avg(CASE WHEN filtered <= 10 THEN 1.0 ELSE 0.0 END) AS hits_filtered, 0::bigint AS n_missing FROM lr""")
def link_prediction(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.link_prediction(_link_ranks(spark, d))


_LABELS = "la AS (SELECT x.*, head::bigint % 2 = 0 AS p FROM s x)"
_SCORES = f"{X.VECTORS}, s AS (SELECT DISTINCT head, tail, relation, {_L1} AS energy FROM et x {_JOINS})"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    scored = score_transe_l1(spark, d)
    even = F.col("head").cast("long") % 2 == 0
    return evaluation.labelled(scored, scored.filter(even), scored.filter(~even))


@query(f"""WITH {_SCORES}, {_LABELS}, c AS (SELECT row_number() OVER o AS k, sum(p::int) OVER o AS tp, sum(p::int) OVER () AS n FROM la WINDOW o AS (ORDER BY energy, head, tail, relation)),
q AS (SELECT k, tp / k AS p, tp / n AS r FROM c), z AS (SELECT *, lag(p, 1, 1.0) OVER (ORDER BY k) AS p0, lag(r, 1, 0.0) OVER (ORDER BY k) AS r0 FROM q)
SELECT round(sum((r - r0) * (p + p0) / 2) + (1 - arg_max(r, k)) * arg_max(p, k) / 2, 9) AS auc FROM z""")
def auc_pr(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.auc_pr(_labelled(spark, d)).select(F.round("auc", 9).alias("auc"))


@query(f"""WITH {_SCORES}, {_LABELS}, m AS (SELECT unnest(range(0, ((trunc(max(energy) + 1) - trunc(min(energy))) * 2)::bigint + 1)) * 0.5 + trunc(min(energy)) AS threshold FROM la),
c AS (SELECT threshold::double AS threshold, count(*) FILTER (energy >= threshold AND p) AS tp, count(*) FILTER (energy >= threshold AND NOT p) AS fp, count(*) FILTER (p) AS n FROM m, la GROUP BY 1),
q AS (SELECT threshold, CASE WHEN tp + fp = 0 THEN 0.0::double ELSE tp / (tp + fp) END AS precision, CASE WHEN n = 0 THEN 0.0::double ELSE tp / n END AS recall FROM c)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM q""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.threshold_sweep(_labelled(spark, d))


@query(f"WITH {_SCORES} SELECT head, tail, relation, 1 - (energy - min(energy) OVER ()) / (max(energy) OVER () - min(energy) OVER ()) AS energy FROM s")
def energies_normalised(spark: SparkSession, d: str) -> DataFrame:
    return scoring.normalised(score_transe_l1(spark, d), "energy")


@query(f"WITH {_SCORES} SELECT * FROM s QUALIFY energy < max(energy) OVER () - (max(energy) OVER () - min(energy) OVER ()) * 0.5")
def energies_below_top_half(spark: SparkSession, d: str) -> DataFrame:
    return scoring.below_top_range(score_transe_l1(spark, d), 0.5)


@query(f"""WITH {_SCORES}, e AS (SELECT min(energy) AS a, max(energy) AS b FROM s), k AS (SELECT trunc((energy - a) / (b - a) * 10 - 1e-7)::int AS bucket, a, b FROM s, e)
SELECT bucket, a + bucket * ((b - a) / 10) AS lo, a + (bucket + 1) * ((b - a) / 10) AS hi, count(*) AS n FROM k GROUP BY bucket, a, b""")
def energy_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(score_transe_l1(spark, d), F.col("energy"))


@query(f"""WITH {_SCORES}, v AS (SELECT round(energy, 2) AS v FROM s), h AS (SELECT v, count(*) AS n FROM v GROUP BY v), e AS (SELECT count(*) AS triples, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance,
round(stddev_pop(v), 6) AS deviation, min(v) AS min, max(v) AS max FROM v), u AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS seen FROM h),
q AS (SELECT n, trunc((v - min - 1e-7) / (max - min) * 100)::bigint // 25 AS q FROM h, e)
SELECT triples, mean, variance, deviation, min, max, (SELECT min(v) FROM u WHERE seen >= triples // 2) AS median, (SELECT count(*) FROM h) AS distinct_values,
{', '.join(f"(SELECT coalesce(sum(n), 0)::bigint FROM q WHERE q = {i}) AS quarter_{i + 1}" for i in range(4))} FROM e""")
def energy_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.value_stats(score_transe_l1(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean", "variance", "deviation")})


@query(f"WITH {X.STRUCTURE} SELECT e AS entity, count(*) AS n FROM (SELECT unnest([head, tail]) AS e FROM tri) GROUP BY e")
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.entity_counts(X.structure(spark, d))


@query(f"WITH {X.STRUCTURE} SELECT relation, count(*) AS n FROM tri GROUP BY relation")
def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.relation_counts(X.structure(spark, d))


_COUNTS = "ec AS (SELECT e AS entity, count(*) AS n FROM (SELECT DISTINCT head, tail, relation, unnest([head, tail]) AS e FROM {0}) GROUP BY e), rc AS (SELECT relation, count(*) AS n FROM {0} GROUP BY relation)"


@query(f"WITH {X.STRUCTURE}, {_COUNTS.format('tri')} SELECT entity, n, ntile(100) OVER (ORDER BY n, entity)::int AS centile FROM ec")
def entity_centiles(spark: SparkSession, d: str) -> DataFrame:
    return relational.with_centiles(stats.entity_counts(X.structure(spark, d), once=True), "entity")


@query(f"""WITH {X.STRUCTURE}, {_COUNTS.format('tri')}, k AS (SELECT entity FROM ec WHERE n >= 10 AND entity NOT LIKE 'r:%')
SELECT head, tail, relation FROM tri WHERE head IN (SELECT entity FROM k) AND tail IN (SELECT entity FROM k) AND relation IN (SELECT relation FROM rc WHERE n >= 5)""")
def candidate_triples(spark: SparkSession, d: str) -> DataFrame:
    triples = settled(X.structure(spark, d))
    concepts = scoring.entity_universe(triples).filter("entity not like 'r:%'")
    return relational.candidates(triples, concepts).select(*KEY)


@query(f"""WITH {X.STRUCTURE}, {_COUNTS.format('tri')}, ek AS (SELECT entity FROM (SELECT entity, ntile(100) OVER (ORDER BY n, entity) AS c FROM ec) WHERE c BETWEEN 40 AND 100)
SELECT head, relation, tail, probability FROM (SELECT *, (length(head) + length(tail)) / 20.0::double AS probability FROM tri)
WHERE probability BETWEEN 0.4 AND 1 AND head IN (SELECT entity FROM ek) AND tail IN (SELECT entity FROM ek)
AND relation IN (SELECT relation FROM (SELECT relation, ntile(100) OVER (ORDER BY n, relation) AS c FROM rc) WHERE c BETWEEN 1 AND 100) ORDER BY head, relation, tail LIMIT 600000""")
def centile_dataset(spark: SparkSession, d: str) -> DataFrame:
    triples = settled(X.structure(spark, d).withColumn("probability", (F.length("head") + F.length("tail")) / F.lit(20.0)))
    return relational.selected(triples, (0.4, 1.0), (40, 100), (1, 100)).select("head", "relation", "tail", "probability")


_FIRST = """ps AS (SELECT *, row_number() OVER (ORDER BY head, tail, relation) AS pos FROM tri),
en AS (SELECT e AS key, row_number() OVER (ORDER BY min(side), arg_min(pos, side * 1000000000000 + pos)) - 1 AS idx
       FROM (SELECT head AS e, 0 AS side, pos FROM ps UNION ALL SELECT tail, 1, pos FROM ps) GROUP BY e),
re AS (SELECT relation AS key, row_number() OVER (ORDER BY min(pos)) - 1 AS idx FROM ps GROUP BY relation)"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    from trivane.operators.ranking import ranked

    return ranked(X.structure_rows(spark, d), [F.col(c) for c in KEY], rank="pos", distinct=True)


@query(f"WITH {X.STRUCTURE}, {_FIRST} SELECT key, idx FROM en")
def dense_entity_ids(spark: SparkSession, d: str) -> DataFrame:
    return ids.entity_ids(_placed(spark, d))


@query(f"""WITH {X.STRUCTURE}, {_FIRST} SELECT h.idx AS head, t.idx AS tail, r.idx AS relation FROM ps JOIN en h ON h.key = head JOIN en t ON t.key = tail JOIN re r ON r.key = relation""")
def dense_triples(spark: SparkSession, d: str) -> DataFrame:
    placed = _placed(spark, d)
    return ids.to_dense(placed, ids.entity_ids(placed), ids.relation_ids(placed)).select(*KEY)


@query(f"""WITH {X.ACTIVITY}, {_SPLIT.format('act')}, r AS (SELECT *, unnest(['Total', split]) AS label FROM sp), e AS (SELECT label, relation, unnest([head, tail]) AS entity FROM r),
pe AS (SELECT label, entity, count(DISTINCT relation) AS a, count(*) AS b FROM e GROUP BY ALL), pr AS (SELECT label, relation, count(DISTINCT entity) AS a, count(*) / 2 AS b FROM e GROUP BY ALL),
x AS (SELECT label, count(*) AS entities, avg(a) AS relations_per_entity_mean, median(a) AS relations_per_entity_median, avg(b) AS triples_per_entity_mean, median(b) AS triples_per_entity_median FROM pe GROUP BY label),
y AS (SELECT label, count(*) AS relations, avg(a) AS entities_per_relation_mean, median(a) AS entities_per_relation_median, avg(b) AS triples_per_relation_mean, median(b) AS triples_per_relation_median FROM pr GROUP BY label)
SELECT *, triples / entities AS triples_per_entity, triples / relations AS triples_per_relation FROM (SELECT label, count(*) AS triples FROM r GROUP BY label) JOIN x USING (label) JOIN y USING (label)""")
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.dataset_stats(perturb.split(X.activity(spark, d)))


@query(f"WITH {X.STRUCTURE} SELECT * FROM tri ORDER BY {_ORDER}, head, tail, relation LIMIT 1000")
def sample_triples(spark: SparkSession, d: str) -> DataFrame:
    return perturb.sample_triples(settled(X.structure(spark, d)), 1000)


@query(f"""WITH {X.STRUCTURE}, u AS MATERIALIZED (SELECT DISTINCT unnest([head, tail]) AS e FROM tri), k AS MATERIALIZED (SELECT e FROM u ORDER BY {_md5('4', 'e')}, e LIMIT 500)
SELECT tri.* FROM tri JOIN k a ON a.e = head JOIN k b ON b.e = tail""")
def sample_entities(spark: SparkSession, d: str) -> DataFrame:
    return perturb.sample_entities(settled(X.structure(spark, d)), 500)


@query(f"""WITH {X.ACTIVITY}, p AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY {_ORDER}, head, tail, relation) AS place, count(*) OVER (PARTITION BY relation) AS n FROM act),
g AS (SELECT relation, place FROM p WHERE place < n ORDER BY place, {_md5('4', 'relation')}, relation LIMIT 300)
SELECT head, tail, p.relation, g.place IS NOT NULL AS removed FROM p LEFT JOIN g ON g.relation = p.relation AND g.place = p.place""")
def sparser_rounds(spark: SparkSession, d: str) -> DataFrame:
    return perturb.sparser(X.activity(spark, d), 300, mode="rounds")


_WAIT = f"floor(-ln((('0x' || substr({_md5('4:clock', *KEY)}, 1, 8))::bigint + 1) / 4294967296.0::double) * 16777216)::bigint"


@query(f"""WITH {X.ACTIVITY}, p AS (SELECT *, row_number() OVER w AS place, sum({_WAIT}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS time, count(*) OVER (PARTITION BY relation) AS n
  FROM act WINDOW w AS (PARTITION BY relation ORDER BY {_ORDER}, head, tail, relation)),
g AS (SELECT relation, place FROM p WHERE place < n ORDER BY time, {_md5('4', 'relation')}, relation, place LIMIT 300)
SELECT head, tail, p.relation, g.place IS NOT NULL AS removed FROM p LEFT JOIN g ON g.relation = p.relation AND g.place = p.place""")
def sparser_draw(spark: SparkSession, d: str) -> DataFrame:
    return perturb.sparser(X.activity(spark, d), 300)


@query(f"""WITH {X.ACTIVITY}, c AS (SELECT relation, count(*) AS n FROM act GROUP BY relation), u AS (SELECT *, sum(n) OVER (ORDER BY {_md5('4', 'relation')}, relation) AS upto FROM c)
SELECT head, tail, relation, relation IN (SELECT relation FROM u WHERE upto - n < 300) AS removed FROM act""")
def relations_removed(spark: SparkSession, d: str) -> DataFrame:
    triples = X.activity(spark, d)
    return perturb.without_relations(triples, perturb.removal_relations(triples, 300))


_PAIRS = f"""k AS (SELECT relation, row_number() OVER (ORDER BY {_md5('4', 'relation')}, relation) AS r FROM (SELECT DISTINCT relation FROM act)),
m AS (SELECT a.relation AS source, b.relation AS target FROM k a JOIN k b ON b.r = a.r + 1 WHERE a.r % 2 = 1 AND a.r <= 4)"""


@query(f"WITH {X.ACTIVITY}, {_PAIRS} SELECT head, tail, coalesce(target, relation) AS relation FROM act LEFT JOIN m ON source = relation")
def relations_collapsed(spark: SparkSession, d: str) -> DataFrame:
    triples = X.activity(spark, d)
    return ids.rewritten(triples, perturb.collapse_map(triples, 2)).select(*KEY)


def corrupt_sql(chosen: str, triples: str) -> str:
    """CTEs that end in ``ch`` (head, tail, relation, w), w the replaced triple."""
    number = lambda what: f"('0x' || substr(md5(concat_ws(':', '4:{what}', head, tail, relation, attempt)), 1, 8))::bigint"
    return f"""ea AS MATERIALIZED (SELECT e AS new, row_number() OVER (ORDER BY e) AS at FROM (SELECT DISTINCT unnest([head, tail]) AS e FROM {triples})),
ra AS MATERIALIZED (SELECT relation AS new, row_number() OVER (ORDER BY relation) AS at FROM (SELECT DISTINCT relation FROM {triples})),
ct AS (SELECT head, tail, relation, unnest(range(0, 16)) AS attempt FROM {chosen}), cd AS (SELECT *, {number('part')} % 3 AS part, {number('value')} AS value FROM ct),
cn AS (SELECT cd.*, coalesce(ea.new, ra.new) AS new FROM cd LEFT JOIN ea ON part <> 2 AND ea.at = value % (SELECT count(*) FROM ea) + 1 LEFT JOIN ra ON part = 2 AND ra.at = value % (SELECT count(*) FROM ra) + 1),
cx AS (SELECT head, tail, relation, attempt, CASE part WHEN 0 THEN new ELSE head END AS h, CASE part WHEN 1 THEN new ELSE tail END AS t, CASE part WHEN 2 THEN new ELSE relation END AS r FROM cn),
ch AS (SELECT head, tail, relation, arg_min({{'h': h, 't': t, 'r': r}}, attempt) AS w FROM cx WHERE NOT EXISTS (SELECT 1 FROM {triples} k WHERE k.head = h AND k.tail = t AND k.relation = r) GROUP BY ALL)"""


@query(f"""WITH {X.ACTIVITY}, {_SPLIT.format('act')}, tn AS (SELECT head, tail, relation, row_number() OVER (ORDER BY {_ORDER}, head, tail, relation) <= trunc(count(*) OVER () * 0.05) AS chosen FROM sp WHERE split = 'train'),
cc AS (SELECT * FROM tn WHERE chosen), {corrupt_sql('cc', 'sp')}
SELECT coalesce(w.h, tn.head) AS head, coalesce(w.t, tn.tail) AS tail, coalesce(w.r, tn.relation) AS relation, 'train' AS split, chosen AS corrupted FROM tn LEFT JOIN ch ON ch.head = tn.head AND ch.tail = tn.tail AND ch.relation = tn.relation
UNION ALL SELECT head, tail, relation, split, false FROM sp WHERE split <> 'train'""")
def corrupted(spark: SparkSession, d: str) -> DataFrame:
    return perturb.corrupted(perturb.split(X.activity(spark, d)), 0.05)


#: Shares of noise of the grid.
SHARES = [i / 10 for i in range(1, 10)]


@query(f"""WITH {X.ACTIVITY}, o AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}, head, tail, relation) AS k FROM act), b AS (SELECT *, ((k - 1) // 50)::int AS block FROM o WHERE k <= 300 AND (k - 1) // 50 < 6),
i AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY {_md5('4:corrupt', *KEY)}, head, tail, relation) AS j FROM b)
SELECT level::int AS level, share::double AS share, head, tail, relation, j <= trunc(share * 50::double) AS corrupt FROM i, (SELECT unnest(range(0, 6)) AS level), (SELECT i / 10.0 AS share FROM range(1, 10) s(i)) WHERE level >= block""")
def sparsity_noise_grid(spark: SparkSession, d: str) -> DataFrame:
    return perturb.grid(X.activity(spark, d), 300, 50, 6, SHARES)


#: Rules over the structural relations.
RULES = [("RSub", "in_nation", "located_in"), ("RSub", "in_region", "located_in"), ("RSub", "located_in", "related_to"), ("Inv", "located_in", "holds"), ("Inv", "placed_by", "places")]


@query(f"""WITH RECURSIVE {X.STRUCTURE}, ru(relation, target, swap) AS (VALUES {', '.join([f"('{s}', '{t}', false)" for k, s, t in RULES if k == 'RSub'] + [x for k, s, t in RULES if k == 'Inv' for x in (f"('{s}', '{t}', true)", f"('{t}', '{s}', true)")])}),
g AS (SELECT head, tail, relation FROM tri UNION SELECT CASE WHEN swap THEN tail ELSE head END, CASE WHEN swap THEN head ELSE tail END, target FROM g JOIN ru USING (relation)) SELECT * FROM g""")
def ontology_expanded(spark: SparkSession, d: str) -> DataFrame:
    return ontology.expanded(X.structure(spark, d), spark.createDataFrame(RULES, "type string, src string, dst string"))


@query(f"""WITH {X.STRUCTURE}, b AS (SELECT head AS entity, tail AS o FROM tri UNION SELECT tail, head FROM tri) SELECT entity, array_to_string(list_sort(list(o)), ' ') AS neighbours FROM b GROUP BY entity""")
def entity_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return perturb.adjacency(X.structure(spark, d)).select("entity", F.concat_ws(" ", "neighbours").alias("neighbours"))


@query(f"""WITH RECURSIVE {X.ACTIVITY}, en AS MATERIALIZED (SELECT head AS entity, tail AS other FROM act UNION ALL SELECT tail, head FROM act),
go(round, chosen, held, entities) AS (SELECT 0, []::varchar[], 0::bigint, 0::bigint UNION ALL
  SELECT round + 1, now, (SELECT count(*) FROM act WHERE list_contains(now, head) OR list_contains(now, tail)), (SELECT count(DISTINCT e) FROM (SELECT unnest([entity, other]) AS e FROM en WHERE list_contains(now, entity)))
  FROM (SELECT round, list_append(chosen, arg_min(entity, (abs(3.3478::double - (held + c)::double / (entities + n + 1)), entity))) AS now FROM (
    SELECT round, chosen, held, entities, entity, count(*) FILTER (NOT list_contains(chosen, other)) AS c, count(DISTINCT other) FILTER (NOT list_contains(chosen, other)) AS n
    FROM go, en WHERE held < 3000 AND NOT list_contains(chosen, entity) GROUP BY ALL) GROUP BY round, chosen)),
la AS (SELECT arg_max(chosen, round) AS chosen FROM go), ro AS (SELECT head, tail, relation, nullif(list_position(chosen, head), 0) AS a, nullif(list_position(chosen, tail), 0) AS b FROM act, la)
SELECT head, tail, relation, least(coalesce(a, b), coalesce(b, a))::int AS round FROM ro WHERE a IS NOT NULL OR b IS NOT NULL""")
def density_groomed(spark: SparkSession, d: str) -> DataFrame:
    """One entity a round, until 3000 triples are taken."""
    return perturb.groomed(X.activity(spark, d), most=3000)


_OFTEN = "SELECT e FROM (SELECT unnest([head, tail]) AS e FROM t) GROUP BY e HAVING count(*) >= 10"


@query(f"""WITH {X.ACTIVITY}, {_SPLIT.format('act')}, t AS (SELECT head, tail, relation FROM sp WHERE split = 'train')
SELECT head, tail, relation FROM sp WHERE split = 'test' AND head IN ({_OFTEN}) AND tail IN ({_OFTEN})
AND relation IN (SELECT relation FROM t GROUP BY relation HAVING count(*) >= 5)""")
def frequent_test_triples(spark: SparkSession, d: str) -> DataFrame:
    triples = settled(perturb.split(X.activity(spark, d)))
    return stats.frequent_triples(triples.filter("split = 'test'"), triples.filter("split = 'train'")).select(*KEY)


@query(f"WITH {_SCORES} SELECT head, tail, relation, energy, CASE WHEN head::bigint % 2 = 0 THEN 'O' ELSE 'X' END || ' -- ' || head || ' :: ' || relation || ' :: ' || tail AS line FROM s ORDER BY energy DESC, head, tail, relation LIMIT 10")
def top_readable(spark: SparkSession, d: str) -> DataFrame:
    scored = score_transe_l1(spark, d)
    return evaluation.readable_top(scored, scored.filter(F.col("head").cast("long") % 2 == 0))


@query(f"WITH {X.STRUCTURE}, {_COUNTS.format('tri')} SELECT relation, n, ntile(100) OVER (ORDER BY n, relation)::int AS centile FROM rc")
def relation_centiles(spark: SparkSession, d: str) -> DataFrame:
    return relational.with_centiles(stats.relation_counts(X.structure(spark, d)), "relation")


@query(f"""WITH {X.STRUCTURE}, c AS (SELECT e, count(*)::double AS v FROM (SELECT unnest([head, tail]) AS e FROM tri) GROUP BY e), k AS (SELECT min(v) AS a, max(v) AS b FROM c),
p AS (SELECT trunc((v - a) / (b - a) * 10 - 1e-7)::int AS bucket, a, b FROM c, k) SELECT bucket, a + bucket * ((b - a) / 10) AS lo, a + (bucket + 1) * ((b - a) / 10) AS hi, count(*) AS n FROM p GROUP BY bucket, a, b""")
def entity_count_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(stats.entity_counts(X.structure(spark, d)), F.col("n"))


@query(f"WITH {X.STRUCTURE}, {_FIRST} SELECT key, idx FROM re")
def dense_relation_ids(spark: SparkSession, d: str) -> DataFrame:
    return ids.relation_ids(_placed(spark, d))


@query(f"""WITH {X.STRUCTURE}, {_FIRST} SELECT head, tail, relation, h.idx AS head_idx, t.idx AS tail_idx, r.idx AS relation_idx FROM ps JOIN en h ON h.key = head JOIN en t ON t.key = tail JOIN re r ON r.key = relation""")
def external_triples(spark: SparkSession, d: str) -> DataFrame:
    placed = _placed(spark, d)
    entities, relations = settled(ids.entity_ids(placed)), settled(ids.relation_ids(placed))
    dense = ids.to_dense(placed, entities, relations)
    dense = dense.withColumns({f"{c}_idx": F.col(c) for c in KEY}).drop("pos")
    return ids.to_external(dense, entities, relations)


@query(f"WITH {X.STRUCTURE}, {_FIRST} SELECT key, row_number() OVER (ORDER BY idx) - 1 AS idx FROM en WHERE key NOT LIKE 'o:%'")
def redensified_ids(spark: SparkSession, d: str) -> DataFrame:
    entities = settled(ids.entity_ids(_placed(spark, d)))
    return ids.redensified(entities, entities.filter("key like 'o:%'"))


@query(f"""WITH {X.VECTORS}, s AS (SELECT DISTINCT head, tail, relation, {_L1} AS energy FROM et x {_JOINS} WHERE head::bigint % 2 = 0), e AS (SELECT min(energy) AS a, max(energy) AS b FROM s)
SELECT et.head, et.tail, et.relation, CASE WHEN s.head IS NULL THEN 0.5 ELSE 1 - (energy - a) / (b - a) END::double AS confidence
FROM et LEFT JOIN s ON et.head = s.head AND et.tail = s.tail AND et.relation = s.relation, e""")
def confidences_replaced(spark: SparkSession, d: str) -> DataFrame:
    triples = X.embedded_triples(spark, d).withColumn("confidence", F.lit(0.5))
    return scoring.replaced_confidence(triples, score_transe_l1(spark, d).filter("cast(head as long) % 2 = 0")).select(*KEY, "confidence")


#: For compiled datasets: triples whose hash is 0 are gold, the others have 0.5 to 0.9 as confidence.
_CHANCE = f"('0x' || substr({_md5('c', *KEY)}, 1, 8))::bigint % 10"


def _confident(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = X.activity(spark, d).withColumn("chance", C.hash_int("c", *map(F.col, KEY)) % 10)
    return rows.filter("chance > 0").withColumn("confidence", F.col("chance") / 10), rows.filter("chance = 0")


def _compiled_sql(train: str, often: int, often_relation: int) -> str:
    at_least = f"SELECT e FROM (SELECT unnest([head, tail]) AS e FROM t) GROUP BY e HAVING count(*) >= {often}"
    return f"""WITH {X.ACTIVITY}, a AS (SELECT *, {_CHANCE} AS chance FROM act), t AS ({train}),
g AS (SELECT head, tail, relation FROM a WHERE chance = 0 AND head IN ({at_least}) AND tail IN ({at_least})
      AND relation IN (SELECT relation FROM t GROUP BY relation HAVING count(*) >= {often_relation}))
SELECT head, tail, relation, 'train' AS split FROM t UNION ALL
SELECT head, tail, relation, CASE WHEN row_number() OVER (ORDER BY {_ORDER}, head, tail, relation) <= count(*) OVER () // 2 THEN 'test' ELSE 'valid' END FROM g"""


@query(_compiled_sql("SELECT head, tail, relation FROM a WHERE chance / 10.0 >= 0.5 UNION SELECT DISTINCT head, 'any', '0' FROM a WHERE chance > 0", 10, 5))
def dataset_compiled(spark: SparkSession, d: str) -> DataFrame:
    source, gold = _confident(spark, d)
    train = settled(compiled.training(source, 0.5, source.select("head", F.lit("any").alias("tail"))))
    return compiled.with_gold(train, gold)


@query(_compiled_sql("SELECT head, tail, relation FROM a WHERE chance > 0", 1, 1))
def dataset_compiled_strict(spark: SparkSession, d: str) -> DataFrame:
    source, gold = _confident(spark, d)
    return compiled.with_gold(settled(compiled.training(source)), gold, 1, 1)


@query(f"""WITH {X.ACTIVITY}, a AS (SELECT *, {_CHANCE} AS chance FROM act), t AS (SELECT head, tail, relation FROM a WHERE chance > 0), k AS (SELECT unnest([head, tail]) AS e FROM t)
SELECT *, 'train' AS split FROM t UNION ALL SELECT head, tail, relation, 'test' FROM a
WHERE chance = 0 AND length(tail) % 2 = 0 AND head IN (SELECT e FROM k) AND tail IN (SELECT e FROM k) AND relation IN (SELECT relation FROM t)""")
def dataset_annotated(spark: SparkSession, d: str) -> DataFrame:
    source, gold = _confident(spark, d)
    return compiled.extracted(source, gold.select(*KEY, (F.length("tail") % 2 == 0).alias("is_valid")))


_MEASURES = ["triples", "entities", "relations", *(f"{a}_per_{b}_{m}" for a, b in (("relations", "entity"), ("triples", "entity"), ("entities", "relation"), ("triples", "relation")) for m in ("mean", "median")), "triples_per_entity", "triples_per_relation"]


@query(f"""WITH st AS ({_sql['dataset_stats']}) SELECT {', '.join(f"max({m}) FILTER (label = '{x}') AS {x}_{m}" for x in ('Total', 'test', 'train', 'valid') for m in _MEASURES)} FROM st""")
def dataset_stats_row(spark: SparkSession, d: str) -> DataFrame:
    """All measures of all labels: 52 columns."""
    return stats.stats_row(dataset_stats(spark, d))


def queries() -> dict[str, Query]:
    from trivane.plans import dataset_queries, source_queries  # noqa: F401  they register theirs

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
