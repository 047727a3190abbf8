"""Queries of the readers and writers: rows of the driver's tables are written to files and read back, and the SQL has them from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.functions import columns as C
from trivane.plans import fixture as X
from trivane.plans.queries import query
from trivane.shared import new_path
from trivane.sources import readers

T = X.table
TAB = "\t"


def _lines(df: DataFrame, line: Column, order: list[str], path: str, compressed: bool = False) -> str:
    """Ordered part files of lines, as many as the session's shuffles have partitions; with ``compressed`` gzip."""
    writer = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    writer.select(line.alias("value")).write.mode("append").option("compression", "gzip" if compressed else "none").text(path)
    return path


def _row(*cells: Column) -> Column:
    """Cells between tabs, with blanks beside some of them."""
    return F.concat_ws("\t", *[F.concat(F.lit(" " * (i % 2)), c.cast("string"), F.lit(" " * (i % 3))) for i, c in enumerate(cells)])


def _s(name: str) -> Column:
    return F.col(name).cast("string")


@query(f"WITH {X.ACTIVITY} SELECT * FROM act")
def source_triples(spark: SparkSession, d: str) -> DataFrame:
    path = _lines(X.activity(spark, d), _row(F.col("head"), F.col("tail"), F.col("relation")), ["head"], new_path(spark, "triples"))
    _lines(spark.range(2), F.lit("  "), ["id"], path)  # blank lines are none
    return readers.triples(spark, path)


@query("SELECT id, arg_max('c:' || o_custkey, o_orderkey) AS head, arg_max(o_orderstatus, o_orderkey) AS tail, arg_max(o_orderpriority, o_orderkey) AS relation FROM (SELECT *, o_orderkey % 500 AS id FROM orders) GROUP BY id")
def source_triples_with_id(spark: SparkSession, d: str) -> DataFrame:
    line = _row(F.col("o_orderkey") % 500, F.concat(F.lit("c:"), _s("o_custkey")), F.col("o_orderstatus"), F.col("o_orderpriority"))
    return readers.triples_with_id(spark, _lines(T(spark, d, "orders"), line, ["o_orderkey"], new_path(spark, "ids")))


@query("SELECT 'u:' || user_id AS head, 'e:' || event_id AS tail, event_type AS relation, value AS energy FROM events")
def source_scored_triples(spark: SparkSession, d: str) -> DataFrame:
    line = _row(F.concat(F.lit("u:"), _s("user_id")), F.concat(F.lit("e:"), _s("event_id")), F.col("event_type"), F.coalesce(_s("value"), F.lit("")))
    return readers.scored_triples(spark, _lines(T(spark, d, "events"), line, ["event_id"], new_path(spark, "scored")))


_LAST = "SELECT user_id::varchar AS id, arg_max(value, event_id) AS value FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY user_id"


def _values(spark: SparkSession, d: str) -> str:
    rows = T(spark, d, "events").filter("user_id is not null and value is not null")
    return _lines(rows, _row(F.col("user_id"), F.col("value")), ["event_id"], new_path(spark, "values"))


@query(_LAST)
def source_energies(spark: SparkSession, d: str) -> DataFrame:
    """Of a repeated id the last line counts."""
    return readers.energies(spark, _values(spark, d))


@query(f"WITH v AS ({_LAST}) SELECT id, 1 - (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value FROM v")
def source_ranks(spark: SparkSession, d: str) -> DataFrame:
    return readers.ranks(spark, _values(spark, d))


@query("SELECT n_name AS key, n_nationkey::bigint AS idx FROM nation")
def source_id_map(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "map")
    return readers.id_map(spark, _lines(T(spark, d, "nation"), _row(F.col("n_name"), F.col("n_nationkey")), ["n_nationkey"], path))


_COMPONENTS = "SELECT {0} AS idx, (unnest(range(0, len(embedding))))::int AS pos, unnest(list_transform(embedding, lambda x: x::double)) AS x FROM {1}"


def _vector(name: str = "embedding", end: str = "") -> Column:
    return F.concat(F.concat_ws("\t", F.transform(name, lambda x: x.cast("double").cast("string"))), F.lit(end))


def _components(df: DataFrame, *kept: str) -> DataFrame:
    return df.select(*kept, "idx", F.posexplode("vec").alias("pos", "x"))


@query(_COMPONENTS.format("row_number() OVER (ORDER BY vec_id) - 1", "embeddings"))
def source_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _components(readers.vectors(spark, _lines(T(spark, d, "embeddings"), _vector(), ["vec_id"], new_path(spark, "vectors"))))


_LABEL_VECTORS = "lv AS (SELECT label, arg_min(embedding, vec_id) AS embedding, arg_max(embedding, vec_id) AS w FROM embeddings GROUP BY label)"


def _label_vectors(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.max_by("embedding", "vec_id").alias("w"))


def _embedding(spark: SparkSession, d: str, folder: str, ending: str) -> str:
    """A folder of the vectors of the test tables: entities by vec_id, relations by label, and their weights."""
    _lines(T(spark, d, "embeddings"), _vector(), ["vec_id"], f"{folder}/entity2vec.{ending}")
    _lines(_label_vectors(spark, d), _vector(), ["label"], f"{folder}/relation2vec.{ending}")
    _lines(_label_vectors(spark, d), _vector("w"), ["label"], f"{folder}/weights.{ending}")
    return folder


@query(f"""WITH {_LABEL_VECTORS}, e AS ({_COMPONENTS.format('row_number() OVER (ORDER BY vec_id) - 1', 'embeddings')}), r AS ({_COMPONENTS.format('row_number() OVER (ORDER BY label) - 1', 'lv')}),
w AS ({_COMPONENTS.format('row_number() OVER (ORDER BY label) - 1', '(SELECT label, w AS embedding FROM lv)')})
SELECT 'entity' AS kind, * FROM e UNION ALL SELECT 'relation', * FROM r UNION ALL SELECT 'weight', * FROM w""")
def source_embedding_folder(spark: SparkSession, d: str) -> DataFrame:
    """Without files of one ending those of the next are taken."""
    folder = _embedding(spark, d, new_path(spark, "embedding"), "bern")
    entities, relations = readers.embedding_folder(spark, folder)
    parts = [entities.withColumn("kind", F.lit("entity")), relations.drop("w").withColumn("kind", F.lit("relation")), relations.select("idx", F.col("w").alias("vec"), F.lit("weight").alias("kind"))]
    return _components(parts[0].unionByName(parts[1]).unionByName(parts[2]), "kind")


@query(f"""WITH {_LABEL_VECTORS}, x AS (SELECT row_number() OVER (ORDER BY label) - 1 AS idx, embedding AS a, w AS b FROM lv)
SELECT idx, i::int AS i, j::int AS j, a[i + 1]::double * b[j + 1]::double AS w1, b[i + 1]::double * a[j + 1]::double AS w2 FROM x, range(0, 64) p(i), range(0, 64) q(j)""")
def source_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Matrices of 64 lines each, whose lines end in a tab; the size stands in the folder's name."""
    folder = new_path(spark, "m") + "/STransE_x_[distance:1,size:64]"
    rows = _label_vectors(spark, d)
    _lines(T(spark, d, "embeddings"), _vector(), ["vec_id"], f"{folder}/x.entity2vec")
    _lines(rows, _vector(), ["label"], f"{folder}/x.relation2vec")
    for name, a, b in (("W1", "embedding", "w"), ("W2", "w", "embedding")):
        matrix = rows.select("label", F.posexplode(a).alias("i", "x"), b).withColumn("row", F.transform(b, lambda y: F.col("x").cast("double") * y.cast("double")))
        _lines(matrix, _vector("row", "\t"), ["label", "i"], f"{folder}/x.{name}")
    _, relations = readers.embedding_folder(spark, folder)
    each = relations.select("idx", F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "z"))
    return each.select("idx", "i", F.posexplode(F.arrays_zip("z.w1", "z.w2")).alias("j", "y")).select("idx", "i", "j", "y.w1", "y.w2")


_FILES = ("label-train-uniq-raw-rel.db.TRAIN", "NELL.08m.165.cesv.csv.CandRel_CBL.out")
_CONFIDENT = "cf AS (SELECT event_id % 2 AS file, (user_id % 50)::varchar AS head, (event_id % 7)::varchar AS tail, event_type AS relation, (event_id % 11) / 10.0::double AS confidence FROM events WHERE user_id IS NOT NULL)"


def _confident_folder(spark: SparkSession, d: str, name: str = "event_id % 2") -> str:
    folder = new_path(spark, "confident")
    rows = T(spark, d, "events").filter("user_id is not null")
    for i, file in enumerate(_FILES):
        line = _row(F.col("user_id") % 50, F.col("event_id") % 7, F.col("event_type"), F.col("event_id") % 11 / F.lit(10.0))
        _lines(rows.filter(F.expr(name) == i), line, ["event_id"], f"{folder}/{file}")
    return folder


@query(f"WITH {_CONFIDENT} SELECT head, tail, relation, confidence, confidence < 0.5 AS rejected FROM cf WHERE file = 0")
def source_confident(spark: SparkSession, d: str) -> DataFrame:
    accepted, rejected = readers.confident(spark, f"{_confident_folder(spark, d)}/{_FILES[0]}", 0.5)
    return accepted.withColumn("rejected", F.lit(False)).unionByName(rejected.withColumn("rejected", F.lit(True)))


@query(f"WITH {_CONFIDENT} SELECT head, tail, relation, max(confidence) AS confidence, (SELECT count(*) FROM cf WHERE confidence < 0.5) AS rejected FROM cf WHERE confidence >= 0.5 GROUP BY ALL")
def source_all_confident(spark: SparkSession, d: str) -> DataFrame:
    accepted, rejected = readers.all_confident(spark, _confident_folder(spark, d), _FILES, 0.5)
    return accepted.crossJoin(rejected)  # one row


@query(f"WITH {_CONFIDENT} SELECT DISTINCT head, tail, relation FROM cf WHERE confidence >= 0.1")
def source_gold(spark: SparkSession, d: str) -> DataFrame:
    return readers.gold(spark, _confident_folder(spark, d), _FILES)


@query("SELECT DISTINCT (user_id % 50)::varchar AS head, (event_id % 7)::varchar AS tail, '0' AS relation FROM events WHERE user_id IS NOT NULL AND (event_id % 11) / 10.0::double >= 0.3")
def source_categories(spark: SparkSession, d: str) -> DataFrame:
    rows, paths = T(spark, d, "events").filter("user_id is not null"), []
    for i in range(2):
        line = _row(F.col("user_id") % 50, F.col("event_id") % 7, F.col("event_id") % 11 / F.lit(10.0))
        paths.append(_lines(rows.filter(F.col("event_id") % 2 == i), line, ["event_id"], new_path(spark, "categories")))
    return readers.categories(spark, paths, 0.3)


@query(f"""SELECT type, src, arg_max(dst, pos) AS dst FROM (SELECT unnest([{', '.join(f"'{x}'" for x in readers.ONTOLOGY_TYPES)}]) AS type, (n_nationkey % 10)::varchar AS src, n_name AS dst, n_nationkey AS pos FROM nation)
GROUP BY type, src""")
def source_ontology(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "ontology")
    for kind in readers.ONTOLOGY_TYPES:
        _lines(T(spark, d, "nation"), _row(F.col("n_nationkey") % 10, F.col("n_name")), ["n_nationkey"], f"{folder}/165.onto-wbpg.db.{kind}.txt")
    return readers.ontology(spark, folder)


@query("SELECT DISTINCT c_name AS head, (c_nationkey % 3)::varchar AS tail, c_mktsegment AS relation FROM customer")
def source_reverb(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "customer")
    line = _row(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey") % 3, F.lit(0.5))
    path = _lines(rows, line, ["c_custkey"], new_path(spark, "reverb"))
    return readers.reverb(spark, _lines(rows, line, ["c_custkey"], path))


@query("""SELECT lower(replace(c_name, '#', ' ')).replace(' ', '_') AS head, 'seg_' || (c_nationkey % 3) AS tail, lower(c_mktsegment) AS relation, c_custkey % 2 = 1 AS is_valid, (c_custkey % 10) / 10.0::double AS confidence
FROM customer WHERE c_custkey % 5 <> 0""")
def source_reverb_annotations(spark: SparkSession, d: str) -> DataFrame:
    parts = F.concat(F.lit("("), F.translate("c_name", "#", " "), F.lit(" ; "), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("; Seg "), (F.col("c_nationkey") % 3).cast("string"))).otherwise(""), F.lit(")"))
    path = _lines(T(spark, d, "customer"), _row(F.col("c_custkey") % 2, F.col("c_custkey") % 10 / F.lit(10.0), parts), ["c_custkey"], new_path(spark, "annotated"))
    return readers.reverb_annotations(spark.read.text(path))


@query("SELECT lower(c_name) AS head, (c_nationkey % 3)::varchar AS tail, lower(c_mktsegment) AS relation FROM customer UNION ALL SELECT lower(c_name), (c_nationkey % 3)::varchar, lower(c_mktsegment) FROM customer")
def source_reverb_full(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "customer")
    line = _row(*[F.lit("x")] * 4, F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey") % 3, F.lit("y"))
    path = _lines(rows, line, ["c_custkey"], new_path(spark, "full"))
    return readers.reverb_full(spark.read.text(_lines(rows, line, ["c_custkey"], path)))


@query("""SELECT 'm.' || o_orderkey AS head, 'm.' || o_custkey AS tail, CASE WHEN o_orderkey % 2 = 0 THEN 'type.object' ELSE 'label' END AS relation FROM orders""")
def source_freebase(spark: SparkSession, d: str) -> DataFrame:
    return readers.freebase(readers.lines(spark, rdf_dump(spark, d)))


def rdf_dump(spark: SparkSession, d: str) -> str:
    """A compressed dump."""
    key = lambda p, c: F.concat(F.lit(f"<{p}"), c, F.lit(">"))
    ns = "http://rdf.freebase.com/ns/"
    relation = F.when(F.col("o_orderkey") % 2 == 0, key(ns, F.lit("type.object"))).otherwise(key("http://www.w3.org/2000/01/rdf-schema#", F.lit("label")))
    line = F.concat(key(ns, F.concat(F.lit("m."), _s("o_orderkey"))), F.lit(TAB), relation, F.lit("  "), key(ns, F.concat(F.lit("m."), _s("o_custkey"))), F.lit("\t."))
    return _lines(T(spark, d, "orders"), line, ["o_orderkey"], new_path(spark, "rdf"), compressed=True)


@query("""SELECT printf('%08d', n_nationkey) AS head, printf('%08d', n_regionkey + 100) AS tail, '_hypernym' AS relation FROM nation
UNION ALL SELECT printf('%08d', n_nationkey), printf('%08d', n_regionkey + 200), '_hyponym' FROM nation WHERE n_nationkey % 2 = 1""")
def source_wordnet(spark: SparkSession, d: str) -> DataFrame:
    folder = lexical_folder(spark, d)
    return readers.wordnet(readers.lines(spark, [f"{folder}/data.{x}" for x in _SPEECH]))


_SPEECH = ("noun", "verb", "adj", "adv")


def lexical_folder(spark: SparkSession, d: str) -> str:
    """Files by part of speech, here with nouns in all. Lines of ten words (0a) and one or two pointers; licence lines are left out."""
    pad = lambda c: F.format_string("%08d", c.cast("long"))
    two = F.col("n_nationkey") % 2 == 1
    second = F.when(two, F.concat(F.lit(" ~ "), pad(F.col("n_regionkey") + 200), F.lit(" n 0000"))).otherwise("")
    line = F.concat(pad(F.col("n_nationkey")), F.lit(" 03 n 0a"), F.lit(" w 0" * 10), F.when(two, " 002").otherwise(" 001"), F.lit(" @ "), pad(F.col("n_regionkey") + 100), F.lit(" n 0000"), second, F.lit(" | a gloss; @ 5"))
    folder = new_path(spark, "lexical")
    for i, name in enumerate(_SPEECH):
        path = _lines(T(spark, d, "nation").filter(F.col("n_nationkey") % 4 == i), line, ["n_nationkey"], f"{folder}/data.{name}")
        _lines(spark.range(1), F.lit("  1 licence"), ["id"], path)
    return folder


def dump(spark: SparkSession, d: str) -> DataFrame:
    """A dump of 13 columns of parts: what a part is made by, and its size."""
    rows = T(spark, d, "part")
    part = F.concat(F.lit("concept:part:"), _s("p_partkey"))
    made = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("concept:"), F.col("p_brand"))).otherwise(F.col("p_brand"))
    cells = [part, F.when(F.col("p_partkey") % 2 == 0, "concept:made_by").otherwise("concept:has_size"), F.when(F.col("p_partkey") % 2 == 0, made).otherwise(_s("p_size")), F.concat(F.lit("["), (F.col("p_partkey") % 9).cast("string"), F.lit("]"))]
    cells += [F.when(F.col("p_partkey") % 10 == 0, "NaN").otherwise((F.col("p_partkey") % 10 / F.lit(10.0)).cast("string")), F.lit("MBL%20a+b"), F.lit("a b"), F.lit("c"), F.lit("a"), F.lit("c"), F.lit("x"), F.lit("x y"), F.lit("s")]
    line = F.concat_ws("\t", *cells)
    path = _lines(spark.range(1), F.lit("Entity\tRelation\tValue"), ["id"], new_path(spark, "dump"))
    _lines(rows, line, ["p_partkey"], path)
    return readers.belief_dump(spark.read.text(_lines(rows.filter("p_partkey <= 20"), line, ["p_partkey"], path)))


_DUMP = """pd AS (SELECT *, 'concept:part:' || p_partkey AS entity, CASE WHEN p_partkey % 2 = 0 THEN 'concept:made_by' ELSE 'concept:has_size' END AS relation,
CASE WHEN p_partkey % 2 = 1 THEN p_size::varchar WHEN p_partkey % 3 = 0 THEN 'concept:' || p_brand ELSE p_brand END AS value, (p_partkey % 9)::int AS iteration, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE (p_partkey % 10) / 10.0::double END AS probability FROM part)"""


@query(f"WITH {_DUMP} SELECT entity, relation, value, iteration, probability, 'MBL a+b' AS source FROM pd UNION ALL SELECT entity, relation, value, iteration, probability, 'MBL a+b' FROM pd WHERE p_partkey <= 20")
def source_belief_dump(spark: SparkSession, d: str) -> DataFrame:
    rows = dump(spark, d)
    return rows.select("entity", "relation", "value", "iteration", "probability", C.url_decoded(F.col("source")).alias("source"))


def _log(spark: SparkSession, d: str, lines: list[tuple[str, list[str]]]) -> DataFrame:
    """Numbered lines of formats over (n_nationkey, n_regionkey) of all nations, in order."""
    rows = T(spark, d, "nation").select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.format_string(f, *[F.expr(x) for x in cells]).alias("line")) for i, (f, cells) in enumerate(lines)])).alias("e"))
    return readers.numbered(spark, _lines(rows.select("n_nationkey", "e.*"), F.col("line"), ["n_nationkey", "i"], new_path(spark, "log")))


_SCORES = "SELECT {0} AS raw_rank, {1} AS raw_hits, {2} AS filtered_rank, {3} AS filtered_hits FROM nation WHERE n_nationkey = (SELECT {4}(n_nationkey) FROM nation)"


@query(_SCORES.format("n_nationkey + 100.5::double", "0.25::double", "n_regionkey + 10.0::double", "0.5::double", "min"))
def log_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return readers.evaluation_log(_log(spark, d, [("Options: [a: b]", []), ("Raw -- Rank: %s, Hits@10: 0.25", ["n_nationkey + 100.5"]), ("Filtered -- Rank:  %d, Hits@10: 0.5", ["n_regionkey + 10"])]))


@query(_SCORES.format("n_nationkey + 100.5::double", "0.1234::double", "n_regionkey + 10.0::double", "0.5::double", "max"))
def log_training(spark: SparkSession, d: str) -> DataFrame:
    """Of many validations the last counts."""
    return readers.training_log(_log(spark, d, [("INFO:EX-KG:[%d] VALID: MRR = 0.1/0.2, Mean Rank = %s/%d, Hits@10 = 12.34/50", ["n_nationkey", "n_nationkey + 100.5", "n_regionkey + 10"]), ("INFO:EX-KG:[%d] cost 3", ["n_nationkey"])]))


@query(_SCORES.format("n_nationkey + 100.5::double", "25.5::double", "n_regionkey + 10.0::double", "50.0::double", "max"))
def log_scores(spark: SparkSession, d: str) -> DataFrame:
    return readers.scores_log(_log(spark, d, [("  Raw scores (mean, hits) on test set: %s  x  25.5", ["n_nationkey + 100.5"]), ("  Filtered scores (mean, hits) on test set: %d  x  50", ["n_regionkey + 10"])]))


@query(f"SELECT 'data' AS datadir, '100' AS size, 2 AS n_options, s.* FROM ({_SCORES.format('n_nationkey + 100.5::double', '0.25::double', 'n_regionkey + 10.0::double', '0.5::double', 'max')}) s")
def log_results(spark: SparkSession, d: str) -> DataFrame:
    """The header's options without the output folder, and the scores."""
    found = readers.results(_log(spark, d, [("Options: [size: 100, outdir: /tmp/x, datadir: '/a/b/data']", []), ("Raw   - Rank: %s, Hits@10: 0.25", ["n_nationkey + 100.5"]), ("Filtered - Rank: %d, Hits@10: 0.5", ["n_regionkey + 10"]), ("Processed 5", [])]))
    return found.select(F.col("options")["datadir"].alias("datadir"), F.col("options")["size"].alias("size"), F.size("options").alias("n_options"), "raw_rank", "raw_hits", "filtered_rank", "filtered_hits")
