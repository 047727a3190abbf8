"""Readers of triple files, dumps, embeddings and logs, and writers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trivane import schema
from trivane.functions import columns as C
from trivane.shared import names_in, touch
from trivane.sources import catalogs


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of text files. Names are taken as they are: those of embeddings have brackets and colons, those of datasets brackets."""
    if isinstance(path, str):
        return spark.read.option("__globPaths__", "false").text(path)
    # without patterns Spark reads several files with such names more than once, so here patterns are ruled out by escapes
    return spark.read.text([re.sub(r"([\\\[\]{}*?])", r"\\\1", one) for one in path])


def named_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, value): the lines of many files in one scan, with the name of each line's file; parts have that of their folder."""
    place = F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/")
    name = F.when(F.element_at(place, -1).startswith("part-"), F.element_at(place, -2)).otherwise(F.element_at(place, -1))
    return lines(spark, paths).select(name.alias("name"), "value")


def tsv(spark: SparkSession, path: str | list[str], fields: str) -> DataFrame:
    """Tab-separated text with stripped fields; numbers that are none become null."""
    wanted = spark.createDataFrame([], fields).schema
    parts = F.split("value", "\t")
    cells = [C.stripped(F.get(parts, F.lit(i))).try_cast(f.dataType).alias(f.name) for i, f in enumerate(wanted.fields)]
    return lines(spark, path).filter(C.stripped("value") != "").select(*cells)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their 0-based number. A folder of ordered parts, as Spark writes them, is one file, its parts in the order of
    their names.

    Files are read in splits. Lines are numbered inside a split and moved on by the lines of the splits before it and
    of the parts before its own; of splits there is one row for each 128 MB.
    """
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at")]
    rows = lines(spark, path).select("value", *at)
    splits = rows.groupBy("_file", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = lambda n, window: F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = splits.groupBy("_file").agg(F.sum("_n").alias("_n")).select("_file", upto("_n", Window.orderBy("_file")).alias("_parts"))
    splits = splits.withColumn("_before", upto("_n", Window.partitionBy("_file").orderBy("_split"))).join(parts, "_file")
    moved = F.broadcast(splits.select("_file", "_split", "_first", (F.col("_before") + F.col("_parts")).alias("_before")))
    return rows.join(moved, ["_file", "_split"]).select((F.col("_at") - F.col("_first") + F.col("_before")).alias("line"), "value")


def triples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return tsv(spark, path, schema.TRIPLE)


def triples_with_id(spark: SparkSession, path: str) -> DataFrame:
    """Triples with a key; of a repeated key the last line counts."""
    rows = numbered(spark, path).withColumn("f", F.split("value", "\t"))
    rows = rows.select("line", C.stripped(F.col("f")[0]).try_cast("long").alias("id"), F.struct(*[C.stripped(F.get("f", F.lit(i))).alias(c) for i, c in enumerate(("head", "tail", "relation"), 1)]).alias("t"))
    return rows.groupBy("id").agg(F.max_by("t", "line").alias("t")).select("id", "t.*")


def scored_triples(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schema.SCORED)


def value_map(spark: SparkSession, path: str, normalise: bool = False) -> DataFrame:
    """id and value; of a repeated id the last line counts. ``normalise`` turns values into 1 - share of the range."""
    from trivane.operators.scoring import normalised

    f = F.split("value", "\t")
    rows = numbered(spark, path).select("line", C.stripped(f[0]).alias("id"), C.stripped(F.get(f, F.lit(1))).try_cast("double").alias("value"))
    last = rows.groupBy("id").agg(F.max_by("value", "line").alias("value"))
    return normalised(last) if normalise else last


def energies(spark: SparkSession, path: str) -> DataFrame:
    return value_map(spark, path)


def ranks(spark: SparkSession, path: str) -> DataFrame:
    """Energies turned into ranks from 0 (the highest energy) to 1."""
    return value_map(spark, path, normalise=True)


def id_map(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schema.ID_MAP)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """A vector for each line; its number is the vector's id."""
    cells = F.transform(F.split(C.stripped("value"), r"\s+"), lambda x: x.cast("double"))
    return numbered(spark, path).select(F.col("line").cast("long").alias("idx"), cells.alias("vec"))


def matrices(spark: SparkSession, path: str, size: int) -> DataFrame:
    """A matrix for each ``size`` lines; lines that are left over are an error."""
    rows = vectors(spark, path)
    whole = rows.groupBy(F.floor(F.col("idx") / size).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "vec"))).alias("rows"))
    matrix = F.when(F.size("rows") == size, F.transform("rows", lambda r: r["vec"])).otherwise(F.raise_error(F.lit("rows are left over")).cast("array<array<double>>"))
    return whole.select("idx", matrix.alias("w"))


def embedding_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Paths by kind (entities, relations, weights, w1, w2) of the vectors in a folder.

    Names end in ``.unif``; where there is no such file of entities, in ``.bern``; where there is neither, the names
    of the kinds are the endings.
    """
    held = names_in(spark, folder)
    for ending in ("unif", "bern"):
        if f"entity2vec.{ending}" in held:
            found = {"entities": f"entity2vec.{ending}", "relations": f"relation2vec.{ending}", "weights": f"weights.{ending}"}
            return {kind: f"{folder}/{name}" for kind, name in found.items() if kind != "weights" or name in held}
    endings = {".entity2vec": "entities", ".relation2vec": "relations", ".W1": "w1", ".W2": "w2"}
    found = {kind: f"{folder}/{name}" for name in held for end, kind in endings.items() if name.endswith(end)}
    if not found.keys() >= {"entities", "relations"}:
        raise FileNotFoundError(f"there are no vectors of entities and relations in {folder}")
    return found


def embedding_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of an embedding's folder: (idx, vec), relations also with their weights w, or w1 and w2."""
    paths = embedding_files(spark, folder)
    entities, relations = vectors(spark, paths["entities"]), vectors(spark, paths["relations"])
    if "weights" in paths:
        relations = relations.join(vectors(spark, paths["weights"]).withColumnRenamed("vec", "w"), "idx")
    if "w1" in paths:
        size = re.search(r"size:(\d+)", folder.rstrip("/").rsplit("/", 1)[-1])
        if size is None or "w2" not in paths:
            raise ValueError(f"the size or one of two files of weights is missing: {folder}")
        for kind in ("w1", "w2"):
            relations = relations.join(matrices(spark, paths[kind], int(size[1])).withColumnRenamed("w", kind), "idx")
    return entities, relations


def confident(spark: SparkSession, path: str | list[str], least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the triples with confidence, as they stand in the files, from ``least`` on and below it."""
    rows = tsv(spark, path, schema.CONFIDENCE)
    return rows.filter(F.col("confidence") >= least), rows.filter(F.col("confidence") < least)


def all_confident(spark: SparkSession, folder: str, names: Sequence[str], least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(distinct accepted triples of all files with their highest confidence, one row with the number of rejected lines)."""
    accepted, rejected = confident(spark, [f"{folder}/{name}" for name in names], least)
    return accepted.groupBy("head", "tail", "relation").agg(F.max("confidence").alias("confidence")), rejected.agg(F.count(F.lit(1)).alias("rejected"))


def gold(spark: SparkSession, folder: str, names: Sequence[str] = catalogs.TEST_TRIPLES) -> DataFrame:
    """The distinct true triples of the gold files: negatives have a confidence below 0.1."""
    return all_confident(spark, folder, names, 0.1)[0].drop("confidence")


def categories(spark: SparkSession, path: str | list[str], least: float = 0.0) -> DataFrame:
    """Categories as triples of relation 0."""
    rows = tsv(spark, path, schema.CATEGORY).filter(F.col("confidence") >= least)
    return rows.select(F.col("entity").alias("head"), F.col("category").alias("tail"), F.lit("0").alias("relation")).distinct()


def catalog(spark: SparkSession, folder: str, kinds: Sequence[tuple[str, Sequence[str], bool, float]]) -> DataFrame:
    """(kind, head, tail, relation, confidence, accepted): the rows of all files of catalogs, in one scan.

    ``kinds`` are (kind, names, whether they are categories, least confidence). Categories become triples of relation 0. A
    row is accepted from the least confidence on; one whose last cell is no number is not. A file that is not
    there is an error.
    """
    table = [(name, kind, pairs, float(least)) for kind, names, pairs, least in kinds for name in names]
    rows = named_lines(spark, [f"{folder}/{name}" for name, *_ in table]).filter(C.stripped("value") != "")
    held = spark.createDataFrame(table, "name string, kind string, pairs boolean, least double")
    rows = rows.join(F.broadcast(held), "name").withColumn("_cells", F.split("value", "\t"))  # a row for each file
    cell = lambda i: C.stripped(F.get("_cells", F.lit(i)))
    relation = F.when(F.col("pairs"), F.lit("0")).otherwise(cell(2))
    confidence = F.when(F.col("pairs"), cell(2)).otherwise(cell(3)).try_cast("double")
    rows = rows.select("kind", cell(0).alias("head"), cell(1).alias("tail"), relation.alias("relation"), confidence.alias("confidence"), "least")
    return rows.withColumn("accepted", F.coalesce(F.col("confidence") >= F.col("least"), F.lit(False))).drop("least")


#: The ontology's files end in these names.
ONTOLOGY_TYPES = ("Domain", "Inv", "Mut", "Range2", "RMut", "RSub", "Sub")


def ontology(spark: SparkSession, folder: str, prefix: str = "165.onto-wbpg.db.") -> DataFrame:
    """(type, src, dst), the last line of a key counting."""
    from trivane.operators.ontology import single_valued

    out = None
    for kind in ONTOLOGY_TYPES:
        f = F.split("value", "\t")
        one = numbered(spark, f"{folder}/{prefix}{kind}.txt").select(F.lit(kind).alias("type"), C.stripped(f[0]).alias("src"), C.stripped(F.get(f, F.lit(1))).alias("dst"), F.col("line").alias("pos"))
        out = one if out is None else out.unionByName(one)
    return single_valued(out.filter("src != ''"))


def reverb(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, "head string, relation string, tail string, confidence double").select("head", "tail", "relation").distinct()


def reverb_annotations(lines: DataFrame) -> DataFrame:
    """(head, tail, relation, is_valid, confidence) of annotated lines with three parts."""
    f = F.split("value", "\t")
    inner = F.regexp_replace(F.lower(C.stripped(F.get(f, F.lit(2)))), r"^\(|\)$", "")
    parts = F.transform(F.split(inner, ";"), lambda x: F.regexp_replace(C.stripped(x), " ", "_"))
    rows = lines.select(parts.alias("p"), (C.stripped(f[0]) == "1").alias("is_valid"), C.stripped(F.get(f, F.lit(1))).try_cast("double").alias("confidence"))
    return rows.filter(F.size("p") == 3).select(F.col("p")[0].alias("head"), F.col("p")[2].alias("tail"), F.col("p")[1].alias("relation"), "is_valid", "confidence")


def reverb_full(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    cell = lambda i: F.lower(C.stripped(F.get(f, F.lit(i))))
    return lines.select(cell(4).alias("head"), cell(6).alias("tail"), cell(5).alias("relation"))


def annotated_in(annotations: DataFrame, train: DataFrame) -> DataFrame:
    """Annotations all of whose parts the training triples know."""
    out = annotations
    known = train.select(F.explode(F.array("head", "tail")).alias("e")).distinct()
    for side in ("head", "tail"):
        out = out.join(known.select(F.col("e").alias(side)), side, "left_semi")
    return out.join(train.select("relation").distinct(), "relation", "left_semi")


#: What is removed from a key of the RDF dump.
KEY_PREFIXES = (
    "http://rdf.freebase.com/key/",
    "http://rdf.freebase.com/ns/",
    "http://www.w3.org/2000/01/rdf-schema#",
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "http://www.w3.org/2002/07/owl#",
)


def freebase(lines: DataFrame) -> DataFrame:
    """Triples of an RDF dump (spark.read.text reads it, compressed or not): ``<head> <relation> <tail> .``"""
    parts = F.split(C.stripped(F.regexp_replace(C.stripped("value"), r"\.$", "")), r"\s+", 3)
    key = lambda x: C.without(F.regexp_replace(C.stripped(x), r"^<|>$", ""), *KEY_PREFIXES)
    rows = lines.select(parts.alias("p")).filter(F.size("p") == 3)
    return rows.select(key(F.col("p")[0]).alias("head"), key(F.col("p")[2]).alias("tail"), key(F.col("p")[1]).alias("relation"))


#: Pointer symbols and their relations by part of speech (a satellite s is an adjective a).
_TOPIC = {";c": "_synset_domain_topic", ";r": "_synset_domain_region", ";u": "_synset_domain_usage"}
POINTERS = {
    "n": {
        "!": "_antonym", "@": "_hypernym", "@i": "_instance_hypernym", "~": "_hyponym", "~i": "_instance_hyponym", "#m": "_member_holonym",
        "#s": "_substance_holonym", "#p": "_part_holonym", "%m": "_member_meronym", "%s": "_substance_meronym", "%p": "_part_meronym",
        "=": "_attribute", "+": "_derivationally_related_form", "-c": "_member_of_domain_topic", "-r": "_member_of_domain_region", "-u": "_member_of_domain_usage", **_TOPIC,
    },
    "v": {"!": "_antonym", "@": "_hypernym", "~": "_hyponym", "*": "_entailment", ">": "_cause", "^": "_also_see", "$": "_verb_group", "+": "_derivationally_related_form", **_TOPIC},
    "a": {"!": "_antonym", "&": "_similar_to", "<": "_participle_of_verb", "\\": "_pertainym", "=": "_attribute", "^": "_also_see", "+": "_derivationally_related_form", **_TOPIC},
    "r": {"!": "_antonym", "\\": "_derived_from_adjective", "+": "_derivationally_related_form", **_TOPIC},
}


def wordnet(lines: DataFrame) -> DataFrame:
    """Triples of pointer lines; licence lines begin with two spaces; an unknown part of speech or symbol is an error."""
    f = F.col("f")
    rows = lines.filter(~F.col("value").startswith("  ") & (C.stripped("value") != "")).select(F.split(C.stripped(F.substring_index("value", "|", 1)), r"\s+").alias("f"))
    words = F.conv(f[3], 16, 10).cast("int")
    rows = rows.select(f[0].alias("head"), F.regexp_replace(f[2], "^s$", "a").alias("pos"), F.slice("f", 5 + 2 * words, F.size("f")).alias("rest"))
    count = F.col("rest")[0].cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(1), 4 * count - 3, F.lit(4))).otherwise(F.array().cast("array<int>"))
    each = rows.select("head", "pos", "rest", F.explode(starts).alias("at"))
    each = each.select("head", "pos", F.get("rest", F.col("at")).alias("symbol"), F.get("rest", F.col("at") + 1).alias("tail"))
    table = lines.sparkSession.createDataFrame([(p, s, r) for p, held in POINTERS.items() for s, r in held.items()], "pos string, symbol string, relation string")
    found = each.join(F.broadcast(table), ["pos", "symbol"], "left")  # a fixed table of some 50 rows
    known = F.coalesce("relation", F.raise_error(F.concat(F.lit("unknown pointer "), "pos", F.lit(" "), "symbol")).cast("string"))
    return found.select("head", "tail", known.alias("relation"))


#: The columns of the belief dump.
DUMP = ("entity", "relation", "value", "iteration", "probability", "source", "entity_literals", "value_literals", "best_entity", "best_value", "entity_categories", "value_categories", "candidate_source")


def belief_dump(lines: DataFrame) -> DataFrame:
    """Typed rows of the 13-column dump without its header; brackets around iteration and probability go."""
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("Entity\t")).select(*[C.stripped(F.get(f, F.lit(i))).alias(c) for i, c in enumerate(DUMP)])
    bare = lambda c: C.not_a_number_to_null(F.regexp_replace(c, r"[\[\]]", ""))
    return rows.withColumn("iteration", bare(F.col("iteration")).try_cast("int")).withColumn("probability", bare(F.col("probability")).try_cast("double"))


def options_of(header: Column) -> Column:
    """The map in a result's header ``Options: [k: v, ...]``, without outdir and with the base name of datadir."""
    inner = F.regexp_extract(header, r"Options: \[(.*)\]", 1)
    held = F.map_filter(F.str_to_map(inner, F.lit(r",\s*"), F.lit(r":\s*")), lambda k, v: k != "outdir")
    return F.transform_values(held, lambda k, v: F.when(k == "datadir", C.basename(v)).otherwise(v))


NUMBER = r"(\d+(?:\.\d+)?)"


def _last(lines: DataFrame, pattern: str, kinds: Sequence[str]) -> DataFrame:
    """The groups of the last line (line, value) that matches the pattern, as doubles; no row if none does."""
    groups = F.struct(*[F.regexp_extract("value", pattern, i + 1).cast("double").alias(kind) for i, kind in enumerate(kinds)])
    return lines.filter(F.col("value").rlike(pattern)).agg(F.max_by(groups, "line").alias("f")).filter("f is not null").select("f.*")


def evaluation_log(lines: DataFrame) -> DataFrame:
    """(raw_rank, raw_hits, filtered_rank, filtered_hits) of an evaluation's lines (line, value): its first line with ranks
    is raw, the next filtered."""
    pattern = rf"Rank:\s+{NUMBER},\s+Hits@10:\s+{NUMBER}"
    rows = lines.filter(F.col("value").rlike(pattern)).select("line", *[F.regexp_extract("value", pattern, i).cast("double").alias(c) for i, c in ((1, "rank"), (2, "hits"))])
    two = rows.orderBy("line").limit(2).agg(F.array_sort(F.collect_list(F.struct("line", "rank", "hits"))).alias("f")).filter(F.size("f") == 2)
    return two.select(*[F.col("f")[i][c].alias(f"{name}_{c}") for i, name in enumerate(("raw", "filtered")) for c in ("rank", "hits")])


def training_log(lines: DataFrame) -> DataFrame:
    """As ``evaluation_log``, of the last validation line of a training's log; its hits are percents, here shares of four digits."""
    n = NUMBER[1:-1]
    pattern = rf"^INFO:EX-KG:\[\d+\] VALID: MRR = {n}/{n}, Mean Rank = ({n})/({n}), Hits@10 = ({n})/({n})$"
    found = _last(lines, pattern, ("raw_rank", "filtered_rank", "raw_hits", "filtered_hits"))
    hits = [F.round(F.col(c) / 100, 4).alias(c) for c in ("raw_hits", "filtered_hits")]
    return found.select("raw_rank", hits[0], "filtered_rank", hits[1])


def scores_log(lines: DataFrame) -> DataFrame:
    """As ``evaluation_log``, of the lines of raw and of filtered scores on the test set."""
    sides = [_last(lines, rf"^\s+{name} scores .* on test set: {NUMBER}\s+.*\s+{NUMBER}$", (f"{name.lower()}_rank", f"{name.lower()}_hits")) for name in ("Raw", "Filtered")]
    return sides[0].crossJoin(sides[1])  # one row each


def results(lines: DataFrame) -> DataFrame:
    """(options, raw_rank, raw_hits, filtered_rank, filtered_hits) of a result file with a header of options."""
    options = lines.filter(C.stripped("value").startswith("Options: ")).agg(F.max_by(options_of(F.regexp_replace(C.stripped("value"), "'", "")), "line").alias("options"))
    trimmed = lines.withColumn("value", C.stripped("value"))
    sides = [_last(trimmed, rf"^{name}.*Rank: {NUMBER}, Hits@10: (\d\.\d+)", (f"{name.lower()}_rank", f"{name.lower()}_hits")) for name in ("Raw", "Filtered")]
    return options.crossJoin(sides[0]).crossJoin(sides[1])  # one row each


#: Buckets of a new energy cache, where the session's shuffles have fewer partitions.
CACHE_BUCKETS = 16


def energy_cache(spark: SparkSession, path: str, buckets: int = 0) -> str:
    """The name of the table of energies by triple that lies at ``path``; an empty one is made there if there is none.

    The table is bucketed by the triple, so it meets triples without being shuffled. Its bucket number stands beside it, in
    the name of an empty file, so that any later session opens it alike. Two jobs must not add to one cache at a time.
    """
    marks = [n for n in names_in(spark, f"{path}/_buckets")]
    number = int(marks[0]) if marks else buckets or max(CACHE_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not marks:
        touch(spark, f"{path}/_buckets/{number}")
    name = "energies_" + hashlib.md5(path.encode()).hexdigest()
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema.SCORED}) USING parquet CLUSTERED BY (head, tail, relation) INTO {number} BUCKETS LOCATION '{place}'")
    return name


def cache_buckets(spark: SparkSession, cache: str) -> int:
    return int(spark.sql(f"DESCRIBE EXTENDED {cache}").filter("col_name = 'Num Buckets'").first()["data_type"])


def add_energies(scored: DataFrame, cache: str) -> None:
    """Energies of triples that the cache does not have yet; to have each once is up to the caller (``scoring.with_cache``).

    Rows are dealt to the buckets first, so that an addition is a file for each bucket."""
    scored.select("head", "tail", "relation", "energy").repartition(cache_buckets(scored.sparkSession, cache), "head", "tail", "relation").write.insertInto(cache)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated text; with mode ``ignore`` what is there stays."""
    df.write.mode(mode).option("sep", "\t").csv(path)


def report(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """A line of tab-separated cells for each row, as ``value``: columns in the order of ``formats``, by printf formats."""
    return df.select(F.format_string("\t".join(formats.values()), *formats).alias("value"))


def write_report(df: DataFrame, formats: dict[str, str], order: list[str], path: str) -> None:
    """A report with its header in one file; a report is small."""
    lines_ = report(df.orderBy(*order), formats).coalesce(1)
    header = df.sparkSession.createDataFrame([("\t".join(formats),)], "value string").coalesce(1)
    header.union(lines_).coalesce(1).write.text(path)
