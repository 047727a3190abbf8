"""Global ranks and running sums that do not bring all rows into one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivane.shared import new_path


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, which cuts lineage. This runs a job at once.

    They are columns, compressed: who reads them again reads what it needs, and Spark knows their size when it plans a join.
    """
    path = new_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, rank: str = "rank", distinct: bool = False) -> DataFrame:
    """Add the 1-based ``rank`` of each row in ``order``, and a running sum for each of ``sums``.

    Rows are range-partitioned, sorted and numbered inside their partition, and moved on by what the partitions before
    hold; of these only one row for each partition comes to the driver. ``order`` must have no ties. With ``distinct``
    equal rows are made one where they meet in a partition, so that they are shuffled once; ``order`` must then be all columns. The
    numbering runs jobs at once, before the caller's plan.
    """
    sums = sums or {}
    held = df.withColumns(sums) if sums else df
    placed = held.repartitionByRange(*order)
    if distinct:  # by the sort that is made anyway: a hash table of whole rows costs more
        copy = F.row_number().over(Window.partitionBy(*placed.columns).orderBy(*order))
        placed = placed.withColumn("_copy", copy).filter("_copy = 1").drop("_copy")
    placed = placed.sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition from bit 33 on, below it the row
    parts = settled(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", at))
    totals = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sums]).collect()
    before, rows = [0] * (1 + len(sums)), []
    for r in sorted(totals):
        rows.append((r[0], *before))
        before = [b + x for b, x in zip(before, r[1:])]
    kinds = ["_part int", "_rank_before long"] + [f"_before_{c} {parts.select(F.sum(c)).dtypes[0][1]}" for c in sums]
    moved = df.sparkSession.createDataFrame(rows, ", ".join(kinds))
    out = parts.join(F.broadcast(moved), "_part")  # a row for each partition
    out = out.withColumn(rank, F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33) + 1 + F.col("_rank_before"))
    running = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in sums:
        out = out.withColumn(f"_run_{c}", F.sum(c).over(running) + F.col(f"_before_{c}"))
    out = out.drop("_part", "_at", "_rank_before", *[f"_before_{c}" for c in sums], *sums)
    return out.withColumnsRenamed({f"_run_{c}": c for c in sums})


#: Buckets of a histogram; one row of each comes to the driver.
BUCKETS = 4096
#: Numbers beyond it, which may be infinite, count as this.
FARTHEST = 1e300


def _measures(df: DataFrame, key: Column) -> tuple[list[Column], bool]:
    """Doubles whose order is that of the key, each telling apart what the ones before it do not; and whether equal ones mean equal keys."""
    kind = df.select(key.alias("k")).schema["k"].dataType
    if isinstance(kind, T.StringType):
        octets = lambda i: F.rpad(F.substring(F.hex(F.encode(key, "utf-8")), 12 * i + 1, 12), 12, F.lit("0"))
        return [F.conv(octets(i), 16, 10).cast("double") for i in range(4)], False
    if isinstance(kind, T.LongType):
        return [F.shiftright(key, 24).cast("double"), F.pmod(key, F.lit(1 << 24)).cast("double")], True
    if isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType):
        return [key.cast("double")], True
    return [], False


def cut_off(df: DataFrame, order: list[Column], most: int) -> tuple[Column, int]:
    """(condition, number of its rows): the first ``most`` rows in ``order`` are among those that meet it.

    A histogram of the order's leading key tells the bucket in which the last of them lies, a finer one of that bucket
    is next, until at most twice as many rows are kept or no key can tell them apart. Nulls come first, NaN last.
    Only histograms come to the driver. Each pass plans ``df`` anew and reads what the key needs.
    """
    sure, open_, before = F.lit(False), F.lit(True), 0  # rows before the cut for sure, rows that the cut goes through
    for key in order:
        measures, exact = _measures(df, key)
        for measure in measures:
            at = F.coalesce(F.least(F.greatest(measure, F.lit(-FARTHEST)), F.lit(FARTHEST)), F.lit(-1.1 * FARTHEST))
            n, low, high = df.filter(open_).agg(F.count(F.lit(1)), F.min(at), F.max(at)).first()
            if before + n <= 2 * most:
                return sure | open_, before + n
            while low < high:
                bucket = F.least(F.floor((at / 2 - low / 2) / (high / 2 - low / 2) * BUCKETS), F.lit(BUCKETS - 1))
                rows = df.filter(open_ & (at >= low) & (at <= high)).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))
                for r in sorted(rows.collect()):
                    if before + r["n"] >= most:
                        break
                    before += r["n"]
                if before + r["n"] <= 2 * most or (low, high) == (r["low"], r["high"]):
                    return sure | (open_ & (at <= r["high"])), before + r["n"]
                low, high = r["low"], r["high"]
            sure, open_ = sure | (open_ & (at < high)), open_ & (at == high)
        if not exact or abs(high) >= FARTHEST:
            break
    return sure | open_, df.filter(sure | open_).count()


def first_rows(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows in ``order``, which must have no ties; no task holds more than its share of them.

    Histograms find a cut, and only what is before it is sorted. A table that is no larger stays as it is.
    """
    condition, kept = cut_off(df, order, most) if most > 0 else (F.lit(False), 0)
    rows = df.filter(condition)
    return rows if kept <= most else ranked(rows, order, rank="_rank").filter(F.col("_rank") <= most).drop("_rank")


def ranked_within(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, rank: str = "rank") -> DataFrame:
    """As ``ranked``, but ranks and sums begin anew for each value of ``keys``.

    All rows are numbered together and each group's first number is taken off, so a group of very many rows is
    spread over as many partitions as it needs.
    """
    sums = sums or {}
    held = df.withColumns({f"_own_{c}": x for c, x in sums.items()}) if sums else df
    rows = ranked(held, [*map(F.col, keys), *order], {c: F.col(f"_own_{c}") for c in sums}, rank)
    before = [F.min_by(F.col(c) - F.col(f"_own_{c}"), rank).alias(f"_start_{c}") for c in sums]
    starts = rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg((F.min(rank) - 1).alias("_start"), *before)
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    out = rows.join(starts, same).withColumns({rank: F.col(rank) - F.col("_start"), **{c: F.col(c) - F.col(f"_start_{c}") for c in sums}})
    return out.drop("_start", *[f"_key_{k}" for k in keys], *[f"_{x}_{c}" for c in sums for x in ("own", "start")])


def ntile(df: DataFrame, order: list[Column], tiles: int, name: str) -> DataFrame:
    """NTILE(tiles) over the whole table: the first tiles are one row longer where rows do not divide."""
    placed = ranked(df, order, rank="_rank")  # also counted, so that ``df`` is computed once
    each, longer = divmod(placed.count(), tiles)
    at = F.col("_rank") - 1
    in_longer = longer * (each + 1)
    tile = F.when(at < in_longer, F.floor(at / (each + 1))).otherwise(longer + F.floor((at - in_longer) / max(each, 1))) + 1
    return placed.withColumn(name, tile.cast("int")).drop("_rank")
