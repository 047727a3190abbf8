"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard has virtual nodes at hashed places of a ring, and a key belongs to the first node clockwise of its own place,
its home. A shard takes the keys of its homes up to its capacity, in the order of the ring. Keys beyond it
continue clockwise, in order, and each next shard that has room takes as many as it has room for, until after two rounds
all are placed. So loads keep their bound whatever the keys are, and only what a full shard cannot take moves.

Which keys overflow depends on the counts of the arcs between neighbouring nodes alone. Arcs are as many as the
virtual nodes, a parameter, so the walk round the ring is one small row; keys meet its result by their arc and their
rank within the arc.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trivane.functions import columns as C
from trivane.llm.workspace import materialise

#: Places of the ring are numbers below 2**32; a table of 4096 equal parts says which arcs a part meets.
PLACES, PART = 1 << 32, 20


def nodes(spark: SparkSession, shards: int, virtual: int) -> DataFrame:
    """(arc, shard, place) of all virtual nodes, numbered clockwise."""
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("copy"))
    placed = every.withColumn("place", C.hash_int("node", F.col("shard"), F.col("copy")))
    number = F.row_number().over(Window.orderBy("place", "shard", "copy")) - 1  # a row for each virtual node
    return placed.select(number.alias("arc"), "shard", "place")


def arcs(ring: DataFrame) -> DataFrame:
    """(part, low, high, arc): keys of low < place <= high belong to the arc; the first arc also has what is beyond the last node."""
    before = F.lag("place", 1, -1).over(Window.orderBy("arc"))
    pieces = ring.select("arc", before.alias("low"), F.col("place").alias("high"))
    last = ring.agg(F.max("place").alias("low")).select(F.lit(0).alias("arc"), "low", F.lit(PLACES - 1).alias("high"))
    parts = F.sequence(F.shiftright(F.col("low") + 1, PART), F.shiftright("high", PART))
    return pieces.unionByName(last).filter("low < high").select(F.explode(parts).alias("part"), "low", "high", "arc")


def spread(counts: DataFrame, capacity: DataFrame) -> DataFrame:
    """(arc, low, high, shard, slot): the keys of the arc from the rank ``low`` on and below ``high`` go to the shard, where the
    first has the slot.

    ``counts`` (arc, shard, n) has a row for each virtual node, ``capacity`` (shard, room) a row for each shard; the rooms
    must hold all keys. The rows are at most some for each virtual node.
    """
    clockwise = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    held = counts.join(capacity, "shard").withColumn("_before", F.coalesce(F.sum("n").over(clockwise), F.lit(0)))
    held = held.withColumn("own", F.greatest(F.lit(0), F.least("n", F.col("room") - F.col("_before")))).withColumn("over", F.col("n") - F.col("own"))
    held = materialise(held.select("arc", "shard", "room", "own", "over"), "arcs")

    # one row: the ring, with each shard's room that is left, is walked twice
    left = held.groupBy("shard").agg((F.max("room") - F.sum("own")).alias("left"))
    rooms = left.agg(F.array_sort(F.collect_list(F.struct("shard", "left"))).alias("rooms")).select(F.transform("rooms", lambda x: x["left"]).alias("rooms"))
    around = held.agg(F.array_sort(F.collect_list(F.struct("arc", "shard", "over"))).alias("ring"))
    again = F.transform("ring", lambda x: x.withField("over", F.lit(0).cast("long")))
    nothing = F.lit(0).cast("long")
    start = F.struct(nothing.alias("carried"), nothing.alias("taken"), F.col("rooms"), F.array().cast("array<struct<shard:int,at:bigint>>").alias("stops"))

    def passed(held, node):
        take = F.least(F.get(held["rooms"], node["shard"]), held["carried"])
        rooms = F.transform(held["rooms"], lambda x, i: F.when(i == node["shard"], x - take).otherwise(x))
        stops = F.when(take > 0, F.concat(held["stops"], F.array(F.struct(node["shard"].alias("shard"), held["taken"].alias("at"))))).otherwise(held["stops"])
        return F.struct((held["carried"] - take + node["over"]).alias("carried"), (held["taken"] + take).alias("taken"), rooms.alias("rooms"), stops.alias("stops"))

    walk = around.crossJoin(rooms).select(F.aggregate(F.concat("ring", again), start, passed).alias("walk"))  # one row each
    stops = walk.select(F.explode("walk.stops").alias("stop")).select("stop.at", F.col("stop.shard").alias("to"), F.lit(None).cast("int").alias("arc"), F.lit(None).cast("long").alias("first"))

    # the queue of keys that move is cut where an arc's keys begin and where the next shard begins to take
    queue = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    begins = held.filter("over > 0").withColumn("at", F.coalesce(F.sum("over").over(queue), F.lit(0)))
    begins = begins.select("at", F.lit(None).cast("int").alias("to"), "arc", (F.col("own") - F.col("at")).alias("first"))
    cuts = begins.unionByName(stops).groupBy("at").agg(*[F.max(c).alias(c) for c in ("to", "arc", "first")])
    so_far, whole = Window.orderBy("at"), held.agg(F.sum("over").alias("whole"))
    cuts = cuts.crossJoin(whole).withColumn("end", F.coalesce(F.lead("at").over(so_far), F.col("whole")))  # one row
    cuts = cuts.select("at", "end", *[F.last(c, True).over(so_far).alias(c) for c in ("to", "arc", "first")])
    moved = cuts.select("arc", (F.col("at") + F.col("first")).alias("low"), (F.col("end") + F.col("first")).alias("high"), F.col("to").alias("shard"), F.lit(1).alias("_kind"))
    stay = held.filter("own > 0").select("arc", F.lit(0).cast("long").alias("low"), F.col("own").alias("high"), "shard", F.lit(0).alias("_kind"))
    slots = Window.partitionBy("shard").orderBy("_kind", "arc", "low").rowsBetween(Window.unboundedPreceding, -1)
    return stay.unionByName(moved).withColumn("slot", F.coalesce(F.sum(F.col("high") - F.col("low")).over(slots), F.lit(0))).drop("_kind")


def capacities(spark: SparkSession, rows: int, shards: int, slack: float) -> DataFrame:
    """(shard, room): without slack the rows divided, the first shards one more; else so much above the mean for each."""
    each, more = divmod(rows, shards)
    room = F.lit(each) + (F.col("id") < more).cast("long") if slack <= 0 else F.lit(int(-(-rows * (1 + slack) // shards)))
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"), room.cast("long").alias("room"))


def placed(rows: DataFrame, key: str, shards: int, virtual: int = 128, slack: float = 0.0) -> DataFrame:
    """Adds ``shard``, ``slot`` (from 0 in each shard, without gaps) and ``home``, the shard of the first node clockwise.

    With ``slack`` 0 the shards' numbers of rows differ by one at most; with a share s above it no shard has more than
    (1 + s) times the mean, and fewer rows leave their homes. Rows with one ``key`` have one home, null like
    any other; where they are more than a shard may hold, they are parted. ``rows`` is written and should be narrow: the
    texts stay where they are. Equal rows are told apart by a number only to be dealt evenly. An empty table gives none.
    """
    spark = rows.sparkSession
    own = F.struct(*[F.col(c) for c in rows.columns if c not in ("shard", "slot", "home")])
    ring = materialise(nodes(spark, shards, virtual), "ring")
    place = C.hash_int("key", F.col(key))
    keyed = rows.select(own.alias("_row"), place.alias("_place"), F.shiftright(place, PART).alias("_part"), F.monotonically_increasing_id().alias("_copy"))
    on = (F.col("_part") == F.col("part")) & (F.col("_place") > F.col("low")) & (F.col("_place") <= F.col("high"))
    meets = F.broadcast(arcs(ring))  # 4096 rows and one for each virtual node
    held = materialise(keyed.join(meets, on).select("_row", "_place", "_copy", F.col("arc").alias("_arc")), "keys")

    order = ["_arc", "_place", "_row", "_copy"]
    dealt = held.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialise(dealt.select("_row", "_arc", F.spark_partition_id().alias("_deal"), F.monotonically_increasing_id().alias("_at")), "dealt")
    first = lambda column: F.coalesce(F.sum("n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    deals = dealt.groupBy("_deal").agg(F.count(F.lit(1)).alias("n")).select("_deal", first("_deal").alias("_before"))  # a row for each partition
    counts = ring.join(dealt.groupBy(F.col("_arc").alias("arc")).agg(F.count(F.lit(1)).alias("n")), "arc", "left").select("arc", F.col("shard"), F.coalesce("n", F.lit(0)).alias("n"))
    counts = materialise(counts.withColumn("start", first("arc")), "counts")

    total = counts.agg(F.sum("n")).first()[0]
    segments = spread(counts.drop("start"), capacities(spark, total, shards, slack))
    starts = counts.select("arc", "start", F.col("shard").alias("home"))
    segments = materialise(segments.join(starts, "arc").select(F.col("arc").alias("_arc"), "low", "high", "start", "shard", "home", F.col("slot").alias("_slot")), "segments")
    local = F.col("_at") - F.shiftleft(F.col("_deal").cast("long"), 33)
    ranks = dealt.join(F.broadcast(deals), "_deal").withColumn("_rank", local + F.col("_before"))
    within = F.col("_rank") - F.col("start")
    out = ranks.join(F.broadcast(segments), "_arc").filter((within >= F.col("low")) & (within < F.col("high")))  # some rows for each virtual node
    return out.select("_row.*", "shard", (F.col("_slot") + within - F.col("low")).alias("slot"), "home")


def shard_documents(docs: DataFrame, shards: int = 24, virtual: int = 128, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, home) of every document, by its doc_id.

    ``size`` is the text's UTF-8 bytes and 8, ``text_crc32`` the CRC-32 of those bytes; a null text counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return placed(rows, "doc_id", shards, virtual, slack)
