"""Growth of a graph by rules over its relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.operators.ranking import settled

KEY = ["head", "tail", "relation"]


def single_valued(rules: DataFrame, position: str = "pos") -> DataFrame:
    """One target for each (type, src): that of the last line."""
    return rules.groupBy("type", "src").agg(F.max_by("dst", position).alias("dst"))


def closure(rules: DataFrame, rounds: int = 20) -> DataFrame:
    """(src, dst, swapped, steps): what a relation leads to by up to ``rounds`` rules, with the fewest steps.

    Subsumption (RSub) keeps head and tail, an inverse (Inv), which holds both ways, swaps them. So what a triple leads to
    depends on its relation alone, and the search goes over the rules, which are few, before any triple is read.
    """
    inverse = rules.filter("type = 'Inv'")
    up = rules.filter("type = 'RSub'").select("src", "dst", F.lit(False).alias("swapped"))
    there, back = (inverse.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(True).alias("swapped")) for a, b in (("src", "dst"), ("dst", "src")))
    steps = settled(up.union(there).union(back).distinct())
    step = steps.select(F.col("src").alias("dst"), F.col("dst").alias("_to"), F.col("swapped").alias("_swap"))
    known = steps.select("src", "dst", "swapped", F.lit(1).alias("steps"))
    new = known
    for n in range(2, rounds + 1):
        made = new.join(step, "dst").select("src", F.col("_to").alias("dst"), (F.col("swapped") != F.col("_swap")).alias("swapped")).distinct()
        new = settled(made.join(known, ["src", "dst", "swapped"], "left_anti").withColumn("steps", F.lit(n)))
        if new.isEmpty():
            break
        known = known.union(new)
    return settled(known)


def expanded(triples: DataFrame, rules: DataFrame, rounds: int = 20) -> DataFrame:
    """Distinct triples with all that the rules (type, src, dst) add, along paths of at most ``rounds`` rules.

    The triples meet the closure of the rules once, and one shuffle makes the result distinct.
    """
    leads = closure(rules, rounds).groupBy(F.col("src").alias("relation")).agg(F.collect_list(F.struct("dst", "swapped")).alias("_leads"))
    leads = settled(leads)  # a row for each relation with a rule, so that its size is known
    own = F.array(F.struct(F.col("relation").alias("dst"), F.lit(False).alias("swapped")))
    every = F.concat(own, F.coalesce("_leads", F.array().cast("array<struct<dst:string,swapped:boolean>>")))
    rows = triples.select(*KEY).join(leads, "relation", "left").withColumn("_to", F.explode(every))
    head, tail = (F.when(F.col("_to.swapped"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("head", "tail"), ("tail", "head")))
    return rows.select(head, tail, F.col("_to.dst").alias("relation")).distinct()
