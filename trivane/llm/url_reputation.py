"""URL filtering by rules and by empirical-Bayes host reputation, in DataFrame functions only.

Outcomes of labelled pages (bad or not) are counted per host. A host's rate is shrunk towards its
registered domain, the domain's towards its suffix and the suffix's towards all pages, each level
with a beta prior whose strength is the beta-binomial over-dispersion of that level, estimated by
moments over all hosts. A host is blocked when the lower bound of its posterior exceeds a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.llm.workspace import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Second-level labels under which registrations are made below a two-letter country suffix.
PUBLIC_SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_port(host: Column) -> Column:
    return F.regexp_replace(host, ":[0-9]*$", "")


def suffix_of(host: Column, second_level: Sequence[str] = PUBLIC_SECOND_LEVEL) -> Column:
    """The public suffix of a host without port: the last label, or the last two below a country suffix with public second level."""
    pattern = r"((?:^|\.)(?:" + "|".join(second_level) + r")\.[a-z]{2})$"
    two = F.ltrim(F.regexp_extract(host, pattern, 1), F.lit("."))
    return F.when(two != "", two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain of a host without port: one label more than its suffix."""
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.when(labels == 2, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -3))


def rule_fits(host: Column, path: Column, rule: str) -> Column:
    """Whether a ``host/path`` rule fits: that host or a subdomain, and a path that starts with the rule's."""
    rule_host, slash, rest = rule.partition("/")
    on_host = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
    return on_host & F.startswith(path, F.lit(slash + rest))


def _strength(groups: DataFrame, level: str, mean: float) -> DataFrame:
    """One row: the beta prior's strength from the spread of the groups' rates around the mean."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    spread = max(mean * (1 - mean), 1e-9)
    sums = groups.filter("n > 0").agg(
        F.sum((k - n * mean) * (k - n * mean) / n).alias("s"),
        F.count(F.lit(1)).cast("double").alias("g"),
        F.sum(n).alias("all"),
        F.sum(n * n).alias("squares"),
    )
    room = F.col("all") - F.col("squares") / F.col("all") - (F.col("g") - 1)
    rho = F.try_divide(F.col("s") / spread - (F.col("g") - 1), room)
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.01)), F.lit(0.001)), F.lit(0.999))
    return sums.select(F.lit(level).alias("level"), (1 / rho - 1).alias("strength"))


def host_posteriors(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645, second_level: Sequence[str] = PUBLIC_SECOND_LEVEL) -> DataFrame:
    """Posterior of the bad rate of every host.

    ``outcomes``: (host, bad 0/1), one row per labelled page; null ``bad`` counts as no outcome.
    ``hosts``: (host), repeated or not; hosts without outcomes get their domain's posterior.
    Returns host, n, k, mean, lower, upper (bounds ``z`` posterior deviations from the mean).
    A port is part of a host, but not of its domain and suffix. ``second_level`` are the labels below which registrations
    are made under a country's suffix. Only sums are grouped, with partial sums before the shuffle, so one hot host is no hot task.
    With no outcomes at all every mean is one half of a prior of strength 2.
    """
    every = hosts.select("host", F.lit(0).alias("n"), F.lit(0).alias("k")).unionByName(
        outcomes.filter("bad is not null").select("host", F.lit(1).alias("n"), F.col("bad").cast("int").alias("k"))
    )
    by_host = materialise(every.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "hosts")
    by_host = by_host.withColumn("suffix", suffix_of(without_port(F.col("host")), second_level))
    by_host = by_host.withColumn("domain", domain_of(without_port(F.col("host")), F.col("suffix")))
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = by_host.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    # Four numbers of fixed size come to the driver: the overall rate and a prior strength for each level.
    total = by_host.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    mean = (total["k"] + 1.0) / (total["n"] + 2.0)
    levels = (("host", by_host), ("domain", by_domain), ("suffix", by_suffix))
    rows = None
    for level, groups in levels:
        one = _strength(groups, level, mean)
        rows = one if rows is None else rows.unionByName(one)
    strength = {r["level"]: r["strength"] for r in rows.collect()}

    m_suffix = by_suffix.select(
        "suffix", ((F.col("k") + strength["suffix"] * F.lit(mean)) / (F.col("n") + strength["suffix"])).alias("suffix_mean")
    )
    m_domain = by_domain.join(m_suffix, "suffix").select(
        "domain",
        ((F.col("k") + strength["domain"] * F.col("suffix_mean")) / (F.col("n") + strength["domain"])).alias("domain_mean"),
    )
    a = F.col("k") + strength["host"] * F.col("domain_mean")
    b = F.col("n") - F.col("k") + strength["host"] * (1 - F.col("domain_mean"))
    out = by_host.join(m_domain, "domain").select("host", "n", "k", (a / (a + b)).alias("mean"), (a + b).alias("weight"))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return out.select(
        "host", "n", "k", "mean", (F.col("mean") - z * deviation).alias("lower"), (F.col("mean") + z * deviation).alias("upper")
    )


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]],
    max_bad: float = 0.5,
    z: float = 1.645,
    url_column: str = "url",
    second_level: Sequence[str] = PUBLIC_SECOND_LEVEL,
) -> DataFrame:
    """Judge every row of ``pages``.

    ``outcomes``: (host, bad). ``rules``: (``allow`` or ``block``, ``host/path``), the longest that fits
    decides; without one, a host is blocked where the lower bound of its posterior bad rate exceeds
    ``max_bad``. Adds host, path, rule (null without one) and verdict to all columns of ``pages``, whose
    own columns of those names are replaced. A null or scheme-less url has an empty host and path and
    is judged like any host. Repeated rows are all kept. An empty table gives an empty table.
    The join carries only blocked hosts; where a host holds a large share of the pages, adaptive
    execution splits its partition, as nothing above the join needs a host's rows together.
    """
    parsed = pages.drop("host", "path", "rule", "verdict").withColumn("host", url_host(F.col(url_column)))
    parsed = parsed.withColumn("path", url_path(F.col(url_column)))
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    fits = [(F.lit(rule), F.lit(action), rule_fits(F.col("host"), F.col("path"), rule)) for action, rule in ordered]
    rule = F.coalesce(*[F.when(ok, text) for text, _, ok in fits]) if fits else F.lit(None).cast("string")
    by_rule = F.coalesce(*[F.when(ok, action) for _, action, ok in fits]) if fits else F.lit(None).cast("string")

    blocked = host_posteriors(outcomes, parsed.select("host"), z, second_level).filter(F.col("lower") > max_bad)
    blocked = blocked.select(F.col("host").alias("blocked_host"))
    judged = parsed.join(blocked, F.col("host") == F.col("blocked_host"), "left")
    own = F.when(F.col("blocked_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("rule", rule).withColumn("verdict", F.coalesce(by_rule, own)).drop("blocked_host")
