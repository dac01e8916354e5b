"""URL verdicts: explicit rules first, then an empirical-Bayes reputation of hosts.

Outcomes of labelled pages are counted by host, registered domain and public suffix.  Each level's
good/bad counts are shrunk towards the level above by a beta-binomial prior whose strength is fitted by
the method of moments over all groups of the level.  A url is blocked when the lower posterior bound of its
host (or, for a host without labels, of the nearest known level) is below the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Posterior bound: mean - Z * standard deviation, compared with the least acceptable share of good pages.
Z = 1.645
LEAST_GOOD = 0.75
# Bounds of a prior's strength in pseudo-counts.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain_of(host: Column) -> Column:
    """The last two labels of a host: the registered domain under one-label suffixes."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path length together) and its verdict, else nulls.

    ``rules`` are (verdict, host, path prefix).  A rule fits its host and all subdomains of it.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _prior(groups: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """Posterior mean, bound and strength of each group of a level, given its parent's mean.

    The strength comes from the spread of the groups' rates around the parents' means (method of moments):
    rates that differ no more than chance give a strong prior.
    """
    joined = groups.join(parents.select(F.col(parent), F.col("mean").alias("up")), parent)
    n, k, m = F.col("n").cast("double"), F.col("good").cast("double"), F.col("up")
    chance = F.sum(m * (1 - m))
    spread = F.sum(n * F.pow(k / n - m, 2))
    # E[spread] = sum m(1-m) (1 + (n-1) rho); rho = 1 / (strength + 1)
    rho = F.try_divide(spread - chance, F.sum(m * (1 - m) * (n - 1)))
    rho = F.least(F.greatest(rho, F.lit(1 / (MOST_STRENGTH + 1))), F.lit(1 / (LEAST_STRENGTH + 1)))
    strength = joined.agg(F.coalesce(1 / rho - 1, F.lit(MOST_STRENGTH)).alias("strength"))
    a, b = F.col("strength") * m + k, F.col("strength") * (1 - m) + n - k
    mean = a / (a + b)
    deviation = F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return joined.crossJoin(F.broadcast(strength)).select(key, mean.alias("mean"), (mean - Z * deviation).alias("bound"))


def host_reputation(outcomes: DataFrame) -> dict[str, DataFrame]:
    """Reputation tables by level from ``host, good`` (0 or 1; rows with null ``good`` are unlabelled).

    ``all`` has one row; ``suffix``, ``domain`` and ``host`` have ``mean`` and ``bound`` by name.
    Rows are counted by host first, with map-side combination, and levels add up those counts.
    """
    hosts = outcomes.where("good is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good")
    )
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("root", F.lit(1))
    good, n = F.coalesce(F.sum("good"), F.lit(0)) + 1.0, F.coalesce(F.sum("n"), F.lit(0)) + 2.0
    root = suffixes.agg(F.lit(1).alias("root"), (good / n).alias("mean"), (good / n - Z * F.sqrt(good * (n - good) / (n * n * (n + 1)))).alias("bound"))
    by_suffix = _prior(suffixes, root, "suffix", "root")
    by_domain = _prior(domains, by_suffix, "domain", "suffix")
    by_host = _prior(hosts, by_domain, "host", "domain")
    return {"all": root, "suffix": by_suffix, "domain": by_domain, "host": by_host}


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", id_col: str = "page_id",
    least_good: float = LEAST_GOOD,
) -> DataFrame:
    """``<id>, host, path, rule, verdict, bound`` for every page; ``outcomes`` has ``<url>`` and ``good``.

    A null url, or one without ``://``, has an empty host and path and falls to the overall rate.
    Reputation is joined by host on a table of distinct hosts, so a hot host costs one row there;
    the pages themselves take part in one join by host, which Spark can split if it is skewed.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    level = host_reputation(outcomes.select(host_of(F.col(url_col).cast("string")).alias("host"), F.col("good")))
    hosts = rows.select("host").distinct().withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    known = hosts
    for key in ("host", "domain", "suffix"):
        known = known.join(level[key].select(key, F.col("bound").alias(f"by_{key}")), key, "left")
    known = known.crossJoin(F.broadcast(level["all"].select(F.col("bound").alias("by_all"))))
    known = known.select("host", F.coalesce("by_host", "by_domain", "by_suffix", "by_all").alias("bound"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_bound = F.when(F.round("bound", 9) < least_good, "block").otherwise("allow")
    return rows.join(known, "host", "left").select(
        F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_bound).alias("verdict"), "bound"
    )
