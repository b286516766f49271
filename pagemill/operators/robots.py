"""Robots verdict per address: rules of its domain, found by a skew-safe join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.robots import is_allowed, match_target
from pagemill.functions.urls import domain_key
from pagemill.operators.skew import salted_left_join


def with_verdict(
    requests: DataFrame, rules: DataFrame | None, hot: DataFrame | None = None, prefixes: DataFrame | None = None
) -> DataFrame:
    """``requests`` (with ``url``) plus ``allowed``; ``rules`` of ``None`` switches robots off.

    ``rules`` holds one compiled list per domain, so the join never multiplies rows; one
    host with a large share of the addresses is spread over salts.  With ``prefixes`` (of
    ``prefix_rules``, and ``rules`` of ``short_lists``) addresses of hosts with long lists look up
    their own prefixes instead of walking a list.
    """
    if rules is None:
        return requests.withColumn("allowed", F.lit(True))
    asked = requests.withColumn("domain", domain_key(F.col("url")))
    joined = salted_left_join(asked, rules, "domain", F.col("url"), hot)
    allowed = is_allowed(F.col("url"), F.col("rules"))
    if prefixes is None:
        return joined.withColumn("allowed", allowed).drop("domain", "rules")
    found = first_rules(joined.where(F.col("_lengths").isNotNull()), prefixes, hot)
    return (
        joined.join(found.withColumnRenamed("allow", "_allow"), "url", "left")
        .withColumn("allowed", F.coalesce("_allow", allowed)).drop("domain", "rules", "_lengths", "_allow")
        .select(*requests.columns, "allowed")
    )


def first_rules(asked: DataFrame, prefixes: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """``(url, allow)`` of the first rule that matches each of ``asked`` (``url, domain, _lengths``).

    An address has one candidate for every length of its host's prefixes, not one for every rule.
    """
    targets = asked.groupBy("url").agg(F.first("domain").alias("domain"), F.first("_lengths").alias("_lengths"))
    targets = targets.withColumn("_target", match_target(F.col("url")))
    fitting = F.filter("_lengths", lambda n: n <= F.char_length("_target"))
    candidates = targets.select("url", "domain", "_target", F.explode(fitting).alias("_n")).select(
        "url", "domain", F.expr("substring(_target, 1, _n)").alias("prefix")
    )
    matched = salted_left_join(candidates, prefixes, "domain", F.col("url"), hot, also=["prefix"])
    first = F.min(F.struct("rule_no", "allow")).alias("first")
    return matched.where(F.col("rule_no").isNotNull()).groupBy("url").agg(first).select("url", "first.allow")


def domains_checked(requests: DataFrame) -> DataFrame:
    return requests.select(domain_key(F.col("url")).alias("domain")).agg(
        F.count_distinct("domain").alias("domains_checked")
    )
