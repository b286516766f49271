"""robots.txt documents: ``(domain, text)`` rows to rules of one agent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.robots import RULES_TYPE, rules_for_agent
from pagemill.operators.rows import explode_with_position


def compile_rules(docs: DataFrame, agent: str) -> DataFrame:
    """``(domain, rules)``, one row per domain; of several documents the least text counts."""
    one = docs.groupBy("domain").agg(F.min("text").alias("text"))
    return one.select("domain", rules_for_agent(F.col("text"), agent).alias("rules"))


# A list of more rules is no array beside every address, but rows found by their prefix.
WALKED = 64


def short_lists(rules: DataFrame, walked: int = WALKED) -> DataFrame:
    """``(domain, rules, _lengths)``: a list longer than ``walked`` gives only its prefixes' lengths."""
    long = F.size("rules") > walked
    lengths = F.array_distinct(F.transform("rules", lambda r: F.char_length(r["prefix"])))
    return rules.select(
        "domain", F.when(long, F.array().cast(RULES_TYPE)).otherwise(F.col("rules")).alias("rules"),
        F.when(long, lengths).alias("_lengths"),
    )


def prefix_rules(rules: DataFrame, walked: int = WALKED) -> DataFrame:
    """``(domain, prefix, rule_no, allow)``, one row per prefix of a long list: its first rule."""
    long = rules.where(F.size("rules") > walked)
    rows = explode_with_position(long, ["domain"], F.col("rules"), "rule_no", "rule")
    first = F.min(F.struct("rule_no", "rule.allow")).alias("first")
    return rows.groupBy("domain", F.col("rule.prefix").alias("prefix")).agg(first).select("domain", "prefix", "first.*")


def rule_rows(docs: DataFrame, agent: str) -> DataFrame:
    """``(domain, rule_no, allow, prefix)`` in file order."""
    rules = compile_rules(docs, agent)
    return explode_with_position(rules, ["domain"], F.col("rules"), "rule_no", "rule").select(
        "domain", "rule_no", "rule.allow", "rule.prefix"
    )
