"""robots.txt as expressions: one document in, one ordered rule list out.

The text is parsed inside its own row, so no document is split over a shuffle.  Semantics
are those of the usual robots parser: a named group that is contained in the agent name
wins over the ``*`` group, the first such group counts, and inside it the first rule whose
path is a prefix decides.  No group or no rule means allowed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.binding import let

_LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
_LINE_RE = r"(?s)^\s*([^:]*?)\s*:\s*(.*?)\s*$"

# Directives that matter for grouping lines.
_RULES = ["allow", "disallow"]
_DIRECTIVES = ["user-agent", *_RULES, "crawl-delay", "request-rate"]

RULES_TYPE = "array<struct<allow:boolean,prefix:string>>"


def unquote(text: Column) -> Column:
    """Percent-decoding that leaves plus signs and broken escapes alone."""
    safe = F.replace(
        F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")
    )
    return F.when(
        F.contains(text, F.lit("%")), F.coalesce(F.try_url_decode(safe), text)
    ).otherwise(text)


def quote(text: Column) -> Column:
    """Percent-encoding of everything but letters, digits and ``_.-~/``."""
    encoded = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return F.when(text.rlike(r"^[A-Za-z0-9_.\-~/]*$"), text).otherwise(encoded)


def _without_empty_parts(target: Column) -> Column:
    """Drop an empty query and an empty fragment of a path, as URL rebuilding does."""
    return F.regexp_replace(F.regexp_replace(target, r"#$", ""), r"^([^?#]*)\?(#|$)", "$1$2")


def match_target(url: Column) -> Column:
    """The quoted path, query and fragment of ``url`` that rules are compared with."""

    def quoted(tail: Column) -> Column:
        return F.when(tail == "", F.lit("/")).otherwise(quote(tail))

    tail = F.regexp_replace(unquote(url), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    return let(_without_empty_parts(tail), quoted)


def _events(text: Column) -> Column:
    """Grouping-relevant lines as ``STRUCT<kind, value>``; a fully empty line is ``blank``."""

    def event(line: Column) -> Column:
        content = F.substring_index(line, "#", 1)
        return let(
            content,
            lambda c: F.struct(
                F.when(line == "", F.lit("blank"))
                .when(F.contains(c, F.lit(":")), F.lower(F.regexp_extract(c, _LINE_RE, 1)))
                .otherwise(F.lit(""))
                .alias("kind"),
                unquote(F.regexp_extract(c, _LINE_RE, 2)).alias("value"),
            ),
        )

    lines = F.split(text, _LINE_BREAK)
    return F.filter(F.transform(lines, event), lambda e: e["kind"].isin("blank", *_DIRECTIVES))


def _groups(events: Column) -> Column:
    """Groups in file order as ``STRUCT<agents, lines>``; a group without any rule drops out."""

    def mark(e: Column, i: Column) -> Column:
        before = F.get(events, i - 1)["kind"]
        opens = (e["kind"] == "user-agent") & ((i == 0) | (before != "user-agent"))
        return F.struct(i.alias("at"), opens.alias("opens"), (e["kind"] == "blank").alias("blank"))

    def spans(cuts: Column) -> Column:
        with_end = F.transform(
            cuts,
            lambda c, k: F.struct(
                c["opens"].alias("opens"),
                c["at"].alias("at"),
                F.coalesce(F.get(cuts, k + 1)["at"], F.size(events)).alias("until"),
            ),
        )
        return F.transform(
            F.filter(with_end, lambda s: s["opens"]),
            lambda s: F.slice(events, s["at"] + 1, s["until"] - s["at"]),
        )

    cuts = F.filter(F.transform(events, mark), lambda m: m["opens"] | m["blank"])
    groups = F.transform(
        let(cuts, spans),
        lambda g: F.struct(
            F.transform(F.filter(g, lambda e: e["kind"] == "user-agent"), lambda e: e["value"])
            .alias("agents"),
            F.filter(g, lambda e: e["kind"] != "user-agent").alias("lines"),
        ),
    )
    return F.filter(groups, lambda g: F.size(g["lines"]) > 0)


def rules_for_agent(text: Column, agent: str) -> Column:
    """Ordered ``ARRAY<STRUCT<allow, prefix>>`` that binds ``agent``; empty if none does."""
    token = agent.split("/")[0].lower()

    def choose(groups: Column) -> Column:
        named = F.filter(
            groups,
            lambda g: ~F.array_contains(g["agents"], "*")
            & F.exists(g["agents"], lambda a: F.contains(F.lit(token), F.lower(a))),
        )
        default = F.filter(groups, lambda g: F.array_contains(g["agents"], "*"))
        return F.coalesce(F.get(named, F.lit(0))["lines"], F.get(default, F.lit(0))["lines"])

    lines = let(let(_events(text), _groups), choose)
    rules = F.transform(
        F.filter(lines, lambda e: e["kind"].isin(*_RULES)),
        lambda e: F.struct(
            ((e["kind"] == "allow") | (e["value"] == "")).alias("allow"),
            quote(_without_empty_parts(e["value"])).alias("prefix"),
        ),
    )
    return F.coalesce(rules, F.array().cast(RULES_TYPE))


def is_allowed(url: Column, rules: Column) -> Column:
    """First matching rule decides; null or empty rules allow."""

    def verdict(target: Column) -> Column:
        hit = F.filter(rules, lambda r: F.startswith(target, r["prefix"]))
        return F.get(hit, F.lit(0))["allow"]

    return F.when(F.coalesce(F.size(rules), F.lit(0)) <= 0, F.lit(True)).otherwise(
        F.coalesce(let(match_target(url), verdict), F.lit(True))
    )
