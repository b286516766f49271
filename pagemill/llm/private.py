"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base spans (e-mail, IP, card and phone numbers by pattern) are the seeds.  The words around
them are lexical patterns; every other run holding a digit or an at sign is a filler of the
same slots.  Patterns and fillers form a graph scored in rounds:

* a pattern's confidence for a kind is the summed score of the distinct instances of that kind
  it surrounds, over all distinct instances it surrounds;
* a filler shaped like a kind scores ``1 - prod(1 - confidence)`` over its patterns that are
  confident and supported by enough distinct instances.

Fillers that end above ``accept`` become further spans.  The graph is a table: no group of it is
collected, a hot pattern or value is one row per map task when it is aggregated.

Defined results: a null text is empty; repeated rows and equal ids are answered row by row;
an empty table gives an empty table; further columns are ignored by :func:`find` and kept by
:func:`mask`, whatever their names (own columns are prefixed with ``_pii``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.binding import let
from pagemill.storage import new_folder, write_table

# The kinds in their order, and what each looks like.
KINDS = ("email", "ip", "card", "phone")
# A run is only tried from its first character (or where the last match ended), and runs are
# possessive: the matches are those of the plain patterns, in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MAY_HOLD = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OTHER = r"A-Za-z._%+()\[\]-"
# A full stop that ends a sentence is no part of a filler
FILLER = rf"(?<![0-9@{OTHER}])[{OTHER}]*+[0-9@](?:[0-9@{OTHER.replace('.', '')}]|\.(?=[0-9A-Za-z@(\[])|(?<=[(\[])\.)*+"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
AT = r"(?:@|\(at\)|\[at\])"
DOT = r"(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))"


class Params(NamedTuple):
    rounds: int = 3
    support: float = 3.0
    """Summed score of distinct instances below which a pattern says nothing."""
    confidence: float = 0.8
    accept: float = 0.8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def add(total: Column, item: Column) -> Column:
        return total + item

    def weigh(digit: Column, i: Column) -> Column:
        twice = digit.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    each = F.transform(F.split(F.reverse(digits), "(?!^)(?=.)"), weigh)
    return F.aggregate(each, F.lit(0), add) % 10 == 0


def is_valid(kind: Column, value: Column) -> Column:
    """The tests a match of a base pattern has to pass."""
    n = F.length(_digits(value))
    card = F.when(n.between(12, 19), luhn(_digits(value))).otherwise(False)
    return (
        F.when(kind == 0, True)
        .when(kind == 1, value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
        .when(kind == 2, card)
        .otherwise(n.between(9, 15))
    )


def shape(value: Column) -> Column:
    """The kind a filler looks like (null: none of them)."""
    n = F.length(_digits(value))
    plain = value.rlike(r"^[0-9().-]+$")
    return (
        F.when(value.rlike(rf"^[A-Za-z0-9._%+-]+{AT}[A-Za-z0-9]"), 0)
        .when(value.rlike(rf"^[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}}$"), 1)
        .when(plain & n.between(12, 19), 2)
        .when(plain & n.between(7, 11), 3)
    )


def _before(gap: Column, pattern: str) -> Column:
    """The last words of a gap, looked for from its end so that its length does not matter."""
    return F.lower(F.reverse(F.regexp_extract(F.reverse(gap), pattern, 1)))


def _matches(text: Column, pattern: str, cue: str | None) -> Column:
    """Matches in order: characters since the last one, the match, the words at either side."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    may = text.contains(cue) if cue else text.rlike("[0-9@]")

    def build(gaps: Column) -> Column:
        return F.transform(
            found,
            lambda value, i: F.struct(
                F.length(F.get(gaps, i)).alias("gap"),
                value.alias("value"),
                _before(F.get(gaps, i), r"^\s*+(\S++\s++\S++)").alias("left"),
                _before(F.get(gaps, i), r"^\s*+(\S++)").alias("near"),
                F.lower(F.regexp_extract(F.get(gaps, i + 1), r"^\s*+(\S++)", 1)).alias("right"),
            ),
        )

    none = F.array().cast(
        "array<struct<gap:int,value:string,left:string,near:string,right:string>>"
    )
    return F.when(may, let(F.split(text, pattern, -1), build)).otherwise(none)


def scan(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """One pass over the texts: a row id, ``keep`` and the matches of every pattern."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    patterns = [(BASE[k], MAY_HOLD[k]) for k in KINDS] + [(FILLER, None)]
    return docs.select(
        F.monotonically_increasing_id().alias("_pii_row"),
        *keep,
        *[_matches(body, p, cue).alias(f"_pii_{i}") for i, (p, cue) in enumerate(patterns)],
    )


def occurrences(scanned: DataFrame) -> DataFrame:
    """A row per span: base spans that pass their test, and fillers that touch none of them."""
    parts = [
        scanned.select("_pii_row", F.lit(i).alias("source"), F.posexplode(f"_pii_{i}").alias("at", "m"))
        for i in range(len(KINDS) + 1)
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    upto = Window.partitionBy("_pii_row", "source").orderBy("at")
    end = F.sum(F.col("m.gap") + F.length("m.value")).over(upto).cast("int")
    spans = rows.select(
        "_pii_row", "source", (end - F.length("m.value")).alias("start"), end.alias("end"),
        "m.value", "m.left", "m.near", "m.right",
    ).filter((F.col("source") == len(KINDS)) | is_valid(F.col("source"), F.col("value")))
    base = F.col("source") < len(KINDS)
    order = Window.partitionBy("_pii_row").orderBy("start", "end")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    touched = (F.coalesce(before, F.lit(0)) > F.col("start")) | (
        F.coalesce(after, F.col("end")) < F.col("end")
    )
    return (
        spans.withColumn("touched", touched)
        .filter(base | ~F.col("touched"))
        .select(
            "_pii_row", "start", "end", "value", "left", "near", "right", base.alias("seed"),
            F.when(base, F.col("source")).otherwise(shape(F.col("value"))).alias("kind"),
        )
    )


def edges(spans: DataFrame) -> DataFrame:
    """The graph: distinct (pattern, instance) pairs; an instance with a base span is a seed."""
    both = F.array(
        F.when(F.col("left") != "", F.concat(F.lit("two before: "), "left")),
        F.when(
            (F.col("near") != "") & (F.col("right") != ""),
            F.concat(F.lit("around: "), "near", F.lit(" _ "), "right"),
        ),
    )
    return (
        spans.select(
            F.explode(F.filter(both, lambda p: p.isNotNull())).alias("pattern"),
            "kind", F.lower("value").alias("instance"), "seed",
        )
        .groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed"))
        .withColumn("score", F.col("seed").cast("double"))
    )


def patterns(graph: DataFrame, params: Params) -> DataFrame:
    """Confident patterns of each kind, with how sure they are."""
    sums = [
        F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"s{k}")
        for k in range(len(KINDS))
    ]
    by_kind = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"s{k}").alias("weight")) for k in range(len(KINDS))
    ])
    return (
        graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *sums)
        .select("pattern", "n", F.explode(by_kind).alias("k"))
        .select("pattern", "k.kind", (F.col("k.weight") / F.col("n")).alias("confidence"), "k.weight")
        .filter((F.col("weight") >= params.support) & (F.col("confidence") >= params.confidence))
        .drop("weight")
    )


def instances(graph: DataFrame, found: DataFrame) -> DataFrame:
    """Scores of the instances that confident patterns surround."""
    miss = F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))
    return (
        graph.join(found, ["pattern", "kind"])
        .groupBy("kind", "instance").agg((1 - F.exp(F.sum(miss))).alias("found"))
    )


def bootstrap(spans: DataFrame, params: Params = Params()) -> DataFrame:
    """Accepted instances (kind, instance): the rounds, each written before the next reads it."""
    spark = spans.sparkSession
    graph = write_table(edges(spans), new_folder(spark, "pii-graph"))
    for step in range(params.rounds):
        scores = instances(graph, patterns(graph, params))
        if step == params.rounds - 1:
            return scores.filter(F.col("found") >= params.accept).drop("found")
        graph = write_table(
            graph.join(scores, ["kind", "instance"], "left").select(
                "pattern", "kind", "instance", "seed",
                F.when(F.col("seed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0))).alias("score"),
            ),
            new_folder(spark, "pii-graph"),
        )
    return graph.select("kind", "instance").limit(0)


def all_spans(scanned: DataFrame, params: Params = Params()) -> DataFrame:
    """``_pii_row`` and its spans in order, for rows that have any."""
    spark = scanned.sparkSession
    spans = write_table(occurrences(scanned), new_folder(spark, "pii-spans"))
    accepted = bootstrap(spans, params)
    added = (
        spans.filter(~F.col("seed") & F.col("kind").isNotNull())
        .withColumn("instance", F.lower("value"))
        .join(accepted, ["kind", "instance"], "left_semi")
    )
    cols = ["_pii_row", "start", "end", "kind", "seed"]
    one = F.struct("start", "kind", "end", "seed")
    return (
        spans.filter("seed").select(cols).unionByName(added.select(cols))
        .groupBy("_pii_row").agg(F.array_sort(F.collect_list(one)).alias("_pii_spans"))
    )


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """A row for each row of ``docs``: its id and ``spans`` (start, kind, end, seed), in order."""
    spark = docs.sparkSession
    scanned = write_table(scan(docs, text, [F.col(id_col)]), new_folder(spark, "pii-scan"))
    return (
        scanned.select("_pii_row", id_col).join(all_spans(scanned, params), "_pii_row", "left")
        .select(id_col, F.coalesce("_pii_spans", F.array().cast(
            "array<struct<start:int,kind:int,end:int,seed:boolean>>")).alias("spans"))
    )


def written(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def masked(body: Column, spans: Column) -> Column:
    """The text with each group of overlapping spans replaced by the first one's ``[KIND]``."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(done: Column, s: Column) -> Column:
        covered = s["start"] < done["to"]
        return F.struct(
            F.when(covered, done["out"]).otherwise(F.concat(
                done["out"],
                F.array(F.substring(body, done["to"] + 1, s["start"] - done["to"]), F.get(names, s["kind"])),
            )).alias("out"),
            F.greatest(done["to"], s["end"]).alias("to"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("to"))
    rest = F.lit(2147483647)
    return F.aggregate(
        spans, start, cut,
        lambda done: F.concat(F.array_join(done["out"], ""), F.substring(body, done["to"] + 1, rest)),
    )


def mask(docs: DataFrame, text: str = "text", params: Params = Params()) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced; all columns and rows stay.

    Only rows with spans meet the spans in a shuffle; the others go from the scan to the result.
    """
    spark = docs.sparkSession
    scanned = write_table(
        scan(docs, text, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_pii_doc")]),
        new_folder(spark, "pii-scan"),
    )
    spans = all_spans(scanned, params)
    touched = F.lit(False)
    for i in range(len(KINDS) + 1):
        touched = touched | (F.size(f"_pii_{i}") > 0)
    slim = scanned.select("_pii_row", "_pii_doc", touched.alias("_pii_touched"))
    out = [F.col(f"_pii_doc.`{c}`").alias(c) for c in docs.columns]
    clean = slim.filter(~F.col("_pii_touched")).select(out)
    body = F.col(f"_pii_doc.`{text}`")
    changed = [
        F.when(F.col("_pii_spans").isNull(), body).otherwise(masked(body, F.col("_pii_spans"))).alias(c)
        if c == text else F.col(f"_pii_doc.`{c}`").alias(c)
        for c in docs.columns
    ]
    return clean.unionByName(
        slim.filter("_pii_touched").join(spans, "_pii_row", "left").select(changed)
    )
