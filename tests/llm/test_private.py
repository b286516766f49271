"""Personal data against Python's own regular expressions, and what the contexts add."""

import hashlib

import plain
from pyspark.sql import functions as F

from pagemill.llm import private, queries

ODD = [
    "write a@b.c_d@e.f now", "x@y", "a@b..c", "@a.b", "a@b.c.@d.e", "", None, " ", "1.2.3.4.5.6.7.8",
    "0001.02.3.4 256.1.1.1 1.2.3.999", "4111 1111 1111 1111", "4111-1111-1111-1111-5", "4111  1111",
    "+1 (269) 555-3296 and +12345678", "+1+1 234 567 890 +", "1" * 5000, "7 " * 4000, "a" * 60000,
    "a." * 20000 + "@", "+" + "1-" * 9000 + "x", "é@ü.de 😀 a@b.cd 😀 10.0.0.1", "4539578763621486",
    "a@b.c4111111111111111", "12.12.12.12@1.2.3.4",
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_spans_of_odd_texts(spark):
    got = {r["doc_id"]: r["spans"] for r in private.find(rows(spark, ODD)).collect()}
    for i, text in enumerate(ODD):
        mine = [(s["start"], s["kind"], s["end"]) for s in got[i] if s["seed"]]
        assert mine == plain.base_spans(text), text


def test_query_matches_python(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    for r in queries.personal_data(spark, sf_dir).collect():
        spans = plain.base_spans(texts[r["doc_id"]])
        line = ",".join(f"{plain.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{kind}"] for kind in plain.KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(line.split(",")) - {""} <= set(r["spans"].split(","))


def seeded():
    """A context that always holds cards finds the mistyped ones; a general one finds nothing."""
    valid = ["4539578763621486", "4485275742308327", "4716461583322103", "4929939187355598"]
    assert all(plain.luhn(v) for v in valid)
    texts = [f"The card number: {v} was used." for v in valid]
    texts += ["The card number: 4539578763621487 was used.", "Order of 123456789012 pieces"]
    return texts + [f"Order of {n} pieces" for n in range(100, 120)] + ["order of 4539578763621486 pieces"] * 3


def test_contexts_find_unseen_numbers(spark):
    got = {r["doc_id"]: r["spans"] for r in private.find(rows(spark, seeded())).collect()}
    added = {i: [(s["kind"], s["start"]) for s in spans if not s["seed"]] for i, spans in got.items()}
    assert added.pop(4) == [(2, 17)]
    assert not any(added.values())


def test_contexts_have_no_reach_and_fillers_no_full_stop(spark):
    """A word of 400 letters is a context as a whole; a full stop after an address is outside the span."""
    long, other = "w" * 400, "v" + "w" * 399
    texts = [f"the host {long}{' ' * 300}10.0.0.{i} is up" for i in range(9)]
    texts += [f"the host {long} 10[.]0[.]0[.]9. Is up", f"the host {other} 10[.]0[.]0[.]8 is up"]
    got = {r["doc_id"]: r["spans"] for r in private.find(rows(spark, texts)).collect()}
    start = texts[9].index("10[")
    assert [(s["kind"], s["start"], s["end"]) for s in got[9]] == [(1, start, start + len("10[.]0[.]0[.]9"))]
    assert got[10] == []


def test_masking_keeps_rows_and_columns(spark):
    texts = [*seeded(), None, "", "😀 a@b.cd 4111 1111 1111 1111 +1 (269) 555-3296."]
    docs = rows(spark, texts).withColumn("_pii_row", F.lit(7)).withColumn("start", F.lit("s"))
    out = private.mask(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(got) == len(texts)
    assert got[len(texts) - 1] == "😀 [EMAIL] [CARD] [PHONE]."
    assert got[4] == "The card number: [CARD] was used."
    assert got[5] == texts[5]
    assert got[len(texts) - 3] is None and got[len(texts) - 2] == ""


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a@b.cd"), (1, "a@b.cd"), (1, "a@b.cd"), (1, "x")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, len(r["spans"])) for r in private.find(docs).collect())
    assert got == [(-1, 1), (1, 0), (1, 1), (1, 1)]
    assert private.find(docs.limit(0)).count() == 0
    assert private.mask(docs.limit(0)).count() == 0
