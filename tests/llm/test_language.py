"""Code lengths against a plain PPM, held-out accuracy and odd input."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import arrow_text as A
from pagemill.llm import language, queries

TEXTS = {"aa": ["abracadabra", "abra", "Ünder"], "bb": ["banana bandana", "nab"], "cc": ["\x00odd\x00", "é"]}


def plain_cost(texts, wanted):
    """Bits of a text under PPM trees of some texts."""
    counts = Counter()
    for t in texts:
        raw = bytes(language.ORDER) + t.encode()
        for i in range(language.ORDER, len(raw)):
            for k in range(language.ORDER + 1):
                counts[raw[i - k : i + 1]] += 1
    raw, total = bytes(language.ORDER) + wanted.encode(), 0.0
    for i in range(language.ORDER, len(raw)):
        for k in range(language.ORDER, -1, -1):
            context = raw[i - k : i]
            own = [c for s, c in counts.items() if len(s) == k + 1 and s[:-1] == context]
            n, d = sum(own), len(own)
            if counts[raw[i - k : i + 1]]:
                total -= math.log2(counts[raw[i - k : i + 1]] / (n + d))
                break
            if n:
                total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def trees():
    table = Counter()
    for i, texts in enumerate(TEXTS.values()):
        for key in language.strings(*A.view(pa.array(texts))).tolist():
            table[i, key] += 1
    lang, key = (np.array(x) for x in zip(*table, strict=True))
    return language.build(list(TEXTS), lang, key.astype(np.uint64), np.array(list(table.values())))


def test_costs_match_plain_ppm():
    wanted = ["abracadabra", "band", "x", "Ünd é", "", "a", "\x00o", "nab ra ban"]
    got = language.costs(trees(), *A.view(pa.array(wanted)))
    want = [[plain_cost(texts, w) for texts in TEXTS.values()] for w in wanted]
    assert np.allclose(got, want)


def test_held_out_accuracy(spark, sf_dir):
    docs = {r["doc_id"]: r for r in queries.table(spark, sf_dir, "documents").collect()}
    out = {r["doc_id"]: r for r in queries.languages(spark, sf_dir).collect()}
    assert set(out) == set(docs)
    assert all(r["held_out"] == (crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in out.items())
    held = [i for i, r in out.items() if r["held_out"] and any(c.isalpha() for c in docs[i]["text"])]
    assert np.mean([out[i]["lang_pred"] == docs[i]["lang"] for i in held]) > 0.97


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, "xx", "some words here"), (1, "yy", "ganz andere wörter"), (1, "yy", "ganz andere wörter"),
            (4, None, "some wordy"), (5, "xx", None), (6, "xx", "12 34 !"), (7, None, ""), (9, None, "wörter " * 9000)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("score", F.lit(1)).withColumn("_x", F.lit(2))


def test_nulls_and_repeats(spark, odd):
    model = language.train(odd)
    assert model.langs == ["xx", "yy"]
    out = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in language.predict(odd, model).collect())
    assert out == [(0, "xx"), (1, "yy"), (1, "yy"), (4, "xx"), (5, "und"), (6, "und"), (7, "und"), (9, "yy")]
    kept = language.known_only(odd, model)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0, r["lang"]) for r in kept.collect()) == [(0, "xx"), (1, "yy"), (1, "yy"), (4, "xx"), (9, "yy")]


def test_nothing_to_learn_from(spark, odd):
    assert language.train(odd.limit(0)) is None
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(odd.limit(0), trees()).count() == 0
    assert language.known_only(odd.limit(0), trees()).count() == 0


def test_languages_of_long_texts_are_learned(spark):
    rows = [(0, "xx", "aa bb " * 50), (1, "yy", "çé ou " * 400), (4, "yy", "çé ou " * 300), (6, "zz", "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    took = {r["lang"]: r["text"] for r in language.sample(docs, size=1000).collect()}
    assert set(took) == {"xx", "yy", "zz"} and took["xx"] == rows[0][2]
    assert 0 < len(took["yy"].encode()) <= 1000 and set(took["yy"]) == set("çé ou ")
    out = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.train(docs, size=1000)).collect()}
    assert out == {0: "xx", 1: "yy", 4: "yy", 6: "und"}


def test_no_known_language_loses_no_clean_text(spark, odd):
    kept = language.known_only(odd, language.train(odd.withColumn("lang", F.lit(None).cast("string"))))
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 4, 9]


def test_sample_is_the_same_however_rows_are_dealt(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "'xx' AS lang", "concat('word ', id) AS text")
    first = sorted(r["text"] for r in language.sample(docs.repartition(5), texts=40).collect())
    assert len(first) == 40 and first == sorted(r["text"] for r in language.sample(docs.coalesce(1), texts=40).collect())


def test_held_out_rows_are_not_learned_from(spark):
    out = next(i for i in range(99) if crc32(str(i).encode()) % 4 == 2)
    docs = spark.createDataFrame([(out, "zz", "zz zz"), (0, "xx", "aa aa")], "doc_id long, lang string, text string")
    assert language.train(docs).langs == ["xx"]
