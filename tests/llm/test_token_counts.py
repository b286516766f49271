"""Token counts against the tokenizer on whole texts."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm import queries, token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "   ", "\n\n", "a", "it's we'll  they'RE", "x <|endoftext|> y<|endoftext|>\n<|endoftext|>  z",
    "<|endoftext|", "tabs\t\tand\r\nlines \n  end ", "nb sp   x  y", "  a　 b", "e   f\u0085  g",
    "日本語 テキスト", "😀 👍🏽  ok", "12 345 6.7e8", "a" * 5000, "word " * 700, "– “quoted” — x ", "\x1c a \x1f b", "naïve  é xÂ y",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def expected(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def result(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("x"))
    return {r["doc_id"]: r for r in token_counts.count(docs, FILE).collect()}


def test_odd_texts(spark, tokenizer):
    got = result(spark, ODD)
    for i, text in enumerate(ODD):
        assert got[i]["n_tokens"] == expected(tokenizer, text), text
        assert got[i]["n_bytes"] == len((text or "").encode())
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 512)


def test_random_mixtures_over_small_blocks(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(2)
    signs = list("aZé ñ  \n\t.,'“  1#日") + ["the", " of", "'ll", "<|endoftext|>", "  "]
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(400)]
    got = result(spark, texts)
    assert [got[i]["n_tokens"] for i in range(400)] == [expected(tokenizer, t) for t in texts]


def test_query(spark, sf_dir, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    out = {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op6_token_counts"](spark, sf_dir).collect()}
    assert out == {i: expected(tokenizer, t) for i, t in texts.items()}


def test_repeats_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.count(docs, FILE).collect())
    assert got == [(0, 0), (0, 1), (1, 2), (1, 2)]
    assert token_counts.count(docs.limit(0), FILE).count() == 0
