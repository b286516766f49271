"""Encoding against a plain Viterbi over the same pieces; exact round trips."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import arrow_text as A
from pagemill.llm import pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "hello world", " hello  world ", "naïve façade — ünïcödé", "日本語のテキスト", "😀👍🏽 ok",
    "line\nline\t\ttab\r\n", "▁literal▁mark", "x" * 3000, "\x00\x01", "<0x41> <s> </s> <unk>", " nb sp",
    "The quick brown fox. " * 50, "é", "é", "𝔘𝔫𝔦",
]


@pytest.fixture(scope="module")
def words():
    return pieces.read_model(MODEL)


def viterbi(words, text):
    """Best score of the text and a best path (longer last pieces first)."""
    if not text:
        return 0.0, []
    text = " " + text
    known = {words.bytes_of[i].decode(): i for i in np.flatnonzero(words.usable)}
    best, path = [0.0], [[]]
    for end in range(1, len(text) + 1):
        options = []
        for length in range(min(end, 20), 0, -1):
            piece = text[end - length : end]
            if piece in known:
                options.append((best[end - length] + words.score[known[piece]], [*path[end - length], known[piece]]))
        if text[end - 1] not in known:
            ids = [int(words.byte_ids[b]) for b in text[end - 1].encode()]
            options.append((best[end - 1] + pieces.UNKNOWN, [*path[end - 1], *ids]))
        score, ids = max(options, key=lambda o: o[0])
        best.append(score)
        path.append(ids)
    return best[-1], path[-1]


def test_matches_plain_viterbi(words):
    auto = pieces.Automaton(words)
    texts = [t if t is None or len(t) < 400 else t[:400] for t in ODD]
    ids, bounds = pieces.encode(auto, words, *A.view(pa.array(texts)))
    for r, text in enumerate(texts):
        assert ids[bounds[r] : bounds[r + 1]].tolist() == viterbi(words, text)[1], text


def test_round_trip_of_query(spark, sf_dir, words):
    out = queries.QUERIES["op10_sentence_pieces"](spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    assert {r["doc_id"] for r in out} == set(texts) and all(r["round_trip"] for r in out)
    for r in out[:6]:
        if len(texts[r["doc_id"]]) < 4000:
            assert r["ids"] == viterbi(words, texts[r["doc_id"]])[1]


def test_odd_texts_through_spark(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit(1))
    rows = pieces.encoded(docs, MODEL)
    assert all(r["round_trip"] for r in rows.collect())
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(rows, MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    twice = docs.filter("doc_id = 5").unionAll(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    assert len({tuple(r["ids"]) for r in pieces.encoded(twice, MODEL).collect()}) == 1
    assert pieces.encoded(docs.limit(0), MODEL).count() == 0
    assert pieces.decoded(rows.limit(0), MODEL).count() == 0
