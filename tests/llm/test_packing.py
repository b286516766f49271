"""Packing against the tokenizer's own library and plain bounds."""

import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm import arrow_text as A
from pagemill.llm import packing, queries

FILE = queries.tokenizer("byte_bpe_50k.json")


def plain_pieces(tokenizer, text, capacity=1024):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
    return [(k, a, b - a, ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def check_places(rows, capacity=1024):
    """Every sequence is filled without gaps, up to the capacity."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


def test_query_contract(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").collect()
    rows = queries.packed_sequences(spark, sf_dir).collect()
    tokenizer = Tokenizer.from_file(FILE)
    want = Counter(
        (r["doc_id"], k, start, length, crc32(np.array(ids, "<u4").tobytes()))
        for r in docs for k, start, length, ids in plain_pieces(tokenizer, r["text"])
    )
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    n = check_places(rows)
    short = [length for _, _, _, length, _ in want.elements() if length < 1024]
    least = -(-sum(short) // 1024) + sum(v for k, v in want.items() if k[3] == 1024)
    assert n <= least * 1.02


def test_ids_are_the_librarys(spark):
    texts = [
        None, "", " ", "a", "it's we'll, (so)  x.\n\n y\t\tz!", "<|endoftext|>", "a<|endoftext|>b. <|endoftext|>, c",
        "é,è. naïve;   x , y 　z", "word." * 900, "x" * 4000, "\n" * 3000, "日本語。 テスト, ok.", "A.B,C;D:E!F?G)H",
        "tab\t.dot ,\u0085 next", "a  b  c  d",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.withColumn("uid", F.lit("x")).withColumn("length", F.lit(1)).withColumn("ids", F.lit(None).cast("int"))
    tokenizer = Tokenizer.from_file(FILE)
    cut = packing.cut_pieces(docs, FILE)
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], list(np.frombuffer(r["ids"], "<u4"))) for r in cut.collect())
    assert got == sorted((i, *p) for i, t in enumerate(texts) for p in plain_pieces(tokenizer, t))
    joined = packing.sequences(packing.pack(cut)).collect()
    assert sum(len(r["ids"]) for r in joined) == sum(len(p[3]) for t in texts for p in plain_pieces(tokenizer, t))
    assert all(len(r["ids"]) <= 1024 and r["ids"].count(2) >= 0 for r in joined)
    # each piece is found again at its place
    places = {r["sequence_id"]: r["ids"] for r in joined}
    for r in packing.pack(cut).collect():
        at = places[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert at == list(np.frombuffer(r["ids"], "<u4"))


def lengths_frame(spark, lengths):
    return spark.createDataFrame([(i, int(x), f"p{i}") for i, x in enumerate(lengths)], "uid long, length long, row string")


@pytest.mark.parametrize("kind", ["many", "large", "equal", "odd"])
def test_pack_in_groups(spark, kind):
    r = np.random.default_rng(3)
    lengths = {
        "many": r.integers(1, 100, 3000), "large": r.integers(50, 101, 600), "equal": np.full(500, 60),
        "odd": np.concatenate([r.integers(1, 101, 500), np.full(40, 100), [1]]),
    }[kind]
    rows = packing.pack(lengths_frame(spark, lengths), capacity=100, group=200).collect()
    assert sorted((x["uid"], x["length"], x["row"]) for x in rows) == [(i, x, f"p{i}") for i, x in enumerate(lengths.tolist())]
    n = check_places(rows, 100)
    decreasing = packing.Bins(lengths, 100).count()
    assert n <= 1.015 * decreasing + 2  # groups this small cost little against best fit over everything at once


def test_search_beats_best_fit():
    r = np.random.default_rng(5)
    better = 0
    for seed in range(12):
        lengths = r.integers(200, 500, 150)
        bins = packing.Bins(lengths, 1024)
        before, fill = bins.count(), sum((1024 - g) ** 2 for g, b in zip(bins.gap, bins.items) if b)
        bins.improve()
        assert sorted(i for b in bins.items for i in b) == list(range(150))
        for b, g in zip(bins.items, bins.gap):
            assert 1024 - g == sum(lengths[i] for i in b) and 0 <= g <= 1024
        assert bins.least <= bins.count() <= before
        assert sum((1024 - g) ** 2 for g, b in zip(bins.gap, bins.items) if b) >= fill
        better += bins.count() < before
    assert better >= 6


def test_each_exchange_raises_the_squared_fill():
    lengths = np.random.default_rng(6).integers(250, 480, 120)
    bins = packing.Bins(lengths, 1024)
    swap, last = bins._swap, [sum((1024 - g) ** 2 for g in bins.gap)]

    def watched(*args):
        swap(*args)
        now = sum((1024 - g) ** 2 for g in bins.gap)
        assert now > last[-1]
        last.append(now)

    bins._swap = watched
    bins.improve()
    assert len(last) > 5


def test_repeats_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (None, None), (None, "x " * 1500)], "doc_id long, text string")
    rows = packing.pack(packing.cut_pieces(docs, FILE).drop("ids")).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"]) for r in rows) == Counter(
        [(1, 0, 0), (1, 0, 0), (None, 0, 0), (None, 0, 0)] + [(None, k + 1, s) for k, s in enumerate(range(478, 1502, 1024))]
    ) or len(rows) == 5
    check_places(rows)
    assert packing.pack(packing.cut_pieces(docs.limit(0), FILE)).count() == 0


def test_unknown_parts_are_joined_to_few_calls():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzéßñжщ漢字"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(300)) for _ in range(20)]
    odd = ["", " ", "a  b", "tab\tone\n\n two ", "x  y", "x  y　 z", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>",
           "it's, it's; (so) ...", " lead", "trail ", "é áb", "\U0001f600 \U0001f600x", "à\u0085 b", "12 345 6.7"]
    encoder = packing.Encoder(queries.tokenizer("byte_bpe_50k.json"))
    whole = encoder.tokenizer
    given = []

    class Counting:
        def encode_batch_fast(self, some, **options):
            given.extend(some)
            return whole.encode_batch_fast(some, **options)

    encoder.tokenizer = Counting()
    for rows in (texts, odd, texts + odd):
        ids, bounds = encoder.encode(*A.view(pa.array(rows)))
        got = [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(rows))]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in rows]
    words = len({w for t in texts for w in t.split()})
    assert words > 3000 and len(given) < words / 10
