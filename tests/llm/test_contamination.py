"""Greedy string tiling against a quadratic version, and what counts as a leak."""

import random

import numpy as np
import plain
from pyspark.sql import functions as F

from pagemill.llm import contamination, queries


def brute(doc, item, shortest):
    """Longest first; ties by place in the item, then in the document."""
    free_d, free_i, found = [True] * len(doc), [True] * len(item), []
    while True:
        best = (shortest - 1, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while (i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]
                       and free_d[i + n] and free_i[j + n]):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < shortest:
            return found
        free_d[i : i + n] = free_i[j : j + n] = [False] * n
        found.append((i, j, n))


def test_tiles_match_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        doc = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        item = [rng.randrange(3) for _ in range(rng.randrange(1, 25))]
        args = (np.array(doc, np.uint64) + np.uint64(9), np.arange(len(doc)), np.array(item, np.uint64) + np.uint64(9), 3)
        assert contamination.tiles(*args) == brute(doc, item, 3)


def covered(text, item):
    a, b = plain.words(text, True), plain.words(item, True)
    return sum(n for _, _, n in brute(a, b, max(1, min(contamination.TILE, len(b))))), len(b)


def test_leaks_match_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.randrange(3, 30)) for _ in range(12)] + [["a"] * 9, [], say(4)]
    docs = []
    for i in range(60):
        text = say(rng.randrange(0, 60))
        if i % 2:
            parts = list(items[i % len(items)])
            cut = rng.randrange(len(parts) + 1)
            parts = parts[cut:] + parts[:cut] if i % 4 == 1 else parts[: max(5, cut)]
            at = rng.randrange(len(text) + 1)
            text[at:at] = parts * (1 + i % 3)
        docs.append(" ".join(text).upper() if i % 5 == 0 else " \n".join(text))
    docs += [None, "", "a " * 3000, docs[3]]
    texts = [" ".join(x) for x in items] + [None]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("seeds", F.lit(1))
    b = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").withColumn("words", F.lit("x"))
    got = {(r["doc_id"], r["item_id"]): r["tiled_words"] for r in contamination.leaks(d, b).collect()}
    want = {}
    for i, t in enumerate(docs):
        for j, x in enumerate(texts):
            n, size = covered(t[:200] if t and t.startswith("a a") else t, x)
            if size and n >= contamination.COVERAGE * size:
                want[i, j] = n
    assert got == want and len(want) >= 20
    kept = contamination.clean(d, b)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(docs))) - {i for i, _ in want})


def test_query_finds_whole_items(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").collect()
    items = queries.table(spark, sf_dir, "benchmark").collect()
    got = {(r["doc_id"], r["item_id"]) for r in queries.leaked_benchmark(spark, sf_dir).collect()}
    whole = lambda t: f" {' '.join(plain.words(t, True))} "
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if whole(i["text"]) in whole(d["text"])}
    assert want <= got


def test_short_items_match_as_a_whole(spark):
    texts = ["One", "two words", "now three words", "four of these words", "five of all these words", "words now three"]
    d = spark.createDataFrame(
        [(0, "it is ONE x"), (1, "oneness"), (2, "x two  words now three\nwords y"), (3, "four of these other words"),
         (4, "five of all these words"), (5, "two\twords"), (6, "words two")], "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["tiled_words"], r["item_words"]) for r in contamination.leaks(d, b).collect()}
    assert got == {(0, 0, 1, 1), (2, 1, 2, 2), (2, 2, 3, 3), (2, 5, 3, 3), (4, 4, 5, 5), (5, 1, 2, 2)}


def test_clean_keeps_columns_of_any_name(spark):
    d = spark.createDataFrame(
        [("r", 1, "a b c d e f", 5, "s"), ("k", 2, "other text", 6, "t")], "_key string, doc_id long, text string, _row long, `x.y` string"
    )
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    kept = contamination.clean(d, b)
    assert kept.columns == d.columns and [tuple(r) for r in kept.collect()] == [("k", 2, "other text", 6, "t")]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "a b c d e f")], "item_id long, text string")
    assert contamination.leaks(d, b).count() == 2
    assert contamination.leaks(d.limit(0), b).count() == 0
    assert contamination.leaks(d, b.limit(0)).count() == 0
    assert contamination.clean(d, b.limit(0)).count() == 2
    assert contamination.clean(d, b).count() == 0
