"""Document statistics against plain Python, the trees, and their constraints."""

import numpy as np
import plain
import pyarrow as pa
from pyspark.sql import functions as F

from pagemill.llm import quality, queries

ODD = [
    None, "", " \n\t", "a", "a b c d e a b c d e", "x " * 3000, "l\nl\nl\n\n\n \n l", "é$ü %%% |a| <b> #",
    "a\x0bb\x0cc\rd", "one two", "A" * 70000, "a b c d e f\na b c d e f", "😀 😀 😀 😀 😀 😀",
]


def stats(text):
    w = plain.words(text)
    lines = [x for x in (text or "").split("\n") if plain.words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)} if len(w) < 500 else None
    if covered is None:
        from collections import Counter
        times = Counter(grams)
        covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return [len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)]


def test_statistics_of_odd_texts():
    got = quality.statistics(pa.array(ODD, pa.string()))[:, :5].tolist()
    assert got == [stats(t) for t in ODD]


def test_query_contract(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, sf_dir, "labels").collect()}
    out = {r["doc_id"]: r for r in queries.quality_rules(spark, sf_dir).collect()}
    assert set(out) == set(texts)
    for i, r in out.items():
        w, chars, symbols, lines, repeated = stats(texts[i])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (w, chars, symbols, lines, repeated)
        assert r["base_failed"] == (w < 10 or 100 * repeated > 20 * w)
        assert not (r["base_failed"] and r["kept"])
    good = [i for i, q in labels.items() if q and not out[i]["base_failed"]]
    bad = [i for i, q in labels.items() if not q]
    assert np.mean([out[i]["kept"] for i in good]) > 0.97
    assert np.mean([out[i]["kept"] for i in bad]) < 0.25  # few labels at this size


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.standard_normal(4000)) > 0.5).astype(float)
    free = quality.fit(x, y, falling=frozenset())
    assert np.mean((free.score(x) > 0) == y) > 0.85
    held = quality.fit(x, y, falling=frozenset({1}))
    line = np.repeat(rng.random((200, 3)), 50, 0)
    line[:, 1] = np.tile(np.linspace(0, 1, 50), 200)
    assert (np.diff(held.score(line).reshape(200, 50), axis=1) <= 1e-12).all()
    assert not (np.diff(free.score(line).reshape(200, 50), axis=1) <= 1e-12).all()


def test_nulls_repeats_one_label_and_empty(spark):
    docs = spark.createDataFrame([(None, None), (1, "a b " * 9), (1, "c d e f g h i j k l m")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (7, 0)], "doc_id long, quality int")
    assert quality.train(docs, labels) is None
    out = quality.judge(docs.withColumn("n_words", F.lit(0)), None).collect()
    assert sorted((r["n_words"], r["kept"]) for r in out) == [(0, False), (11, True), (18, False)]
    assert quality.train(docs.limit(0), labels.limit(0)) is None
    assert quality.judge(docs.limit(0), None).count() == 0
    copies = spark.createDataFrame([(1, "a b"), (1, "a")] * 50 + [(2, "c")], "doc_id long, text string")
    few = quality.labelled(copies, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).collect()
    assert sorted(r["n_words"] for r in few) == [1, 1]  # one row an id
    both = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    two = spark.createDataFrame([(1, "a b c"), (2, "$ $ $")], "doc_id long, text string")
    assert quality.judge(two, quality.train(two, both)).count() == 2
