"""Scores against a plain Kneser-Ney model, base scores, and probabilities that sum to one."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import kneser_ney, queries


class Plain:
    def __init__(self, texts):
        self.count, self.pair = Counter(), Counter()
        for t in texts:
            words = [*plain.words(t, True), None]
            self.count.update(words)
            self.pair.update(zip(["<", *words], words))
        self.tokens, self.kinds = sum(self.count.values()), len(self.count)
        self.before, self.after, self.total = Counter(), defaultdict(Counter), Counter()
        for (h, w), c in self.pair.items():
            self.before[w] += 1
            self.after[h][min(c, 3)] += 1
            self.total[h] += c
        self.dw = self.discounts(Counter(self.before.values()))
        self.dp = self.discounts(Counter(self.pair.values()))

    @staticmethod
    def discounts(n):
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *[min(max(i - (i + 1) * y * n[i + 1] / n[i], 0), i) for i in (1, 2, 3)]]

    def lower(self, w):
        pairs = len(self.pair)
        if not pairs:
            return 1.0
        left = sum(self.dw[min(c, 3)] for c in self.before.values()) / pairs
        c = self.before[w]
        return (c - self.dw[min(c, 3)]) / pairs + left / (self.kinds + 1)

    def probability(self, h, w):
        if not self.total[h]:
            return self.lower(w)
        c = self.pair[h, w]
        left = sum(self.dp[i] * self.after[h][i] for i in (1, 2, 3)) / self.total[h]
        return (c - self.dp[min(c, 3)]) / self.total[h] + left * self.lower(w)

    def score(self, text):
        words = [*plain.words(text, True), None]
        base = sum(math.log10((self.count[w] + 0.1) / (self.tokens + 0.1 * (self.kinds + 1))) for w in words)
        full = sum(math.log10(self.probability(h, w)) for h, w in zip(["<", *words], words))
        return len(words), sum(self.count[w] > 0 for w in words), base, full


def compare(spark, train, test):
    docs = spark.createDataFrame([(t,) for t in train], "text string")
    rows = spark.createDataFrame(list(enumerate(test)), "doc_id long, text string").withColumn("score", F.lit(1))
    model = Plain(train)
    trained = kneser_ney.train(docs)
    assert (trained.tokens, trained.words, trained.pairs) == (model.tokens, model.kinds, len(model.pair))
    for r in kneser_ney.score(rows, trained).collect():
        n, known, base, full = model.score(test[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, model.tokens)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r["score"] == pytest.approx(full, rel=1e-9, abs=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-full / n))
    return model


def test_scores_match_plain_model(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)] + ["The", "the"]
    weights = 1 / np.arange(1, len(words) + 1)
    say = lambda n: " ".join(rng.choice(words, n, p=weights / weights.sum()))
    train = [say(rng.integers(0, 60)) for _ in range(150)] + [None, "", "hot pair " * 2000]
    test = [say(20), "new words here", "", None, "the THE\tthe\n", "hot pair hot", "w1 " * 4000]
    model = compare(spark, train, test)
    for h in ("<", "the", "w3", "never seen"):
        assert sum(model.probability(h, w) for w in [*model.count, "unseen"]) == pytest.approx(1)


def test_no_training_texts(spark):
    compare(spark, [], ["a b", None])
    compare(spark, ["one"], ["one", "two one"])


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    held = {i for i in docs if crc32(str(i).encode()) % 10 == 0}
    model = Plain([t for i, t in docs.items() if i not in held])
    out = {r["doc_id"]: r for r in queries.model_scores(spark, sf_dir).collect()}
    assert set(out) == set(docs)
    for i, r in out.items():
        n, known, base, full = model.score(docs[i])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, n, known, model.tokens)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(full, rel=1e-9)


def test_repeats_null_ids_and_empty(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    model = kneser_ney.train(rows)
    assert len({r["score"] for r in kneser_ney.score(rows, model).collect()}) == 1
    assert kneser_ney.score(rows.limit(0), model).count() == 0


def test_arrays_that_are_missing_fail_the_task(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b c a b"), (2, "never seen")], "doc_id long, text string")
    model = kneser_ney.train(rows.filter("doc_id = 1"))
    assert kneser_ney.score(rows, model).count() == 2
    with pytest.raises(Exception, match="FileNotFoundError"):
        kneser_ney.score(rows, model._replace(folder=str(tmp_path))).collect()
    reader = kneser_ney._Reader(model)
    for kind in ("words", "pairs"):
        assert model.parts[kind]
        for part in range(1 << model.bits):
            name = "words" if kind == "words" else "keys"
            assert (reader.array(kind, part, name) is not None) == (part in model.parts[kind])


def test_tokens_end_every_row():
    found, bounds = kneser_ney.tokens(pa.array(["a b", None, "", "A"]))
    assert bounds.tolist() == [0, 3, 4, 5, 7]
    assert (found[bounds[1:] - 1] == kneser_ney.END).all() and found[0] == found[5]
