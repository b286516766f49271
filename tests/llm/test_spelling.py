"""Spelling variants against plain Python."""

import random
import re
from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F

from pagemill.llm import queries, spelling


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def plain_variants(counts):
    """By deletion neighbourhoods, which is another method: near words share a word with one letter less."""
    near = {w: set() for w in counts}
    holes = {}
    for w in counts:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]])
    return out


def got(words):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(words).collect()}


def test_query_matches_plain(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf_dir, "documents").collect()]
    out = queries.spelling_variants(spark, sf_dir)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = out.collect()
    want = plain_variants(plain_words(rows))
    assert len(found) == len(want)
    assert {r["word"]: tuple(r)[1:] for r in found} == want
    assert any(r["form"] for r in found)


def test_every_kind_of_edit_and_long_chains(spark):
    random.seed(4)
    counts = {}
    for _ in range(60):  # crowded: few letters, so most words are near others
        w = "".join(random.choice("abé") for _ in range(random.randint(5, 8)))
        counts[w] = random.choice([3, 4, 6, 12, 50, 100])
    for _ in range(200):
        w = list(random.choice(list(counts)))
        at = random.randrange(len(w))
        random.choice([lambda: w.insert(at, "c"), lambda: w.pop(at), lambda: w.__setitem__(at, "d")])()
        if len(w) >= 5:
            counts.setdefault("".join(w), random.choice([3, 7, 30]))
    chain = "abcdefghijkl"
    for i in range(20):  # each twice as frequent as the one before
        counts["zz" + chain[: 5 + i % 3] + "y" * (i // 3) + "x" * (i % 3)] = 3 << i
    for i in range(12):
        counts["qqqqq" + "w" * i] = 3 << i
    counts["l" * 5000] = 9
    counts["l" * 5001] = 90
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("form", F.lit("x"))
    assert got(rows) == plain_variants(counts)


def test_one_very_frequent_word_with_many_variants(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    counts = {"frequent": 1_000_000}
    for i in range(9):
        for c in letters:
            counts.setdefault("frequent"[:i] + c + "frequent"[i:], 3)
            if i < 8:
                counts.setdefault("frequent"[:i] + c + "frequent"[i + 1 :], 5)
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = got(rows)
    assert found == plain_variants(counts) and sum(r == "frequent" for _, r, *_ in found.values()) == len(counts)


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    counts = {a + b + c + "word": 3 + 4 * (a == b) for a in "abcd" for b in "abcd" for c in "efgh"}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    plans = []

    def recorded(df, path, write=spelling.write_table):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, path)

    monkeypatch.setattr(spelling, "write_table", recorded)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")  # far above these tables
    try:
        out = spelling.variants(words)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        rows = out.collect()
        plans.append(out._jdf.queryExecution().executedPlan().toString())  # as it was run
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == plain_variants(counts)
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_noise_nulls_repeats_and_odd_letters(spark):
    rows = [(i, "Straße straße STRAßE Ähnlich ähnlich É×÷ÿabc tiny") for i in range(400)]
    rows += [(None, "Nameless words here"), (None, "Nameless words here"), (7, None), (8, ""), (9, "Nameless" + "x" * 3000)]
    rows += [(1, "İstanbul Ⅷabcde ſabcde")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit(1)).withColumn("id", F.lit("a"))
    counted = {r["word"]: r["n"] for r in spelling.frequent_words(spelling.noisy_words(docs)).collect()}
    assert counted == plain_words(rows)
    assert {"straße", "Ähnlich", "ähnlich"} <= set(counted)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.frequent_words(spelling.noisy_words(docs))).count() == 0
