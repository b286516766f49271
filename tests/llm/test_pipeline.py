"""Every stage of the pipeline against plain Python on its own input, and the guard around it."""

import importlib
import sys

import corpus_pipeline
import plain
import public_tokenizers
import pytest
import test_contamination
import test_jaccard
import test_pieces

from pagemill.llm import contamination, pieces

EXTRA = [
    (10_000, None, "en", "s", 0), (10_001, "12 34 56", None, "s", 8), (None, "The and of the whole thing", "en", None, 26),
    (10_002, "Write to who.me@mail.example.com or +1 (269) 555-3296 of the thing", "en", "s", None),
]


@pytest.fixture(scope="module")
def small(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60 and n_chars < 4000")
    docs = docs.unionByName(spark.createDataFrame(EXTRA, docs.schema))
    copies = docs.filter("doc_id < 4").withColumn("doc_id", docs["doc_id"] + 500)
    docs.unionByName(copies).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("item_id < 12").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    states = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{small}/out-{i}"
        stage(spark, states[-1], small).write.parquet(path)
        states.append(spark.read.parquet(path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert states[-1].columns == docs.columns, name
    first, known, single, clean, masked, ids = [s.collect() for s in states]

    lettered = [r for r in first if r["text"] and any(c.isalpha() for c in r["text"])]
    assert sorted(map(key, known)) == sorted(map(key, lettered))

    groups = test_jaccard.brute([(r["doc_id"], r["text"]) for r in known])
    wanted = {c for _, n, c in groups if n and c != "None"}
    assert {str(r["doc_id"]) for r in single} - {"None"} == wanted
    assert len(single) == len({key(r) for r in single}) and any(r["doc_id"] is None for r in single)

    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]

    def leaks(text):
        for item in items:
            if len(set(plain.words(text, True)) & set(plain.words(item, True))) > 4:
                n, size = test_contamination.covered(text, item)
                if n >= contamination.COVERAGE * size:
                    return True
        return False

    assert sorted(map(key, clean)) == sorted(key(r) for r in single if not leaks(r["text"]))

    texts = {r["doc_id"]: r["text"] for r in clean}
    assert {r["doc_id"] for r in masked} == set(texts)
    for r in masked:
        text = texts[r["doc_id"]]
        for start, kind, end in sorted(plain.base_spans(text), reverse=True):
            text = text[:start] + f"[{plain.KINDS[kind].upper()}]" + text[end:]
        assert r["text"] == text and r["n_chars"] == len(text)

    words = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in masked}
    assert {r["doc_id"] for r in ids} == set(texts) and all(r["round_trip"] for r in ids)
    for r in ids[:3]:
        assert r["ids"] == test_pieces.viterbi(words, texts[r["doc_id"]])[1]


def key(row):
    return str(row["doc_id"]), row["text"]


def test_near_copies_of_five_words_and_0_8(spark, small, sf_dir, monkeypatch):
    three_words = test_jaccard.shingles
    monkeypatch.setattr(test_jaccard, "shingles", lambda text: three_words(text, 5))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = " ".join(f"w{i}" for i in range(100))
    edits = [f"{' '.join(f'{name}{i}' for i in range(n))} {body}" for name, n in (("a", 0), ("b", 9), ("c", 15), ("d", 40))]
    rows = [*test_jaccard.corpus(5, 120), *enumerate(edits, 1000)]
    wanted = {int(c) for _, n, c in test_jaccard.brute(rows, 80) if n}
    assert {1000, 1003} <= wanted and not {1001, 1002} & wanted
    made = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    kept = corpus_pipeline.one_of_near_copies(spark, made, small).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(wanted)

    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted = {int(c) for _, n, c in test_jaccard.brute(given, 80) if n}
    kept = corpus_pipeline.one_of_near_copies(spark, docs, small).filter("text rlike '[^ \\\\t\\\\r\\\\n]'").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(wanted)


def test_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def test_entry_does_without_the_text_operators(monkeypatch):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries()
    for name in ("corpus_pipeline", "pagemill.llm", "pagemill.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)
    bare = importlib.reload(entry)
    try:
        assert not any(n.startswith("op") or n == "pipeline" for n in bare.queries())
        assert "page_scan" in bare.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
