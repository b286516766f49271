"""Flattening, column normalization, declared types, exports and reports."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagemill.operators import flatten, report, typed
from pagemill.operators.extract import extract, split_results
from pagemill.sinks import export as sinks

# workers cannot import test modules
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CASES = {
    "one list": ('{"n":1,"items":[{"a":1},{"a":2}]}', [{"a": 1}, {"a": 2}]),
    "list": ('[{"a":1},2,"x",null,[3]]', [{"a": 1}, {"value": 2}, {"value": "x"}, {"value": None}, {"value": [3]}]),
    "two lists": ('{"a":[1],"b":[2]}', [{"a": [1], "b": [2]}]),
    "no list": ('{"a":{"b":1}}', [{"a": {"b": 1}}]),
    "empty list": ("[]", []),
    "empty list inside": ('{"l":[]}', []),
    "empty object": ("{}", [{}]),
    "string": ('"s [1]"', [{"value": "s [1]"}]),
    "number": ("1.5", [{"value": 1.5}]),
    "null": ("null", [{"value": None}]),
    "broken": ('{"a":', []),
    "missing": (None, []),
}


@pytest.fixture
def results(spark):
    rows = [(k, i, d) for i, (k, (d, _)) in enumerate(CASES.items())]
    return spark.createDataFrame(rows, "source_url string, depth int, data string")


def by_url(rows, url="_source_url"):
    got = {k: [] for k in CASES}
    for r in rows.withColumn("json", F.to_json("item")).orderBy("item_pos").collect():
        got[r[url]].append(json.loads(r["json"]))
    return got


def test_flatten(results):
    assert by_url(flatten.flatten_results(results)) == {k: w for k, (_, w) in CASES.items()}


def test_api_rows_unwrap_no_further(results):
    got = by_url(flatten.api_rows(results, keep=["source_url"]), "source_url")
    assert got["one list"] == [{"n": 1, "items": [{"a": 1}, {"a": 2}]}]
    assert got["empty list inside"] == [{"l": []}]
    assert got["list"] == CASES["list"][1]
    assert got["string"] == CASES["string"][1]


def test_provenance_wins_and_comes_last(spark):
    df = spark.createDataFrame([('{"_source_url":"payload","b":1,"a":2}', "u", 3)], "data string, source_url string, depth int")
    flat = flatten.normalize_columns(flatten.flatten_results(df))
    assert flat.columns == ["a", "b", "_source_url", "_crawl_depth"]
    assert tuple(flat.first()) == (2, 1, "u", 3)


def test_provenance_defaults(spark):
    df = spark.createDataFrame([("[1]",)], "data string")
    row = flatten.flatten_results(df).first()
    assert (row["_source_url"], row["_crawl_depth"]) == ("", 0)


# shapes of book, quote and news listings
LISTINGS = [
    '[{"title":"A Light","price":51.77,"rating":3,"in_stock":true}]',
    '{"quotes":[{"quote":"q","author":{"name":"n","born":{"year":1900}},"tags":["x","y"]}]}',
    '[{"title":"News","points":10,"comments":2,"url":"http://n","price":7}]',
    '{"mixed":1,"note":"a"}',
    '{"mixed":"s","it\'s":"quoted"}',
]


def test_normalize_columns(spark):
    df = spark.createDataFrame([(d,) for d in LISTINGS], "data string")
    flat = flatten.normalize_columns(flatten.preview_rows(df))
    kinds = dict(flat.dtypes)
    assert kinds == {
        "author.born.year": "bigint", "author.name": "string", "comments": "bigint", "in_stock": "boolean",
        "it's": "string", "mixed": "string", "note": "string", "points": "bigint", "price": "double",
        "quote": "string", "rating": "bigint", "tags": "array<string>", "title": "string", "url": "string",
    }
    rows = [r.asDict() for r in flat.collect()]
    assert sorted(r["mixed"] for r in rows if r["mixed"]) == ["1", "s"]
    assert sorted(r["price"] for r in rows if r["price"]) == [7.0, 51.77]
    assert [r["tags"] for r in rows if r["tags"]] == [["x", "y"]]
    assert [r["author.born.year"] for r in rows if r["author.born.year"]] == [1900]


def test_nothing_to_normalize(spark):
    df = spark.createDataFrame([("[]", "u", 0)], "data string, source_url string, depth int")
    flat = flatten.normalize_columns(flatten.flatten_results(df))
    assert flat.columns == ["_source_url", "_crawl_depth"] and flat.count() == 0


FIELD_MAP = '{"title": "str", "price": "float", "in_stock": "bool", "rating": "int"}'
JSON_SCHEMA = """{"type": "array", "items": {"type": "object", "properties": {
    "title": {"type": "string"}, "type": {"type": ["string", "null"]},
    "author": {"type": "object", "properties": {"name": {"type": "string"}}},
    "tags": {"type": "array", "items": {"type": "string"}}}}}"""


def test_schema_kinds(tmp_path):
    (tmp_path / "s.json").write_text(FIELD_MAP)
    assert typed.load_schema(str(tmp_path / "s.json")) == json.loads(FIELD_MAP)
    assert typed.load_schema("") is None and typed.load_schema("{broken") is None
    assert typed.to_struct(json.loads(FIELD_MAP)).simpleString() == (
        "struct<title:string,price:double,in_stock:boolean,rating:bigint>"
    )
    assert typed.to_struct(json.loads(JSON_SCHEMA)).simpleString() == (
        "struct<title:string,type:string,author:struct<name:string>,tags:array<string>>"
    )
    # a field that happens to be called "type" is still a field map
    assert typed.to_struct({"type": "str", "name": "str"}).names == ["type", "name"]
    assert typed.to_struct({"type": "object", "properties": {}}).names == []
    assert typed.load_schema("[1, 2]") is None
    assert "- price (number)" in typed.prompt_suffix(json.loads(FIELD_MAP))
    assert "- author ({name: text})" in typed.prompt_suffix(json.loads(JSON_SCHEMA))
    assert "- tags (list of text)" in typed.prompt_suffix(json.loads(JSON_SCHEMA))


def test_keys_that_clash_stay_apart(spark):
    data = '[{"Price":1,"a":{"b":1},"a.b":2},{"price":2,"big":12345678901234567890}]'
    rows = flatten.flatten_results(spark.createDataFrame([(data,)], "data string"), provenance=False)
    out = flatten.normalize_columns(rows)
    assert out.columns == ["Price", "a.b", "a.b_2", "big", "price_2"]
    got = [tuple(None if v is None else int(v) for v in r) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 2, None, None), (None, None, None, 12345678901234567890, 2)], key=str)


def test_typed_columns(spark):
    data = '[{"title":"A","price":"9.5","in_stock":true,"rating":3},{"title":"B","price":"cheap","rating":null},{}]'
    rows = flatten.flatten_results(spark.createDataFrame([(data, "u", 0)], "data string, source_url string, depth int"))
    out = typed.typed_columns(rows, typed.to_struct(json.loads(FIELD_MAP))).orderBy("item_pos").collect()
    assert [(r["title"], r["price"], r["in_stock"], r["rating"], r["_corrupt"] is not None) for r in out] == [
        ("A", 9.5, True, 3, False), ("B", None, None, None, True), (None, None, None, None, False),
    ]


def flaky():
    calls = {}

    def run(source, url, prompt):
        calls[url] = calls.get(url, 0) + 1
        if url == "never" or (url == "second" and calls[url] == 1):
            raise RuntimeError("busy")
        if url == "none":
            return None
        return {"url": url, "chars": len(source), "prompt": prompt, "text": "é"}

    return run


def test_extract(spark):
    pages = spark.createDataFrame(
        [("first", 0, "é" * 30_000), ("second", 1, "x"), ("never", 0, "x"), ("none", 0, "x"), ("blank", 2, " \n"), ("null", 0, None)],
        "url string, depth int, markdown string",
    )
    done = extract(pages, flaky, "ask", provider="groq", parallelism=3).cache()
    rows = {r["source_url"]: r for r in done.collect()}
    # longer than the provider's window: asked for in two windows, nothing is cut away
    first = [{"url": "first", "chars": n, "prompt": "ask", "text": "é"} for n in (24_000, 6_000)]
    assert json.loads(rows["first"]["data"]) == first
    assert [rows[u]["windows"] for u in ("first", "second", "blank")] == [2, 1, 0]
    whole = extract(pages.where("url = 'first'"), flaky, "ask").first()
    assert json.loads(whole["data"])["chars"] == 30_000 and whole["windows"] == 1
    assert [rows[u]["attempts"] for u in ("first", "second", "never", "none", "blank", "null")] == [1, 2, 2, 1, 0, 0]
    assert rows["never"]["data"] is None and "busy" in rows["never"]["error"]
    good, bad = split_results(done)
    assert {r["source_url"] for r in good.collect()} == {"first", "second"}
    assert {r["source_url"] for r in bad.collect()} == {"never", "none", "blank", "null"}


def odd_values():
    return lambda source, url, prompt: {"nan": float("nan"), "inf": [float("inf")], "cut": "a\ud800", "NaN": "NaN"}


def test_odd_values_stay_json(spark):
    pages = spark.createDataFrame([("u", 0, "x")], "url string, depth int, markdown string")
    data = extract(pages, odd_values, "p").first()["data"]
    assert json.loads(data) == {"nan": None, "inf": [None], "cut": "a?", "NaN": "NaN"}
    rows = flatten.flatten_results(spark.createDataFrame([(data,)], "data string"))
    assert rows.count() == 1


def test_repeated_keys_keep_the_last(spark):
    df = spark.createDataFrame([('{"a":1,"a":2}',)], "data string")
    assert [r["a"] for r in flatten.normalize_columns(flatten.flatten_results(df)).collect()] == [2]


def test_empty_results_are_results(spark):
    df = spark.createDataFrame([("{}",), ("[]",), ("null",), (None,), ("0",)], "data string")
    good, bad = split_results(df)
    assert (good.count(), bad.count()) == (3, 2)


# ---- exports -------------------------------------------------------------------------


@pytest.fixture
def table(spark):
    df = spark.createDataFrame(
        [(1, "é | \"q\"", [1, 2], 1.5), (2, "two\nlines", None, None), (3, "", [], 0.0)],
        "id int, text string, tags array<int>, price double",
    )
    return df.withColumn("a.b", F.col("id") * 2)


@pytest.mark.parametrize("fmt", sinks.FORMATS)
def test_export_writes_every_format(spark, table, tmp_path, fmt):
    path = sinks.export(table, f" {fmt.upper()} ", str(tmp_path / fmt))
    assert path == "scraped_data" if fmt == "sql" else path.startswith(str(tmp_path))
    if fmt == "sql":
        assert spark.table("scraped_data").count() == 3
        spark.sql("drop table scraped_data")


def test_export_again_replaces(spark, table, tmp_path):
    sinks.export(table, "json", str(tmp_path))
    path = sinks.export(table.limit(1), "json", str(tmp_path))
    assert spark.read.json(path).count() == 1


def test_unknown_format(table):
    with pytest.raises(ValueError, match="json, csv, xml, sql, markdown"):
        sinks.export(table, "parquet?")


def test_json_keeps_nulls_and_text(table, tmp_path):
    path = sinks.write_json(table.coalesce(1), str(tmp_path / "j"))
    lines = [json.loads(l) for f in sorted((tmp_path / "j").glob("part*")) for l in f.read_text().splitlines()]
    assert lines[1] == {"id": 2, "text": "two\nlines", "tags": None, "price": None, "a.b": 4}
    assert "é" in "".join(f.read_text() for f in (tmp_path / "j").glob("part*")) and path


def test_markdown_is_one_table_over_many_parts(table, tmp_path):
    sinks.write_markdown(table.repartition(3), str(tmp_path / "m"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "m").glob("part*")))
    lines = text.splitlines()
    assert lines[:2] == ["| id | text | tags | price | a.b |", "| --- | --- | --- | --- | --- |"]
    assert sorted(lines[2:]) == [
        '| 1 | é \\| "q" | [1,2] | 1.5 | 2 |', "| 2 | two lines |  |  | 4 |", "| 3 |  | [] | 0.0 | 6 |",
    ]


def test_xml_names():
    assert [sinks.xml_name(n) for n in ("a.b", "a b", "1st", "ü-x")] == ["a.b", "a_b", "_1st", "_ü-x"]


def test_empty_export_is_marked(spark, table, tmp_path):
    path = sinks.export(table.where("id < 0"), "json", str(tmp_path))
    assert [r.asDict() for r in spark.read.json(path).collect()] == [{"_empty": True}]


def test_summary(spark, tmp_path):
    log = spark.createDataFrame(
        [("a", "ok"), ("b", "ok"), ("c", "fetch_failed"), ("d", "extract_failed"), ("e", "robots_blocked")],
        "url string, status string",
    )
    counters = report.run_counters(log, 1.26, "out")
    assert tuple(counters.first()) == (2, 2, 1.26, "out")
    path = sinks.write_summary(report.summary_lines(counters), str(tmp_path))
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert lines[:4] == ["Pages crawled:  2", "Pages failed:   2", "Time:           1.3s", "Output:         out"]
    assert lines[4].startswith("Timestamp:      20")
    assert [r["url"] for r in report.first_failures(log, "url").collect()] == ["c", "d"]


def test_preview(spark):
    rows = spark.range(20).select(
        "id", *[F.lit(str(i) * 60).alias(f"c{i}") for i in range(8)], F.array("id").alias("list")
    )
    shown = report.preview(rows, "id")
    assert shown.columns == ["id", "c0", "c1", "c2", "c3", "c4", "c5"]
    assert [r["id"] for r in shown.collect()] == list(range(8))
    assert shown.first()["c0"] == "0" * 50
    assert report.rows_not_shown(rows).first()[0] == 12


def test_kinds_of_every_path_settle_on_one_type(spark):
    texts = [
        '{"a":1,"b":1.5,"c":null,"d":[],"e":{},"f":[{"x":1},{"y":"s"}],"g":[1,2.5],"h":true,"i":12345678901234567890}',
        '{"a":2,"b":2,"c":null,"d":[[1],["s"]],"e":{},"f":[{"X":1}],"g":[null],"h":1,"i":1,"j":1e300,"k":{"l":{"m":[]}}}',
        '{"j":1,"k":{"l":3}}', "[]", "7",
    ]
    rows = flatten.flatten_results(spark.createDataFrame([(t,) for t in texts], "data string"), provenance=False)
    assert dict(flatten.discovered_keys(rows)) == {
        "a": "bigint", "b": "double", "c": "string", "d": "array<array<string>>", "e": "string", "f": "array<string>",
        "g": "array<double>", "h": "string", "i": "decimal(38,0)", "j": "double", "k.l": "string", "value": "bigint",
    }
    out = {r["a"]: r for r in flatten.normalize_columns(rows).collect()}
    assert out[1]["f"] == ['{"x":1}', '{"y":"s"}'] and out[2]["h"] == "1" and out[1]["h"] == "true"
    assert out[2]["k.l"] == '{"m":[]}' and out[1]["e"] == "{}" and out[1]["i"] == 12345678901234567890


def test_too_many_keys_raise(spark):
    wide = spark.range(50).select(F.concat(F.lit('{"k'), "id", F.lit('":1}')).alias("data"))
    rows = flatten.flatten_results(wide, provenance=False)
    assert len(flatten.infer_item_schema(rows, max_keys=50).fields) == 50
    with pytest.raises(ValueError, match="more than 49 keys"):
        flatten.infer_item_schema(rows, max_keys=49)


def test_key_discovery_leaves_the_session_alone(spark):
    before = spark.conf.get("spark.sql.caseSensitive")
    rows = flatten.flatten_results(spark.createDataFrame([('{"A":1,"a":"x"}',)], "data string"), provenance=False)
    seen = flatten.normalize_columns(rows)
    assert [tuple(r) for r in seen.collect()] == [(1, "x")] and seen.columns == ["A", "a_2"]
    assert spark.conf.get("spark.sql.caseSensitive") == before


def test_calls_overlap_up_to_the_bound_and_keep_their_order(spark, tmp_path):
    """Every call notes how many are in flight with it; four may be, and are."""
    log = str(tmp_path / "calls")

    def slow():
        import threading
        import time

        lock, live = threading.Lock(), [0]

        def run(source, url, prompt):
            with lock:
                live[0] += 1
                with open(log, "a") as out:
                    out.write(f"{live[0]}\n")
            time.sleep(0.05 + 0.01 * (int(url) % 3))
            with lock:
                live[0] -= 1
            return {"url": url, "text": source}

        return run

    pages = spark.range(12).select(
        F.col("id").cast("string").alias("url"), F.lit(0).alias("depth"),
        F.when(F.col("id") != 5, F.repeat(F.concat(F.lit("p"), "id"), 4)).alias("markdown"),
    ).coalesce(1)
    rows = extract(pages, slow, "p", max_chars=6, concurrency=4).collect()
    seen = [int(x) for x in open(log)]
    assert max(seen) == 4 and len(seen) == 22
    assert [r["source_url"] for r in rows] == [str(i) for i in range(12)] and rows[5]["error"] == "blank page"
    for r in rows:
        if r["data"]:
            assert "".join(x["text"] for x in json.loads(r["data"])) == f"p{r['source_url']}" * 4
    alone = extract(pages, slow, "p", max_chars=6).collect()
    assert [tuple(r) for r in alone] == [tuple(r) for r in rows]


def test_batches_of_windows_and_their_failures(spark):
    def batches():
        def run(sources, urls, prompt):
            if len(sources) > 1 and "bad" in sources:
                raise RuntimeError("one is bad")
            if sources == ["bad"]:
                raise ValueError("bad alone")
            return [{"n": len(sources), "s": s} for s in sources]

        return run

    texts = ["a", "b", "c", "bad", "d", "e", "f"]
    pages = spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(texts)], "url string, depth int, markdown string").coalesce(1)
    rows = extract(pages, batches, "p", batch_size=3, concurrency=2).collect()
    assert [json.loads(r["data"]) if r["data"] else r["error"] for r in rows] == [
        {"n": 3, "s": "a"}, {"n": 3, "s": "b"}, {"n": 3, "s": "c"}, "ValueError: bad alone",
        {"n": 1, "s": "d"}, {"n": 1, "s": "e"}, {"n": 1, "s": "f"},
    ]
    assert [r["attempts"] for r in rows] == [1, 1, 1, 2, 1, 1, 1]


def test_keys_are_looked_for_in_one_item_of_each_shape(spark, monkeypatch):
    plain = ['{"a":1,"o":{"b":"x"}}', '{"a":2,"o":{"b":"y","c":null}}', '{"l":[1,null]}', '{"l":[]}']
    merged = [
        '{"m":[1,"x"]}', '{"m":[0.5,{"k":1}]}', '{"m":[{"k":[true]},{"j":2}]}', '{"d":[1,12345678901234567890]}',
        '{"d":[12345678901234567890]}', '{"e":[1,2.5e3]}', '{"e":[1e3]}', '{"ARRAY<":{"DOUBLE":true}}',
    ]
    texts = [(t,) for t in plain * 50 + merged]
    rows = spark.createDataFrame(texts, "t string").select(F.parse_json("t").alias("item")).repartition(3)
    few = flatten._one_of_each_shape(rows, "item")
    assert len(plain) <= few.count() <= len(plain) + len(merged)
    found = flatten._kinds(rows, "item", 100)
    assert found[(".m", "[]", ".k")] == {"BIGINT", "ARRAY"} and (".ARRAY<", ".DOUBLE") in found
    monkeypatch.setattr(flatten, "_one_of_each_shape", lambda rows, item: rows.select(F.col(item).alias("value")))
    assert found == flatten._kinds(rows, "item", 100)
