"""Structured extraction as a distributed batch-inference job.

The model is the user's: a picklable factory builds one callable per task, and Spark
decides where the pages go.  Only the columns the model needs cross to Python.  A text longer
than the context window that is asked for goes to the model in consecutive windows.  A task
may have several calls in flight, and a call may carry several windows; answers keep the order
of the pages, and no more windows are held than calls in flight can take.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.markup import context_chars, is_blank, windows

# (source text, url, prompt) -> JSON-like result
Model = Callable[[str, str, str], Any]

# several source texts, their urls, prompt -> as many results
BatchModel = Callable[[list[str], list[str], str], list[Any]]

# Fixed value: tries per page.
ATTEMPTS = 2
RESULT_SCHEMA = "source_url string, depth int, data string, error string, attempts int, windows int"


def _json_text(result: Any) -> str:
    """JSON that every parser takes: no NaN, no lone surrogates."""
    text = json.dumps(result, ensure_ascii=False, default=str)
    if "NaN" in text or "Infinity" in text:
        text = json.dumps(json.loads(text, parse_constant=lambda _: None), ensure_ascii=False)
    return text.encode("utf-8", "replace").decode("utf-8")


def _joined(answers: list[str]) -> str | None:
    """One answer for all windows: a single one as it is, else the items of all in order."""
    if len(answers) < 2:
        return answers[0] if answers else None
    items: list[Any] = []
    for answer in map(json.loads, answers):
        lists = [v for v in answer.values() if isinstance(v, list)] if isinstance(answer, dict) else []
        items += answer if isinstance(answer, list) else lists[0] if len(lists) == 1 else [answer]
    return _json_text(items)


# data, error, tries
Answer = tuple[str | None, str | None, int]


def _run(model: Model, source: str, url: str, prompt: str, attempts: int) -> Answer:
    error = None
    for attempt in range(1, attempts + 1):
        try:
            result = model(source, url, prompt)
            return None if result is None else _json_text(result), None, attempt
        except Exception as problem:  # any failure of the user's model is a failed page
            error = f"{type(problem).__name__}: {problem}"
    return None, error, attempts


def _run_batch(model: BatchModel, asked: list[tuple[str, str]], prompt: str, attempts: int) -> list[Answer]:
    """Ask for all at once; what fails together is asked for one by one."""
    try:
        results = model([source for source, _ in asked], [url for _, url in asked], prompt)
        if len(results) == len(asked):
            return [(None if r is None else _json_text(r), None, 1) for r in results]
    except Exception:  # the single calls below say what was wrong
        pass

    def single(source: str, url: str, text: str) -> Any:
        (result,) = model([source], [url], text)
        return result

    return [_run(single, source, url, prompt, attempts) for source, url in asked]


def _in_order(calls: Iterable[Callable[[], Any]], limit: int) -> Iterator[Any]:
    """Results of calls, in their order, at most ``limit`` of them begun and not yet taken."""
    if limit <= 1:
        for call in calls:
            yield call()
        return
    with ThreadPoolExecutor(limit) as pool:
        begun: deque = deque()
        for call in calls:
            if len(begun) == limit:
                yield begun.popleft().result()
            begun.append(pool.submit(call))
        while begun:
            yield begun.popleft().result()


def _page(url: str, depth: int, found: list[Answer]) -> tuple:
    """One row for the windows of a page; one that fails fails the page, so nothing is lost unseen."""
    most = max(tries for _, _, tries in found)
    error = next((e for _, e, _ in found if e is not None), None)
    data = None if error is not None else _joined([d for d, _, _ in found if d is not None])
    return url, depth, data, error, most, len(found)


def extract(
    pages: DataFrame,
    model_factory: Callable[[], Model],
    prompt: str,
    *,
    provider: str | None = None,
    max_chars: int | None = None,
    attempts: int = ATTEMPTS,
    parallelism: int | None = None,
    concurrency: int = 1,
    batch_size: int | None = None,
) -> DataFrame:
    """``(source_url, depth, data, error, attempts, windows)`` from ``(url, depth, markdown)``.

    ``data`` is JSON text, or null when the page is blank or every attempt failed.  With a
    ``provider`` or ``max_chars`` the model sees windows of at most that many characters, and
    the items of all windows are joined in order; without, it sees the whole text.  Model
    calls are slow, so ``parallelism`` may spread few pages over more tasks, and with
    ``concurrency`` a task has that many calls in flight (the model must bear to be called from
    threads).  With ``batch_size`` the factory builds a ``BatchModel``, which is called with up to
    that many windows.  The result should be written before it is used twice, or the model is
    asked twice.
    """
    size = None if provider is None and max_chars is None else context_chars(provider, max_chars)
    source = F.when(~is_blank(F.col("markdown")), windows(F.col("markdown"), size))
    slim = pages.select("url", F.col("depth").cast("int").alias("depth"), source.alias("source"))
    if parallelism is not None:
        slim = slim.repartition(parallelism)

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            texts = [None if parts is None else list(parts) for parts in batch["source"]]
            asked = [(part, url) for url, parts in zip(batch["url"], texts) for part in parts or ()]
            if asked:
                model = model or model_factory()
            if batch_size is None:
                calls = (lambda one=one: [_run(model, *one, prompt, attempts)] for one in asked)
            else:
                groups = (asked[k : k + batch_size] for k in range(0, len(asked), batch_size))
                calls = (lambda some=some: _run_batch(model, some, prompt, attempts) for some in groups)
            answers = (answer for group in _in_order(calls, concurrency) for answer in group)
            out = []
            for url, depth, parts in zip(batch["url"], batch["depth"], texts):
                if parts is None:
                    out.append((url, depth, None, "blank page", 0, 0))
                else:
                    out.append(_page(url, depth, [next(answers) for _ in parts]))
            next(answers, None)  # ends the calls
            yield pd.DataFrame(out, columns=["source_url", "depth", "data", "error", "attempts", "windows"])

    return slim.mapInPandas(infer, RESULT_SCHEMA)


def split_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with a result, and failed ones; empty lists and objects are results."""
    no_result = F.col("data").isNull() | (F.trim("data") == "null")
    return results.where(~no_result), results.where(no_result)
