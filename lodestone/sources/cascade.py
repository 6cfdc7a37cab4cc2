"""The web providers asked for a table of questions, in rounds.

A round makes a request table of the questions that are still open, gets the answers from a source
of pages and parses them; questions with sources leave by an anti-join, so the next provider sees
only the rest. Each round's pages are written before they are parsed: a request is sent once (again
only if its task is lost), each URL once for all questions that need it.

A source of pages takes requests (url) and gives (url, body, error), the body null on error. `live`
fetches, `recorded` looks the URLs up in a table.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as c
from ..functions import questions as q
from ..session import scratch_table
from . import web

Pages = Callable[[DataFrame], DataFrame]
_PAGE = "url string, body string, error string"

def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


_SOURCE = _texts("title", "url", "snippet")
_SOURCES = T.ArrayType(_SOURCE)


def live(get: web.Fetch = web.fetch, rate: float = 2.0, tasks: int = 4, attempts: int = 3) -> Pages:
    """Fetch pages: `rate` requests a second of all `tasks` together, each tried `attempts` times with doubled waits."""
    gap = tasks / rate

    def one(url: str) -> tuple:
        for k in range(attempts):
            time.sleep(gap * 2**k)
            try:
                return url, get(url), None
            except Exception as e:  # a page that can't be had is a row with its error
                error = str(e)
        return url, None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for url in frame["url"]:
                yield pd.DataFrame([one(url)], columns=["url", "body", "error"])

    return lambda requests: requests.select("url").distinct().repartition(tasks).mapInPandas(run, _PAGE)


def recorded(pages: DataFrame) -> Pages:
    """Pages of a table (url, body); other URLs can't be reached. Of several bodies of a URL the smallest counts."""
    known = pages.groupBy("url").agg(F.min("body").alias("body"))
    return lambda requests: requests.select("url").distinct().join(known, "url", "left").withColumn("error", F.when(F.col("body").isNull(), "unreachable"))


def _strings(make: Callable[..., str | None]):
    """A column of strings from columns of strings."""

    @F.pandas_udf(T.StringType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([make(x, y) for x, y in zip(a, b)], dtype=object)

    return run


def _parsed(body: str | None):
    try:
        return json.loads(body or "null")
    except ValueError:
        return None


def _titles(limit: int):
    @F.pandas_udf(T.ArrayType(_texts("title", "url", "text")))
    def run(host: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([[{"title": t, "url": u, "text": x} for t, u, x in web.found_titles(h, _parsed(b), limit)] for h, b in zip(host, body)], dtype=object)

    return run


_summary_url = _strings(web.summary_url)
_summary_text = _strings(lambda body, _: web.summary_text(_parsed(body)))
_query = _strings(lambda question, _: q.web_query(question or ""))


@F.pandas_udf(_SOURCE)
def _clean(title: pd.Series, url: pd.Series, snippet: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([web.clean_source(t or "", u or "", s or "") for t, u, s in zip(title, url, snippet)], columns=["title", "url", "snippet"])


@F.pandas_udf(T.StructType([T.StructField("answer", T.StringType()), T.StructField("sources", _SOURCES)]))
def _result(sources: pd.Series) -> pd.DataFrame:
    found = [web.found_result([dict(s) for s in row]) for row in sources]
    return pd.DataFrame([(r["answer"], r["sources"]) for r in found], columns=["answer", "sources"])


@F.pandas_udf(T.StringType())
def _failure(error: pd.Series) -> pd.Series:
    return error.map(lambda e: c.WEB_NOTHING if e is None else q.human_text(c.WEB_FAILED + q.human_text(e, simplify=True), simplify=True))


def _get(requests: DataFrame, pages: Pages) -> DataFrame:
    """`requests` (url and others) with body and error."""
    return requests.join(scratch_table(pages(requests), "web-pages"), "url")


def addresses(questions: DataFrame, limit: int = c.DEFAULT_LIMIT) -> DataFrame:
    """qid, the two hosts of the encyclopedia and the pages of all rounds, of `questions` (qid, question)."""
    rows = questions.select("qid", _query("question", "question").alias("query"))
    for k in (0, 1):
        rows = rows.withColumn(f"host{k}", _strings(lambda query, _, k=k: web.hosts(query)[k])("query", "query"))
        rows = rows.withColumn(f"titles{k}", _strings(lambda host, query: web.titles_url(host, query, limit))(f"host{k}", "query"))
    for name, provider in (("result_page", web.RESULT_PAGE), ("listing", web.LISTING)):
        rows = rows.withColumn(name, _strings(lambda query, _, provider=provider: web.page_url(provider, query))("query", "query"))
    return rows.drop("query")


def _by_titles(asked: DataFrame, turn: int, limit: int, pages: Pages) -> DataFrame:
    """(qid, sources, error): the encyclopedia's `turn`-th host, with summaries where a title has no text."""
    rows = asked.select("qid", F.col(f"host{turn}").alias("host"), F.col(f"titles{turn}").alias("url"))
    titles = _get(rows, pages).select("qid", "host", F.posexplode(_titles(limit)("host", "body")).alias("at", "t"))
    titles = scratch_table(titles.select("qid", "at", "t.*", F.when(F.col("t.text") == "", _summary_url("host", "t.title")).alias("summary")), "web-titles")
    wanted = titles.where("summary is not null").select(F.col("summary").alias("url")).distinct()
    texts = _get(wanted, pages).select(F.col("url").alias("summary"), _summary_text("body", "url").alias("extract"))
    whole = titles.join(texts, "summary", "left").withColumn("source", _clean("title", "url", F.coalesce("extract", "text")))
    each = whole.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "source"))).alias("s"))
    return each.select("qid", F.col("s.source").cast(_SOURCES).alias("sources"), F.lit(None).cast("string").alias("error"))


def _by_page(column: str, provider: tuple, limit: int, asked: DataFrame, pages: Pages) -> DataFrame:
    """(qid, sources, error): a provider that answers with one page."""
    parse = provider[1]

    @F.pandas_udf(_SOURCES)
    def links(body: pd.Series) -> pd.Series:
        return body.map(lambda b: parse(b or "")[:limit])

    return _get(asked.select("qid", F.col(column).alias("url")), pages).select("qid", links("body").alias("sources"), "error")


def search(questions: DataFrame, pages: Pages, limit: int = c.DEFAULT_LIMIT) -> DataFrame:
    """A row for each of `questions` (qid, question): qid, provider (null if none knew), answer, sources.

    The same as `web.web_search` for each. qids are unique and not null; a null question is an
    empty one; an empty table gives no rows.
    """
    asked = scratch_table(addresses(questions, limit), "web-questions")
    rounds: list[tuple[str, Callable[[DataFrame], DataFrame]]] = [
        ("encyclopedia", lambda rest: _by_titles(rest, 0, limit, pages)),
        ("encyclopedia, other language", lambda rest: _by_titles(rest, 1, limit, pages)),
        ("result page", lambda rest: _by_page("result_page", web.RESULT_PAGE, limit, rest, pages)),
        ("listing", lambda rest: _by_page("listing", web.LISTING, limit, rest, pages)),
    ]
    rest, answered, failures = asked, [], None
    for name, ask in rounds:
        got = scratch_table(ask(rest), "web-round")
        if name == "result page":
            failures = got.select("qid", "error")
        answered.append(got.where(F.size("sources") > 0).select("qid", F.lit(name).alias("provider"), _result("sources").alias("r")))
        rest = scratch_table(rest.join(answered[-1], "qid", "left_anti"), "web-open")
    nothing: Column = F.struct(_failure("error").alias("answer"), F.array().cast(_SOURCES).alias("sources"))
    found = rest.join(failures, "qid", "left").select("qid", F.lit(None).cast("string").alias("provider"), nothing.alias("r"))
    for part in answered:
        found = found.unionByName(part)
    return found.select("qid", "provider", "r.answer", "r.sources")
