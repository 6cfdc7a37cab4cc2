"""Web providers for a table of questions, against the ones for a single question."""

from __future__ import annotations

import json

from lodestone.functions import questions as q
from lodestone.sources import cascade, web

PAGE = '<a class="result__a" href="http://a.b/{0}">Title {0}</a><a class="result__snippet">about {0}</a>' * 2
LISTED = "1. ## [Listed {0}](http://l.m/{0})\n\nsome text of {0}\n"


def _pages():
    """Recorded answers: each question is known to other providers."""
    out = {}
    for k, question in QUESTIONS.items():
        asked = q.web_query(question or "")
        own, other = web.hosts(asked)
        if k in (1, 2):
            host = own if k == 1 else other
            out[web.titles_url(host, asked, 5)] = json.dumps([asked, ["One", "Two & 2", "Three"], ["said", "", ""], ["http://one"]])
            out[web.summary_url(host, "Two & 2")] = json.dumps({"extract": "a summary " * 100})
            out[web.summary_url(host, "Three")] = "not json"
        if k in (1, 3, 7):
            out[web.page_url(web.RESULT_PAGE, asked)] = PAGE.format(k)
        if k == 4:
            out[web.page_url(web.RESULT_PAGE, asked)] = "<p>nothing"
        if k in (4, 5):
            out[web.page_url(web.LISTING, asked)] = LISTED.format(k)
        if k == 6:
            out[web.page_url(web.RESULT_PAGE, asked)] = "<html>"
    return out


QUESTIONS = {1: "what are tides?", 2: "什么是潮汐", 3: "rivers and deltas", 4: "火山灰 ash", 5: "volcano", 6: "nobody knows", 7: "rivers and deltas ", 8: "unreachable", 9: None}


def test_rounds_answer_as_single_questions_do(spark):
    pages = _pages()

    def get(url):
        if url not in pages:
            raise OSError("unreachable")
        return pages[url]

    table = spark.createDataFrame(list(pages.items()), "url string, body string")
    asked = spark.createDataFrame(list(QUESTIONS.items()), "qid long, question string")
    found = {r.qid: r for r in cascade.search(asked, cascade.recorded(table)).collect()}
    assert len(found) == len(QUESTIONS)
    for k, question in QUESTIONS.items():
        want = web.web_search(question or "", get=get)
        assert found[k].answer == want["answer"], k
        assert [s.asDict() for s in found[k].sources] == want["sources"], k
    assert [found[k].provider for k in range(1, 9)] == ["encyclopedia", "encyclopedia, other language", "result page", "listing", "listing", None, "result page", None]
    assert cascade.search(asked.limit(0), cascade.recorded(table)).count() == 0


def test_live_pages_are_tried_again(spark, tmp_path):
    folder = str(tmp_path)

    def get(url):
        import os

        mark = os.path.join(folder, url)
        tries = len(open(mark).read()) if os.path.exists(mark) else 0
        with open(mark, "a") as f:
            f.write("x")
        if url == "never" or tries < 1:
            raise OSError("busy")
        return f"body of {url}"

    requests = spark.createDataFrame([("a",), ("a",), ("never",)], "url string")
    got = sorted(tuple(r) for r in cascade.live(get, rate=200, tasks=2, attempts=3)(requests).collect())
    assert got == [("a", "body of a", None), ("never", None, "busy")]
    assert len((tmp_path / "a").read_text()) == 2 and len((tmp_path / "never").read_text()) == 3
