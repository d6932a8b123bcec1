"""Work that a page's postings take: addresses that need no joining, payloads that are parsed once."""

import pytest

from jobloom.functions import html
from jobloom.plans import registry

HREFS = ("/jobs/1", "/jobs/12/", "https://a.com/jobs/1", "https://A.com/jobs/1", "http://b.com/jobs/2", "jobs/3", "../jobs/4", "/jobs/./5", "/jobs/../x", "//b.com/jobs/1", "/jobs//6", "?x", "#y", "mailto:a@b",
         "https://a.com", "https://a.com:443/jobs/1", "/careers/", "/positions/a;b", "/jobs/1?x=1", " /jobs/9 ", "https://a..com/jobs/1", "/jobs/a\n", "/jobs/%41", "/jobs/é")
PAGES = ("https://a.com/careers", "https://a.com:443/careers", "HTTPS://A.com/careers/x/", "http://a.com", "http://a.com?x/y", "mailto:x", "http://[", "", "file:///x/jobs/", "https://u@a.com/x", "https:///x", "a.com/x", "https://a.com/x\n")


@pytest.mark.parametrize("page", PAGES)
def test_plain_addresses_are_those_of_joining(page):
    assert [html.absolute(h, page) for h in HREFS] == [html._absolute(h, page) for h in HREFS]


def test_plain_links_are_told_without_joining(monkeypatch):
    monkeypatch.setattr(html, "urljoin", None)
    page = '<ul><li><a href="/jobs/7"><h4>Applied Scientist</h4></a><span>Remote</span></li>\n<li><a href="https://b.com/jobs/1">Engineer elsewhere</a></li></ul>'
    assert [(j["title"], j["location"], j["apply_url"]) for j in html.custom_jobs(page, "https://a.com/careers")] == [("Applied Scientist", "Remote", "https://a.com/jobs/7")]


def test_places_in_the_source():
    page = "<p>a\nb</p>\n<article>\nx <b>y</b>\n</article>\n<br>z &am"
    assert html.main_content(page) == "\nx <b>y</b>\n"
    assert [page[n.start : n.end] for n in html.parse(page).all("b", "br")] == ["<b>y</b>", "<br>"]


def test_board_payloads_are_parsed_once(spark, small):
    plan = registry.queries()["described_board_jobs"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 3
