"""Page parsing, connectors and the probe."""

import json

from pyspark.sql import functions as F

from jobloom.functions import html
from jobloom.operators import ingest, probe
from jobloom.sources import payloads

URL = "https://a.com/careers"


def test_main_content():
    assert html.main_content("<body><nav>n</nav><article class=x>A<b>b</b></article></body>") == "A<b>b</b>"
    assert html.main_content("<body><main>M</main></body>") == "M"
    assert html.main_content("<div><h1>T</h1><p>x</p><p>y</p></div>") == "<h1>T</h1>\n<p>x</p>\n<p>y</p>"
    assert html.main_content("<body>B<h1>only</h1></body>") == "B<h1>only</h1>" and html.main_content("plain") == "plain"


def test_links():
    found = html.links('<a href="/x">X</a><a href="https://b.com/y#z"> Y </a><a href="/x">again</a><a href="mailto:a@b.c">m</a><a>n</a>', URL)
    assert [(x["pos"], x["url"], x["text"], x["same_origin"]) for x in found] == [(0, "https://a.com/x", "X", True), (1, "https://b.com/y#z", "Y", False)]
    told = html.links('<a href="/jobs">J</a><a href="/about">Open roles</a><a href="https://jobs.b.com">B</a><a href="/x">X</a>', URL)
    assert html.career_links(told) == ["https://a.com/jobs", "https://a.com/about", "https://jobs.b.com/"]


def test_custom_page_ladder():
    node = {"@graph": [{"@type": ["Thing", "JobPosting"], "title": " ML  Engineer ", "url": "/j/1", "jobLocation": [{"address": {"addressLocality": "Paris", "addressCountry": {"name": "France"}}}]},
                       {"@type": "Person"}, {"@type": "jobposting", "title": "Apply"}]}
    page = f'<script type="application/ld+json">{json.dumps(node)}</script><script type="application/ld+json">broken</script>'
    jobs = html.custom_jobs(page, URL)
    assert [(j["title"], j["apply_url"], j["location"]) for j in jobs] == [("ML Engineer", "https://a.com/j/1", "Paris, France")]
    linked = '<div><a href="/jobs/1"><h3>Machine Learning Engineer</h3></a><span>Remote</span></div><div><a href="https://b.com/jobs/2">Machine Learning Chef</a></div><a href="/careers/">Careers page of us</a>'
    jobs = html.custom_jobs(linked, URL)
    assert [(j["title"], j["apply_url"], j["location"]) for j in jobs] == [("Machine Learning Engineer", "https://a.com/jobs/1", "Remote")]
    paired = "<section><div><h2>Designer</h2></div><div><a href='/positions/9'>Go</a></div></section><section><div><h2>Footer</h2></div></section>"
    assert [(j["title"], j["apply_url"]) for j in html.custom_jobs(paired, URL)] == [("Designer", "https://a.com/positions/9")]
    many = "".join(f'<p><a href="/jobs/{i}">Engineer number {i} of many</a></p>' for i in range(51))
    assert html.custom_jobs(many, URL) == [] and html.custom_jobs("<a href='/about'>About our company</a>", URL) == []


def test_block_maps():
    row = {"value": {"value": {"type": "page", "parent_table": "collection", "properties": {"title": [["Senior "], ["Engineer", []]]}, "last_edited_time": 0}}}
    view = {"value": {"type": "collection_view", "collection_id": "c", "view_ids": ["v", "w"]}, "spaceId": "s"}
    blocks = {"12345678-aaaa-bbbb": row, "2": {"value": {"type": "page"}}, "3": view, "4": {"value": 5}}
    assert [(j["title"], j["provider_job_id"], j["posted_str"]) for j in html.block_jobs(blocks)] == [("Senior Engineer", "12345678", "1970-01-01T00:00:00.000Z")]
    assert html.collection_views(blocks) == [{"block_id": "3", "collection_id": "c", "view_id": "v", "space_id": "s"}]
    data = {"props": {"pageProps": {"recordMap": {"block": blocks}}}}
    assert len(html.page_jobs(f'<script id="__NEXT_DATA__" type="x">{json.dumps(data)}</script>')) == 1
    shown = f'<div><div class="a notion-collection-row b"><a href="/Dev-{"a" * 32}">Developer</a></div></div>'
    assert [j["title"] for j in html.page_jobs(shown)] == ["Developer"] and html.page_jobs("<p>none</p>") == []


def test_embedded_board():
    company = {"props": {"company": {"long_description": "We  build", "jobs": [{"id": 7, "title": " Dev ", "skills": ["a", "b"], "visa": "yes & no"}, {"title": "X", "url": "https://evil.com"}, {"title": ""}]}}}
    page = f'<div data-page="{json.dumps(company).replace("&", "&amp;").replace(chr(34), "&quot;")}" id="app"></div>'
    jobs = html.embed_jobs(page, "bravo")
    assert len(jobs) == 1 and jobs[0]["description"] == "<p>We build</p><ul><li>Visa: yes &amp; no</li></ul><p>Skills: a, b</p>"
    assert jobs[0]["apply_url"].endswith("signup_job_id=7") and html.embed_jobs("<p>", "bravo") == []


def test_robots(spark):
    text = "User-agent: a\nUser-agent: jobloom # us\nDisallow: /private\nDisallow: /*.pdf$\nAllow: /\n\nUser-agent: *\nDisallow: /"
    assert html.robots_rules(text) == ["/private", "/*.pdf$"] and html.robots_rules(text, "other") == ["/"]
    rows = spark.createDataFrame([("/private/x",), ("/a.pdf",), ("/a.pdf?x",), ("/public",)], "p string")
    rules = F.array(F.lit("/private"), F.lit("/*.pdf$"), F.lit(" "))
    assert [r.ok for r in rows.select(html.allowed_by_robots(rules, F.col("p")).alias("ok")).collect()] == [False, False, True, True]


def test_connectors(spark):
    make = lambda rows, cols="slug string, body string": spark.createDataFrame(rows, cols)
    lever = payloads.lever(make([("bravo", '[{"id":"1","text":"T","categories":{"commitment":"Full"},"descriptionPlain":"d","createdAt":1700000000000}]')])).first()
    assert (lever.location, lever.apply_url, lever.posted_num) == ("Full", "https://jobs.lever.co/bravo", 1.7e12)
    lists = make([("bravo", '{"data":{"jobBoard":{"jobPostings":[{"id":"1"},{"id":"2"},{"id":"3"}]}}}')])
    details = make([("bravo", "1", '{"data":{"jobPosting":{"id":"1","title":"T","locationName":"L","descriptionHtml":"d","publishedDate":"2026-01-01"}}}'), ("bravo", "2", "broken"), ("bravo", "3", '{"data":{"jobPosting":null}}')],
                   "slug string, key string, body string")
    assert [r.provider_job_id for r in payloads.ashby(lists, details).collect()] == ["1"]
    smart = payloads.smartrecruiters(make([("a b", '{"content":[{"id":"9","name":"N","location":{"city":"C"},"createdOn":"x"}],"totalFound":1}')]),
                                     make([("a b", "9", '{"jobAd":{"sections":{"companyDescription":{"text":"c"},"qualifications":{"text":"q"}}}}')], "slug string, key string, body string")).first()
    assert smart.description == "<h3>Company Description</h3>c\n<h3>Qualifications</h3>q" and smart.apply_url.endswith("/a%20b/9")
    work = payloads.workable(make([("bravo", '{"results":[{"shortcode":"S","title":"t","full_title":"F","locations":["A","","B"]}]}')])).first()
    assert (work.title, work.location, work.description) == ("F", "A, B", "")
    day = payloads.workday(make([("t:wd1:s", '{"total":1,"jobPostings":[{"title":"T","externalPath":"/job/1","locationsText":"L","bulletFields":["R1"],"postedOn":"Posted Yesterday"}]}')]),
                           make([("t:wd1:s", "/job/1", '{"jobPostingInfo":{"jobDescription":"d"}}')], "slug string, key string, body string"), 86_400_000).first()
    assert (day.provider_job_id, day.location, day.posted_str) == ("R1", "L", "1970-01-01T00:00:00.000Z")
    green = payloads.greenhouse(make([("bravo", '{"jobs":[{"id":5,"title":"T","location":{"name":"L"},"content":"&lt;p&gt;x&#33;","absolute_url":"u","updated_at":"2026-01-01"}]}')])).first()
    assert green.description == "<p>x!" and green.provider_job_id == "5"
    none = make([], "slug string, html string")
    feed = make([("bravo", '[{"id":"1","title":"T","url":"/jobs/1"}]'), ("other", "broken")])
    assert [(r.provider_slug, r.apply_url) for r in payloads.waas(feed, none, none).collect()] == [("bravo", "https://www.workatastartup.com/jobs/1")]


def test_normalized_postings_of_a_page(spark):
    page = '<script type="application/ld+json">{"@type":"JobPosting","title":"Dev","url":"/j/1","description":"' + "text " * 40 + '"}</script>'
    jobs = payloads.custom(spark.createDataFrame([(URL, page)], "slug string, html string")).withColumn("company_id", F.lit("c"))
    rows = ingest.long_enough(ingest.normalize(jobs, 0)).collect()
    assert len(rows) == 1 and rows[0].id.startswith(f"custom:{URL}:") and rows[0].expires_at == 30 * 86_400_000


def landed(spark, pages):
    rows = [(u, f, s, "text/html", b) for u, f, s, b in pages]
    return spark.createDataFrame(rows, "url string, final_url string, status int, content_type string, body string")


def test_probe(spark):
    companies = spark.createDataFrame([
        ("1", "one", "https://one.com"), ("2", "two", "two.com"), ("3", "three", "https://three.com"), ("4", "four", None), ("5", "five", "https://five.com"),
        ("6", "six", "https://six.com"), ("7", "seven", "https://seven.com"), ("8", "eight", "https://eight.com"),
    ], "id string, slug string, website string")
    pages = landed(spark, [
        ("https://one.com/", None, 200, '<a href="/x">x</a><a href="https://jobs.lever.co/one">Jobs</a>'),
        ("https://two.com/", None, 200, '<a href="/team/openings">Openings</a>'), ("https://two.com/careers", None, 200, "<p>nothing</p>"),
        ("https://two.com/jobs", None, 304, None), ("https://two.com/join", None, 200, '<a href="/deep/jobs">Jobs here</a>'), ("https://two.com/work", None, 200, "<p/>"),
        ("https://two.com/hiring", None, 200, "<p/>"), ("https://two.com/team/openings", None, 200, "<p/>"), ("https://www.ycombinator.com/companies/two/jobs", None, 200, "x"),
        ("https://three.com/", None, 404, None), ("https://five.com/", None, 200, "<p>hi</p>"), ("https://five.com/careers", None, 404, None),
        ("https://five.com/jobs", "https://jobs.lever.co/five", 200, "x"), ("https://six.com/", None, 200, "<p>hi</p>"), ("https://six.com/careers", "https://boards.greenhouse.io/six", 200, "x"),
        ("https://eight.com/", None, 200, "<p>hi</p>"), ("https://eight.com/jobs", None, 404, None),
    ])
    robots = spark.createDataFrame([("https://eight.com", 200, "User-agent: *\nDisallow: /careers")], "origin string, status int, body string")
    out = probe.probe(companies, pages, robots)
    got = {r.id: (r.careers_url, r.ats_provider, r.result) for r in out.collect()}
    assert got["1"] == ("https://jobs.lever.co/one", "lever", "found_ats")
    assert got["2"] == ("https://www.ycombinator.com/companies/two/jobs", "custom", "found_custom")
    assert got["3"] == (None, None, "no_page") and got["4"] == (None, None, "no_page")
    assert got["5"] == (None, None, "no_page")  # the first 404 ends the walk
    assert got["6"] == ("https://boards.greenhouse.io/six", "greenhouse", "found_ats")
    assert got["7"] == (None, None, "error") and got["8"] == (None, None, "blocked")
    rendered = spark.createDataFrame([("https://five.com/careers", "https://five.com/careers", "<h1>Open roles</h1>")], "url string, final_url string, body string")
    better = {r.id: r.result for r in probe.after_render(out, rendered).collect()}
    assert better["5"] == "found_custom" and better["3"] == "no_page"


def test_probe_walks_until_nothing_is_queued(spark):
    links = lambda *urls: "".join(f'<a href="{u}">next</a>' for u in urls)
    last = 13
    rows = []
    for name, end in (("long", (None, 200, links("https://jobs.lever.co/long"))), ("gone", (None, 404, None)), ("none", (None, 200, "<p/>")), ("early", (None, 200, "<p/>"))):
        site = f"https://{name}.com"
        rows += [(f"{site}/", None, 200, links("/work/p1"))]
        rows += [(f"{site}/work/p{i}", None, 200, links("/work/p1", f"/work/p{i + 1}")) for i in range(1, last)] + [(f"{site}/work/p{last}", *end)]
        rows += [(f"{site}{p}", None, 200, "<p/>") for p in probe.CAREERS_PATHS if (name, p) != ("early", "/hiring")] + [(f"{probe.YC_JOBS}/{name}/jobs", None, 304, None)]
    rows += [("https://early.com/hiring", "https://jobs.lever.co/early", 200, "x")]
    companies = spark.createDataFrame([(n, n, f"https://{n}.com") for n in ("long", "gone", "none", "early")], "id string, slug string, website string")
    robots = spark.createDataFrame([("https://none.com", 200, f"User-agent: *\nDisallow: /work/p{last}")], "origin string, status int, body string")
    got = {r.id: r for r in probe.probe(companies, landed(spark, rows), robots).collect()}
    assert (got["long"].careers_url, got["long"].ats_provider, got["long"].result) == ("https://jobs.lever.co/long", "lever", "found_ats")
    assert got["gone"].result == "no_page" and got["none"].result == "blocked"
    usual = lambda n: [f"https://{n}.com/", *(f"https://{n}.com{p}" for p in probe.CAREERS_PATHS)]
    for n in ("long", "gone", "none"):
        way = [f"https://{n}.com/work/p{i}" for i in range(1, last + 1)]
        assert got[n].checked == [*usual(n), way[0], f"{probe.YC_JOBS}/{n}/jobs", *way[1:]]
    assert got["early"].result == "found_ats" and got["early"].checked == usual("early")
    sizes = {u: len(b or "") for u, _, s, b in rows if s == 200}
    assert all(got[n].html_size == sum(sizes.get(u, 0) for u in got[n].checked[: -1 if n == "none" else None]) for n in ("long", "gone", "none"))
