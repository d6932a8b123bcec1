"""Queries of operators that the views' own data would leave untried, over rows that vary by key, and what DuckDB says of them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import detect, docs, html, text
from jobloom.operators import ingest, maintain, probe, search
from jobloom.plans.boards import _named
from jobloom.plans.oracle import CONTENT, detected, escaped, role, squeeze
from jobloom.schemas import LISTINGS
from jobloom.sources import companies as directory
from jobloom.sources import payloads
from jobloom.sources.shared import fresh_dir
from jobloom.sources.store import TableStore
from jobloom.sources.views import NOW_MS, table, view, with_views

QUERIES, _RAW = {}, {}


def proof(sql: str):
    """Registers a query with what the same means in DuckDB."""

    def register(query):
        QUERIES[query.__name__], _RAW[query.__name__] = query, sql
        return query

    return register


def _by(key: Column, *values: object) -> Column:
    """The value that stands at key mod their number."""
    out = None
    for i, v in enumerate(values):
        is_it, v = key % len(values) == i, v if isinstance(v, Column) else F.lit(v)
        out = F.when(is_it, v) if out is None else out.when(is_it, v)
    return out


def by_sql(key: str, *values: str | None) -> str:
    """The same in SQL; strings are expressions."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v if v is not None else 'NULL'}" for i, v in enumerate(values)) + " END"


def quoted(*values: str | None) -> list[str]:
    return ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]


def _jobs(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "raw_jobs_v")


def _seq() -> Column:
    return F.col("seq")


# --- companies

_TAGS = (["Generative AI"], ["fintech", "Computer-Vision"], [], ["M L"], ["AI Ops"], ["b2b", "LLMs"], None)


@proof(f"""WITH r AS (SELECT CAST(substr(id, 4) AS BIGINT) AS k, * FROM companies_v)
  SELECT slug AS id, slug, name, {by_sql("k", *quoted("Winter 2024", None, "Fall 2025"))} AS yc_batch, CASE WHEN k % 2 = 0 THEN 'small' WHEN k % 3 = 0 THEN 'large' END AS logo_url,
    CASE WHEN k % 5 = 0 THEN 'one' ELSE description END AS description, {NOW_MS} AS created_at FROM r WHERE k % 7 IN (0, 1, 3, 5)""")
def directory_ai_companies(spark, sf_dir):
    """A directory's batch, of which the companies with an AI tag are kept."""
    k = F.substring_index("id", "-", -1).cast("bigint")
    tags = _by(k, *[F.array(*[F.lit(t) for t in tags]).cast("array<string>") if tags is not None else F.lit(None).cast("array<string>") for tags in _TAGS])
    rows = view(spark, sf_dir, "companies_v").select(
        k.alias("id"), "name", "slug", "website", F.when(k % 2 == 0, "small").otherwise("").alias("small_logo_thumb_url"), F.when(k % 3 == 0, "large").alias("logo_url"),
        F.when(k % 5 == 0, "one").otherwise("").alias("one_liner"), F.col("description").alias("long_description"), _by(k, "Winter 2024", None, "Fall 2025").alias("batch"), tags.alias("tags"),
    )
    return directory.ai_companies(rows, NOW_MS).select("id", "slug", "name", "yc_batch", "logo_url", "description", "created_at")


_CURATED = ", ".join("(" + ", ".join(quoted(*row)) + ")" for row in directory.CURATED)


@proof(f"""SELECT 'curated-' || slug AS id, slug, name, website, careers_url, description, {detected("careers_url", "provider")} AS provider
  FROM (VALUES {_CURATED}) t(slug, name, website, careers_url, description)""")
def curated_companies(spark, sf_dir):
    rows = directory.curated(spark, NOW_MS)
    return rows.select("id", "slug", "name", "website", "careers_url", "description", detect.detect(F.col("careers_url"))["provider"].alias("provider"))


@proof("SELECT count(*) AS n, count(DISTINCT slug) AS slugs FROM companies_v")
def directory_size(spark, sf_dir):
    return view(spark, sf_dir, "companies_v").agg(F.count("*").alias("n"), F.count_distinct("slug").alias("slugs"))


_BODIES = ('<a href="https://jobs.lever.co/Other">x</a>', "<p>Hello</p>", "   ", None, '<a href="https://boards.greenhouse.io/body">x</a>')


@proof(f"""WITH r AS (SELECT id, careers_url, {detected("careers_url", "provider")} AS p, {detected("careers_url", "slug")} AS s, CAST(substr(id, 4) AS BIGINT) AS k, count(*) OVER (PARTITION BY careers_url) AS n FROM companies_v)
  SELECT id, CASE WHEN careers_url IS NULL THEN NULL WHEN p IS NOT NULL THEN p WHEN n = 1 THEN {by_sql("k", *quoted("lever", "custom", None, None, "greenhouse"))} END AS provider,
    CASE WHEN careers_url IS NULL THEN NULL WHEN p IS NOT NULL THEN s WHEN n = 1 THEN {by_sql("k", "'Other'", "careers_url", None, None, "'body'")} END AS provider_slug FROM r""")
def resolved_provider(spark, sf_dir):
    """The board that a company's URL names, else the landed page behind it; a page that names none is a custom one."""
    rows = view(spark, sf_dir, "companies_v")
    k = F.substring_index("id", "-", -1).cast("bigint")
    pages = rows.filter("careers_url IS NOT NULL").select(F.col("careers_url").alias("url"), _by(k, *_BODIES).alias("html"), "id")
    # Where companies share an address nothing was landed.
    one = pages.groupBy("url").agg(F.count("*").alias("n"), F.max("html").alias("html")).filter("n = 1").select("url", "html")
    found = ingest.resolved_provider(rows, one)
    return found.select("id", "provider", "provider_slug")


# --- forms and drafts

_FORM = {
    "company_name": ("Acme", "", "Bravo"), "company_website": ("https://a.com", "a.com", "HTTP://b.org", "https://a.com"), "customer_email": ("a@b.c", "a@b.c", "ab.c", "a b@c.d", "x@y.zz"),
    "title": ("T",), "apply_url": ("https://a.com/x", "https://a.com/x", "mailto:a@b.c", "https://", "http:a", "ftp://a.com", "https://b.com"), "description": ("D", "D", "D", "D", "D", "D", "D", ""),
    "location_country": ("US",), "location_policy": ("remote", "onsite", "hybrid", "remote", "hybrid", "remote", "onsite", "remote", "hybrid", "moon", "remote"),
    "ai_specialty": ("", "nlp", "infra", "ops", "robotics", "vision", "nlp", "infra", "ops", "", "infra", "", "magic"),
}


# The messages of a form's errors.
@proof(f"""WITH f AS (SELECT o_orderkey AS key, {", ".join(f"{by_sql('o_orderkey', *quoted(*values))} AS {name}" for name, values in _FORM.items())} FROM orders)
  SELECT key, CASE WHEN company_name = '' OR description = '' THEN 'Please fill in every required field.'
    WHEN NOT regexp_matches(company_website, '^https?://', 'i') THEN 'Company website must start with http(s)://.'
    WHEN customer_email IN ('ab.c', 'a b@c.d') THEN 'Billing email looks invalid.'
    WHEN apply_url IN ('mailto:a@b.c', 'https://', 'ftp://a.com') THEN 'Apply URL must be a valid http(s) link.'
    WHEN location_policy = 'moon' THEN 'Pick a valid location policy.' WHEN ai_specialty = 'magic' THEN 'Pick a valid AI specialty.' END AS error FROM f""")
def form_errors(spark, sf_dir):
    """The first fault of each form, in the order in which they are looked for."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("key"), docs.form_error({name: _by(key, *values) for name, values in _FORM.items()}).alias("error"))


_DRAFTS = (
    ({}, None), ({"location_policy": "moon"}, "draft.location_policy invalid"), ({"location_policy": ""}, "draft.location_policy must be a non-empty string"),
    ({"location_is_remote": 2}, "draft.location_is_remote must be 0 or 1"), ({"location_is_remote": "1"}, "draft.location_is_remote must be 0 or 1"),
    ({"ai_stack": ["a", 1]}, "draft.ai_stack must be a string[]"), ({"ai_specialty": "magic"}, "draft.ai_specialty invalid"), ({"ai_specialty": None}, None),
    ({"title": 5}, "draft.title must be a non-empty string"), ({"location_city": 7}, "draft.location_city must be a string or null"),
    ({"comp_min": "x"}, "draft.comp_min must be a finite number or null"), ({"comp_max": 10.5}, None), ({"comp_currency": 1}, "draft.comp_currency must be a string or null"),
    ({"customer_email": ""}, "draft.customer_email must be a non-empty string"), ([], "decoded draft is not an object"), ("{oops", "decoded draft is not an object"),
)
_FINE = {
    "location_policy": "remote", "location_is_remote": 1, "ai_stack": ["cuda"], "company_name": "A", "company_website": "https://a.com", "title": "T", "apply_url": "https://a.com",
    "description_html": "<p>x</p>", "location_country": "US", "customer_email": "a@b.c", "location_city": None, "comp_min": 1, "comp_max": None, "comp_currency": "USD",
}


# Fixed values in _DRAFTS: the messages of a draft's errors.
@proof(f"SELECT event_id AS key, {by_sql('event_id', *quoted(*[error for _, error in _DRAFTS]))} AS error FROM events")
def draft_errors(spark, sf_dir):
    """What is wrong with each draft of a payment, sent in chunks of its metadata."""
    drafts = [d if isinstance(d, str) else json.dumps(_FINE | d if isinstance(d, dict) else d) for d, _ in _DRAFTS]
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), docs.encode_chunks(_by(F.col("event_id"), *drafts)).alias("m"))
    return rows.select("key", text.let(docs.decode_chunks(F.col("m")), docs.draft_error).alias("error"))


_LINKS = ("https://a.com/x", "http://a.com", "mailto:a@b.c", "HTTPS://A.com:80?q", "https:///", "//a.com", "https://", "a.com")


@proof(f"SELECT event_id, {by_sql('event_id', 'true', 'true', 'false', 'true', 'false', 'false', 'false', 'false')} AS ok FROM events")
def web_links(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(docs.is_web_url(_by(F.col("event_id"), *_LINKS)), F.lit(False)).alias("ok"))


# --- text

_TRAILS = ("Engineer view details now", "Engineer  Remote", "Engineer Paris, FR", "Engineer\n on site", "Read more", "Engineer Learn  More Remote")


# What is cut from a heading's end.
@proof(f"""SELECT seq, trim(regexp_replace(regexp_replace(regexp_replace(t, '(view\\s*details|read\\s*more|learn\\s*more).*$', '', 'i'), '\\s*(remote|anywhere|hybrid|on[- ]?site)\\s*$', '', 'i'),
    '\\s*([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*,\\s*[A-Z]{{2,}})\\s*$', '')) AS said, substr(sha1(apply_url), 1, 8) AS job_id FROM (
    SELECT seq, apply_url, title || ' - ' || replace({by_sql("seq", *[q.replace(chr(10), " ") for q in quoted(*_TRAILS)])}, '  ', ' ') AS t FROM raw_jobs_v)""")
def bare_titles(spark, sf_dir):
    """Titles without what trails them, and the ids of their addresses."""
    trail = _by(_seq(), *_TRAILS)
    return _jobs(spark, sf_dir).select("seq", text.strip_generic_trail(text.squeeze(F.concat("title", F.lit(" - "), trail))).alias("said"), text.job_id_of_url(F.col("apply_url")).alias("job_id"))


@proof(f"""SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS n, len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS own
  FROM pages WHERE html LIKE '%<a href="%'""")
def page_links(spark, sf_dir):
    links = F.explode(html.links_col(F.col("html"), F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", links.alias("l")).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("l.same_origin").alias("own"))


def page_variant(page: Column, key: Column) -> Column:
    """A page as it is, with main for article, with neither, and with neither and no heading."""
    bare = F.regexp_replace(page, "</?article>", "")
    return _by(key, page, F.regexp_replace(page, "(</?)article>", "$1main>"), bare, F.regexp_replace(bare, "(</?)h1>", "$1div>"))


@proof(f"SELECT page_id, md5({CONTENT}) AS digest FROM pages")
def main_content_ladder(spark, sf_dir):
    """The main content of pages with an article, with main, with a heading alone, and with none of them."""
    rows = table(spark, sf_dir, "pages").select("page_id", page_variant(F.col("html"), F.col("page_id")).alias("html"))
    return rows.select("page_id", F.md5(maintain.main_content(F.col("html")).cast("binary")).alias("digest"))


# --- connectors


@proof(f"""SELECT 'https://c' || seq || '.example.com/careers' AS provider_slug, title, CASE WHEN seq % 2 = 0 THEN 'Remote' END AS location,
    'https://c' || seq || '.example.com/jobs/' || seq AS apply_url FROM raw_jobs_v WHERE length(title) >= 10""")
def anchored_jobs(spark, sf_dir):
    """Postings that a page links to: the title in a heading of the link, or beside it, or the link's own text."""
    name = text.escape_html(F.col("title"))
    href = F.format_string("/jobs/%d", _seq())
    place = F.when(_seq() % 2 == 0, "<span>Remote</span>").otherwise("")
    link = lambda inside: F.concat(F.lit('<li><a href="'), href, F.lit('">'), inside)
    heads = _by(_seq(), F.concat(link(F.lit("<h4>")), name, F.lit("</h4></a>")), F.concat(link(F.lit("More")), F.lit("</a><h4>"), name, F.lit("</h4>")), F.concat(link(name), F.lit("</a>")))
    page = F.concat(F.lit("<html><body><ul>"), heads, place, F.lit('</li><li><a href="https://other.com/jobs/1">Engineer elsewhere</a></li></ul></body></html>'))
    rows = _jobs(spark, sf_dir).select(F.format_string("https://c%d.example.com/careers", _seq()).alias("slug"), page.alias("html"))
    return payloads.custom(rows).select("provider_slug", "title", "location", "apply_url")


@proof(f"""SELECT seq, {by_sql("seq", "'Paris, FR'", "'Paris, FR'", "'FR'", "'Lyon'", None, None, "'Rome, IT'")} AS location FROM raw_jobs_v""")
def jsonld_places(spark, sf_dir):
    """Where structured data says that a job is: one place or several, a country by its code or its name."""
    paris = {"address": {"addressLocality": "Paris", "addressCountry": "FR"}}
    places = [paris, [paris, {"address": {"addressLocality": "Lyon"}}], {"address": {"addressCountry": {"name": " FR "}}}, [{"x": 1}, {"address": {"addressLocality": "Lyon"}}], {"address": "Paris"}, [],
              [{"address": {}}, {"address": {"addressLocality": "Rome", "addressCountry": {"name": "IT"}}}]]
    node = F.concat(F.lit('{"@type": ["Thing", "jobposting"], "title": "Engineer", "url": "https://a.com/'), _seq().cast("string"), F.lit('", "jobLocation": '), _by(_seq(), *map(json.dumps, places)), F.lit("}"))
    page = F.concat(F.lit('<script type="application/ld+json">[{"@graph": ['), node, F.lit("]}]</script>"))
    found = payloads.custom(_jobs(spark, sf_dir).select(F.lit("https://a.com/careers").alias("slug"), page.alias("html")))
    return found.select(F.substring_index("apply_url", "/", -1).cast("bigint").alias("seq"), "location")


@proof("""SELECT CAST(seq AS VARCHAR) AS provider_slug, substr(md5(CAST(seq AS VARCHAR)), 1, 8) AS provider_job_id, title,
    'https://www.notion.so/' || CASE WHEN seq % 3 = 1 THEN 'x-' ELSE '' END || md5(CAST(seq AS VARCHAR)) AS apply_url FROM raw_jobs_v""")
def notion_pages(spark, sf_dir):
    """Postings in a page's embedded data, in the rows of a rendered collection, and, where it has neither, in a chunk."""
    own = F.md5(_seq().cast("string").cast("binary"))
    page = _named(type=F.lit("page"), parent_table=F.lit("collection"), properties=_named(title=F.array(F.array("title"))))
    blocks = F.to_json(F.create_map(own, _named(value=page)))
    data = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"recordMap": {"block": '), blocks, F.lit("}}}}</script>"))
    row = F.concat(F.lit('<div><div class="a notion-collection-row b"><a href="/x-'), own, F.lit('">'), "title", F.lit("</a></div></div>"))
    pages = _jobs(spark, sf_dir).select(_seq().cast("string").alias("slug"), _by(_seq(), data, row, "<p>x</p>").alias("html"))
    chunk = F.concat(F.lit('{"recordMap": {"block": '), blocks, F.lit("}}"))
    chunks = _jobs(spark, sf_dir).select(_seq().cast("string").alias("slug"), chunk.alias("body"))
    return payloads.notion(pages, chunks.unionByName(chunks)).select("provider_slug", "provider_job_id", "title", "apply_url")


@proof("""SELECT CAST(seq AS VARCHAR) AS slug, 'c' || seq AS collection_id, 'v' || seq AS view_id, 'b' || seq AS block_id, CASE WHEN seq % 2 = 0 THEN 'own' ELSE 'outer' END AS space_id
  FROM raw_jobs_v WHERE seq % 3 <> 0""")
def notion_collections(spark, sf_dir):
    """The collections that page chunks refer to."""
    n = _seq().cast("string")
    value = _named(type=_by(_seq(), "page", "collection_view", "collection_view_page"), collection_id=F.concat(F.lit("c"), n), view_ids=F.array(F.concat(F.lit("v"), n), F.lit("more")), space_id=F.when(_seq() % 2 == 0, "own"))
    block = F.create_map(F.concat(F.lit("b"), n), _named(spaceId=F.lit("outer"), value=value))
    return payloads.notion_collections(_jobs(spark, sf_dir).select(n.alias("slug"), F.to_json(_named(recordMap=_named(block=block))).alias("body")))


_PLACED = squeeze("location")


@proof(f"""SELECT 'c' || seq AS provider_slug, CAST(seq AS VARCHAR) AS provider_job_id, title, CASE WHEN seq % 3 = 2 THEN 'Board' ELSE nullif({_PLACED}, '') END AS location,
    CASE WHEN seq % 4 = 0 AND {squeeze("description")} <> '' THEN CASE WHEN seq % 3 = 0 THEN {squeeze("description")}
        ELSE replace(replace({squeeze("description")}, '&lt;', '<'), '&gt;', '>') END ELSE CASE WHEN seq % 3 <> 0 THEN '<p>We build &amp; ship</p>' ELSE '' END || '<ul><li>Type: Full-time</li>'
      || CASE WHEN seq % 3 = 2 THEN '<li>Location: Board</li>' WHEN {_PLACED} <> '' THEN '<li>Location: ' || {escaped(_PLACED)} || '</li>' ELSE '' END
      || CASE WHEN seq % 2 = 0 THEN '<li>Salary: $1 - $2</li>' ELSE '' END || '<li>Visa: yes</li></ul><p>Skills: c++, sql</p>' END AS description
  FROM raw_jobs_v""")
def described_board_jobs(spark, sf_dir):
    """Postings of a board's feed, of the board that a website embeds, and of the board's page; descriptions made where there are none."""
    slug = F.format_string("c%d", _seq())
    job = lambda place: _named(
        id=_seq(), title=F.col("title"), location=place, description=F.when(_seq() % 4 == 0, F.col("description")), type=F.lit("Full-time"), sponsorsVisa=F.lit("yes"),
        salaryRange=F.when(_seq() % 2 == 0, "$1 -  $2"), skills=F.array(F.lit("c++"), F.lit("sql")),
    )
    rows = _jobs(spark, sf_dir)
    feeds = rows.filter("seq % 3 = 0").select(slug.alias("slug"), F.to_json(F.array(job(F.col("location")))).alias("body"))

    def page(place: Column) -> Column:
        company = _named(slug=slug, long_description=F.lit("We build & ship"), jobs=F.array(job(place)))
        return F.concat(F.lit('<link href="workatastartup.com"><div data-page="'), text.escape_html(F.to_json(_named(props=_named(company=company)))), F.lit('" id="app"></div>'))

    # Websites also stand behind feeds, and boards behind both: the first with postings counts.
    sites = rows.filter("seq % 3 <> 2").select(slug.alias("slug"), page(F.col("location")).alias("html"))
    boards = rows.select(slug.alias("slug"), page(F.lit("Board")).alias("html"))
    found = payloads.waas(feeds, sites, boards)
    return found.select("provider_slug", "provider_job_id", "title", "location", "description")


# --- probe and maintenance


def _outcomes(spark, sf_dir) -> DataFrame:
    rows = view(spark, sf_dir, "companies_v")
    k = F.substring_index("id", "-", -1).cast("bigint")
    none = F.lit(None).cast("string")
    return rows.select("id", "slug", probe.website_url(F.col("website")).alias("site"), none.alias("careers_url"), none.alias("ats_provider"), _by(k, "no_page", "error", "no_page").alias("result"),
                       _by(k, 30719, 30720).alias("html_size"), k.alias("k"))


_SITE = "CASE WHEN website LIKE 'https%' THEN website || '/' END"
_PLACES = """(SELECT id, CAST(0 AS INTEGER) AS place, 'https://www.ycombinator.com/companies/' || slug || '/jobs' AS url FROM o
    UNION ALL SELECT id, 1, site FROM o WHERE site IS NOT NULL UNION ALL SELECT id, 2, site || 'careers' FROM o WHERE site IS NOT NULL)"""
_ONE = f"o AS (SELECT id, slug, {_SITE} AS site, CAST(substr(id, 4) AS BIGINT) AS k FROM companies_v WHERE CAST(substr(id, 4) AS BIGINT) % 3 <> 1 AND CAST(substr(id, 4) AS BIGINT) % 2 = 0)"


@proof(f"WITH {_ONE} SELECT * FROM {_PLACES}")
def render_candidates(spark, sf_dir):
    return probe.render_candidates(_outcomes(spark, sf_dir))


@proof(f"""WITH r AS (SELECT id, slug, {_SITE} AS site, CAST(substr(id, 4) AS BIGINT) AS k FROM companies_v), c AS (SELECT *, k % 3 <> 1 AND k % 2 = 0 AS due FROM r)
  SELECT id, CASE WHEN due AND k % 5 = 0 THEN 'https://www.ycombinator.com/companies/' || slug || '/jobs' WHEN due AND site IS NOT NULL AND k % 5 = 1 THEN 'https://jobs.lever.co/' || slug END AS careers_url,
    CASE WHEN due AND k % 5 = 0 THEN 'custom' WHEN due AND site IS NOT NULL AND k % 5 = 1 THEN 'lever' END AS ats_provider,
    CASE WHEN due AND k % 5 = 0 THEN 'found_custom' WHEN due AND site IS NOT NULL AND k % 5 = 1 THEN 'found_ats' WHEN k % 3 = 1 THEN 'error' ELSE 'no_page' END AS result FROM c""")
def rendered_probe(spark, sf_dir):
    """The second pass: what rendered pages say of the companies whose probe showed little HTML and found nothing."""
    rows = _outcomes(spark, sf_dir)
    yc = rows.filter("k % 5 = 0").select(F.concat(F.lit("https://www.ycombinator.com/companies/"), "slug", F.lit("/jobs")).alias("url"), F.lit("<p>x</p>").alias("body"))
    home = rows.filter("site IS NOT NULL").select(F.col("site").alias("url"), F.when(F.col("k") % 5 == 1, F.concat(F.lit('<a href="https://jobs.lever.co/'), "slug", F.lit('">j</a>'))).otherwise("<p>x</p>").alias("body"))
    pages = yc.unionByName(home).withColumn("final_url", F.col("url"))
    return probe.after_render(rows.drop("k"), pages).select("id", "careers_url", "ats_provider", "result")


@proof(f"""WITH d AS (SELECT id, slug, CAST(substr(id, 4) AS BIGINT) AS k FROM companies_v WHERE website IS NOT NULL AND trim(website) <> '' AND careers_probe_result IN ('no_page', 'error')
    AND careers_probe_at >= {NOW_MS - 2592000000}), h AS (SELECT *, k % 3 <> 1 AND k % 2 = 0 AS hit FROM d)
  SELECT id, CASE WHEN hit THEN 'https://jobs.lever.co/' || slug END AS careers_url, CASE WHEN hit THEN 'lever' END AS ats_provider, CASE WHEN hit THEN 'found_ats' ELSE 'error' END AS result FROM h""")
def second_pass(spark, sf_dir):
    """Companies probed of late without a page, or with an error, probed anew and then by their rendered pages.

    Of a third the homepage is landed, of a third its failure, of the others nothing; every other rendered homepage names a board.
    """
    due = search.headless_eligible(view(spark, sf_dir, "companies_v").withColumn("careers_url", F.lit(None).cast("string")), NOW_MS)
    rows = due.select("id", "slug", "website", F.substring("id", 4, 20).cast("bigint").alias("k"), probe.website_url(F.col("website")).alias("url"))
    fails = F.col("k") % 3 == 1
    pages = rows.filter("k % 3 < 2").select("url", F.col("url").alias("final_url"), F.when(~fails, 200).alias("status"), F.lit("text/html").alias("content_type"), F.when(~fails, "<p>app</p>").alias("body"))
    robots = spark.createDataFrame([], "origin string, status int, body string")
    board = F.concat(F.lit('<a href="https://jobs.lever.co/'), "slug", F.lit('">j</a>'))
    rendered = rows.select("url", F.col("url").alias("final_url"), F.when(F.col("k") % 2 == 0, board).otherwise("<p>x</p>").alias("body"))
    return probe.second_pass(due, pages, robots, rendered).select("id", "careers_url", "ats_provider", "result")


@proof(f"SELECT id, status, CASE WHEN title LIKE '%SRE%' THEN {NOW_MS} ELSE expires_at END AS expires_at FROM listings_v")
def expire_listings(spark, sf_dir):
    rows = view(spark, sf_dir, "listings_v")
    gone = rows.filter("title LIKE '%SRE%'").select("id")
    return maintain.expire(rows, gone.unionByName(gone), NOW_MS).select("id", "status", "expires_at")


@proof("SELECT id, expires_at * CASE WHEN expires_at < 10000000000 THEN 1000 ELSE 1 END AS expires_at FROM listings_v")
def asserted_milliseconds(spark, sf_dir):
    """Repaired rows pass the check that every batch must pass."""
    return ingest.assert_milliseconds(maintain.repair_units(view(spark, sf_dir, "listings_v"))).select("id", "expires_at")


@proof("SELECT id, posted_at, posted_at AS updated_at, '[]' AS ai_stack, CAST(NULL AS VARCHAR) AS ai_compute_access, title FROM listings_v")
def migrated_rows(spark, sf_dir):
    """Rows of an older table without some columns, as the present one has them."""
    old = view(spark, sf_dir, "listings_v").drop("updated_at", "ai_stack", "ai_compute_access")
    rows = TableStore.migrated("listings", old)
    assert rows.columns == [f.name for f in LISTINGS.fields]
    return rows.select("id", "posted_at", "updated_at", "ai_stack", "ai_compute_access", "title")


@proof("""WITH d AS (SELECT 't' || p_partkey AS name, p_partkey AS k FROM part)
  SELECT name, CASE WHEN k % 3 = 0 THEN 'Old_Companies' ELSE 'gone' || (k % 7) END AS target FROM d WHERE k % 3 <> 1 AND NOT (k % 3 = 2 AND k % 7 = 0)""")
def stale_references(spark, sf_dir):
    """What tables' definitions refer to that is no table."""
    k = F.col("p_partkey")
    target = F.when(k % 7 == 0, "Companies").otherwise(F.concat(F.lit("gone"), (k % 7).cast("string")))
    sql = _by(k, F.lit('CREATE TABLE a (x TEXT REFERENCES "Old_Companies"(id), y TEXT REFERENCES companies(id), z TEXT references `Old_Companies` (id))'), F.lit("CREATE TABLE a (x TEXT)"),
              F.concat(F.lit("CREATE TABLE b (x TEXT,\nFOREIGN KEY (x) REFERENCES\n"), target, F.lit(" (id))")))
    definitions = table(spark, sf_dir, "part").select(F.concat(F.lit("t"), k.cast("string")).alias("name"), sql.alias("sql"))
    return TableStore.stale_references(definitions, spark.createDataFrame([("companies",), ("listings",)], "name string"))


_VISITED = ("https://www.ycombinator.com/companies/a/jobs", "https://www.ycombinator.com/companies/a/jobs/1", "https://www.ycombinator.com/companies/a", "https://example.com/companies/a/jobs", "https://www.ycombinator.com/companies/a/jobsite")


@proof(f"""SELECT event_id, {by_sql("event_id", "true", "true", "false", "false", "false")} AS is_jobs_page, 'https://www.workatastartup.com/companies/s' || event_id AS board FROM events""")
def accelerator_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", probe.is_yc_jobs_page(_by(F.col("event_id"), *_VISITED)).alias("is_jobs_page"), detect.embed_company_url(F.format_string("s%d", F.col("event_id"))).alias("board"))


# --- pages of a list, links that filter it, and the store


@proof("""WITH n AS (SELECT n_nationkey AS key, n_nationkey * 17 AS total, n_regionkey * 3 - 1 AS asked, greatest(1, CAST(ceil(n_nationkey * 17 / 50.0) AS BIGINT)) AS pages FROM nation),
    p AS (SELECT *, least(greatest(1, asked), pages) AS page FROM n)
  SELECT key, pages, page, (page - 1) * 50 AS offset, least(total, (page - 1) * 50 + 1) AS first, least(total, page * 50) AS last FROM p""")
def page_arithmetic(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()
    out = [(r.n_nationkey, *search.page_bounds(r.n_nationkey * 17, r.n_regionkey * 3 - 1).values()) for r in rows]
    return spark.createDataFrame(out, "key int, pages long, page long, offset long, first long, last long")


_LISTS = ("", "page=2&remote=1", "?specialty=nlp")


@proof("""SELECT n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN (['/?specialty=infra', '/?page=2&remote=1&specialty=infra', '/?specialty=infra'])[n_nationkey % 3 + 1]
    ELSE (['/', '/?page=2&remote=1', '/'])[n_nationkey % 3 + 1] END AS href FROM nation""")
def filter_links(spark, sf_dir):
    """Links that set a filter, or take it away."""
    keys = [r.n_nationkey for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame([(k, search.filter_href(_LISTS[k % 3], specialty=None if k % 2 else "infra")) for k in keys], "key int, href string")


@proof("SELECT id, slug, upper(name) AS name, website, careers_probe_at, created_at FROM companies_v")
def stored_companies(spark, sf_dir):
    """Two versions written to a table store, each checked; what a reader sees is the last."""
    store = TableStore(spark, fresh_dir(spark, "store"))
    rows = view(spark, sf_dir, "companies_v")
    store.write("companies", rows)
    store.write("companies", store.read("companies").withColumn("name", F.upper("name")))
    return store.read("companies").select("id", "slug", "name", "website", "careers_probe_at", "created_at")


@proof("""WITH h AS (SELECT p_partkey AS key, md5(CAST(p_partkey AS VARCHAR)) AS d FROM part)
  SELECT key, CASE WHEN key % 5 < 3 THEN substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-' || substr(d, 21) END AS page_id FROM h""")
def page_ids_of_html(spark, sf_dir):
    """The id that a page of blocks names in its script: plain, dashed, in upper case, cut off or not there."""
    k, d = F.col("p_partkey"), F.md5(F.col("p_partkey").cast("string").cast("binary"))
    dashed = F.regexp_replace(d, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    told = F.when(k % 5 == 0, d).when(k % 5 == 1, dashed).when(k % 5 == 2, F.upper(d)).when(k % 5 == 3, F.substring(d, 1, 30))
    page = F.concat(F.lit('<script>{"spaceId":"x", "pageId" : "'), told, F.lit('"}</script>'))
    return table(spark, sf_dir, "part").select(k.alias("key"), text.page_id_of_html(F.coalesce(page, F.lit("<p>none</p>"))).alias("page_id"))


@proof(f"""WITH r AS (SELECT l.id, c.slug, posted_at, row_number() OVER (PARTITION BY c.slug, {role("title", "l.id")} ORDER BY posted_at DESC, l.id) AS k
    FROM listings_v l JOIN companies_v c ON c.id = l.company_id WHERE status = 'active' AND expires_at > {NOW_MS})
  SELECT id, slug AS company_slug, posted_at FROM r WHERE k = 1 ORDER BY id LIMIT 1""")
def listing_by_company_and_role(spark, sf_dir):
    """The page of one role of one company: of all that roles' pages show, the first by id."""
    rows, companies = view(spark, sf_dir, "listings_v"), view(spark, sf_dir, "companies_v")
    first = search.newest_by_role_slug(rows, companies, NOW_MS).orderBy("id").limit(1).first()
    if first is None:
        return rows.limit(0).select("id", F.lit("").alias("company_slug"), "posted_at")
    return search.by_role_slug(rows, companies, first.company_slug, first.role_slug, NOW_MS).select("id", "company_slug", "posted_at")


SQL = {name: with_views(sql) for name, sql in _RAW.items()}
