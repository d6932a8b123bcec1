"""Queries of the boards' connectors, over payloads that are made of the postings' view as the boards would send them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import text
from jobloom.operators import dispatch, ingest
from jobloom.plans.oracle import POSTED_ON, iso, sanitized, squeeze, stripped
from jobloom.sources import payloads
from jobloom.sources.views import NOW_MS, view, with_views


def _seq() -> Column:
    return F.col("seq")


def _text() -> Column:
    return _seq().cast("string")


def _named(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def _list(rows: DataFrame, item: Column, *path: str) -> DataFrame:
    """slug and body of each company's list: items in an array below the path, none for an empty path."""
    body = F.collect_list(item)
    for name in reversed(path):
        body = F.struct(body.alias(name))
    return rows.groupBy(F.col("company_id").alias("slug")).agg(F.to_json(body).alias("body"))


def _details(rows: DataFrame, key: Column, body: Column) -> DataFrame:
    """slug, key and body; every seventh is missing, every fifth has landed twice."""
    one = rows.filter("seq % 7 <> 0").select(F.col("company_id").alias("slug"), key.alias("key"), F.to_json(body).alias("body"), "seq")
    return one.unionByName(one.filter("seq % 5 = 0")).drop("seq")


def greenhouse_lists(rows: DataFrame) -> DataFrame:
    return _list(rows, _named(id=_seq(), title=F.col("title"), location=_named(name=F.col("location")), content=F.col("description"), absolute_url=F.col("apply_url")), "jobs")


def lever_lists(rows: DataFrame) -> DataFrame:
    return _list(rows, _named(
        id=_text(), text=F.col("title"), categories=_named(location=F.col("location"), commitment=F.lit("Full-time")),
        descriptionPlain=F.when(_seq() % 2 == 0, F.col("description")), description=F.concat(F.lit("<i>"), "description", F.lit("</i>")),
        hostedUrl=F.when(_seq() % 5 != 0, F.col("apply_url")), createdAt=F.col("posted_num"),
    ))


def ashby_payloads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = F.concat(F.lit("j "), _text())
    posting = _named(id=key, title=F.col("title"), locationName=F.col("location"), descriptionHtml=F.col("description"), publishedDate=F.lit("2001-07-01"))
    body = _named(data=_named(jobPosting=F.when(_seq() % 6 != 0, posting)))
    return _list(rows, _named(id=key), "data", "jobBoard", "jobPostings"), _details(rows, key, body)


def smartrecruiters_payloads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    place = _named(fullLocation=F.when(_seq() % 3 == 0, F.col("location")), city=F.lit("Lyon"))
    item = _named(id=_text(), name=F.col("title"), location=place, releasedDate=F.when(_seq() % 2 == 0, "2001-07-02"), createdOn=F.lit("2001-07-01"))
    sections = _named(companyDescription=_named(text=F.when(_seq() % 2 == 0, "About")), jobDescription=_named(text=F.col("description")))
    return _list(rows, item, "content"), _details(rows, _text(), _named(jobAd=_named(sections=sections)))


def workable_lists(rows: DataFrame) -> DataFrame:
    places = F.when(_seq() % 4 != 0, F.array(F.coalesce("location", F.lit("")), F.lit(""), F.lit("Rome")))
    return _list(rows, _named(shortcode=F.concat(F.lit("W"), _text()), title=F.lit("short"), full_title=F.when(_seq() % 3 != 0, F.col("title")), locations=places, published=F.lit("2001-07-03")), "results")


def workday_payloads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = rows.withColumn("company_id", F.concat(F.lit("bravo:wd5:"), "company_id"))
    path = F.concat(F.lit("/job/x_"), _text())
    item = _named(title=F.col("title"), externalPath=path, locationsText=F.col("location"), postedOn=F.col("posted_str"), bulletFields=F.when(_seq() % 4 != 0, F.array(F.concat(F.lit("R"), _text()))))
    info = _named(jobPostingId=F.when(_seq() % 2 == 0, F.concat(F.lit("JR"), _text())), jobDescription=F.col("description"), location=_named(location=F.when(_seq() % 3 == 0, "Rome")))
    return _list(rows, item, "jobPostings"), _details(rows, path, _named(jobPostingInfo=info))


def notion_chunks(rows: DataFrame) -> DataFrame:
    block_id = F.regexp_replace(F.md5(_text().cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    page = _named(type=F.lit("page"), parent_table=F.lit("collection"), properties=_named(title=F.array(F.array("title"))))
    blocks = F.map_from_entries(F.collect_list(F.struct(block_id, _named(value=_named(value=page)))))
    return rows.groupBy(F.col("company_id").alias("slug")).agg(F.to_json(_named(recordMap=_named(block=blocks))).alias("body"))


def waas_payloads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feeds of the companies with an even number, boards' pages of the others."""
    own = rows.withColumn("even", F.substring_index("company_id", "-", -1).cast("bigint") % 2 == 0)
    job = _named(id=_seq(), title=F.col("title"), location=F.col("location"), description=F.col("description"))
    feeds = _list(own.filter("even"), job)
    company = own.filter("NOT even").groupBy(F.col("company_id").alias("slug")).agg(F.collect_list(job).alias("jobs"))
    data = F.to_json(_named(props=_named(company=_named(slug=F.col("slug"), jobs=F.col("jobs")))))
    return feeds, company.select("slug", F.concat(F.lit('<div data-page="'), text.escape_html(data), F.lit('" id="app"></div>')).alias("html"))


def custom_pages(rows: DataFrame) -> DataFrame:
    node = _named(**{"@type": F.lit("JobPosting"), "title": F.col("title"), "url": F.col("apply_url"), "description": F.col("description")})
    site = F.concat(F.lit("https://"), "company_id", F.lit(".example.com/careers"))
    nodes = rows.groupBy(site.alias("slug")).agg(F.to_json(F.struct(F.collect_list(node).alias("@graph"))).alias("body"))
    return nodes.select("slug", F.concat(F.lit('<script type="application/ld+json">'), F.replace("body", F.lit("</"), F.lit("<\\/")), F.lit("</script>")).alias("html"))


# --- queries

_SHOWN = ("provider_slug", "provider_job_id", "title", "location", "description", "apply_url")


def _rows(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "raw_jobs_v")


def lever_jobs(spark, sf_dir):
    return payloads.lever(lever_lists(_rows(spark, sf_dir))).select(*_SHOWN, "posted_num")


def ashby_jobs(spark, sf_dir):
    """A board's list joined with landed details, of which some are missing, some hold nothing and some came twice."""
    return payloads.ashby(*ashby_payloads(_rows(spark, sf_dir))).select(*_SHOWN, "posted_str")


def smartrecruiters_jobs(spark, sf_dir):
    return payloads.smartrecruiters(*smartrecruiters_payloads(_rows(spark, sf_dir))).select(*_SHOWN, "posted_str")


def workable_jobs(spark, sf_dir):
    return payloads.workable(workable_lists(_rows(spark, sf_dir))).select(*_SHOWN, "posted_str")


def workday_jobs(spark, sf_dir):
    return payloads.workday(*workday_payloads(_rows(spark, sf_dir)), NOW_MS).select(*_SHOWN, "posted_str")


def _landed(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lists, details and pages of every board, each posting on the board of its provider, and payloads that are no JSON."""
    own = lambda provider: rows.filter(F.col("provider") == provider)
    tag = lambda provider, df: df.withColumn("provider", F.lit(provider))
    detailed = {"ashby": ashby_payloads(own("ashby")), "smartrecruiters": smartrecruiters_payloads(own("smartrecruiters")), "workday": workday_payloads(own("workday"))}
    feeds, boards = waas_payloads(own("waas"))
    lists = {"greenhouse": greenhouse_lists(own("greenhouse")), "lever": lever_lists(own("lever")), "workable": workable_lists(own("workable")), "notion": notion_chunks(own("notion")), "waas": feeds}
    lists |= {name: two[0] for name, two in detailed.items()}
    bad = rows.filter("seq % 50 = 1").select(F.col("provider"), F.col("company_id").alias("slug"), F.when(_seq() % 100 == 1, "{oops").alias("body"))
    all_lists = payloads.all_jobs([*(tag(n, df).select("provider", "slug", "body") for n, df in lists.items()), bad])
    all_details = payloads.all_jobs([tag(n, two[1]).select("provider", "slug", "key", "body") for n, two in detailed.items()])
    shells = tag("notion", own("notion").select(F.col("company_id").alias("slug")).distinct().withColumn("html", F.lit("<html></html>")))
    pages = [tag("custom", custom_pages(own("custom"))), tag("waas", boards), shells]
    return all_lists, all_details, payloads.all_jobs([p.select("provider", "slug", "html") for p in pages])


def _owners(rows: DataFrame) -> DataFrame:
    """Companies by the board of each provider that they use."""
    slug = F.when(F.col("provider") == "workday", F.concat(F.lit("bravo:wd5:"), "company_id")).when(F.col("provider") == "custom", F.concat(F.lit("https://"), "company_id", F.lit(".example.com/careers")))
    return rows.select(F.col("company_id").alias("id"), "provider", F.coalesce(slug, F.col("company_id")).alias("provider_slug")).distinct()


def landed_postings(spark, sf_dir):
    """Every board's landed payloads through its connector, to postings of companies: how many of which company on which board."""
    rows = _rows(spark, sf_dir)
    jobs = dispatch.of_companies(dispatch.postings(*_landed(rows), NOW_MS), _owners(rows))
    return jobs.groupBy("provider", "company_id").agg(F.count("*").alias("n"), F.min("title").alias("first_title"))


def landed_to_listings(spark, sf_dir):
    """Landed payloads through connectors and normalization into an empty store: what is listed, by provider."""
    rows = _rows(spark, sf_dir)
    jobs = dispatch.of_companies(dispatch.postings(*_landed(rows), NOW_MS), _owners(rows))
    none = view(spark, sf_dir, "listings_v").filter("false")
    listed = ingest.upsert_listings(none, ingest.normalize(jobs, NOW_MS), NOW_MS)
    return ingest.provider_totals(listed.select(F.substring_index("id", ":", 1).alias("provider")))


def unreadable_payloads(spark, sf_dir):
    lists, details, _ = _landed(_rows(spark, sf_dir))
    return dispatch.unreadable(lists, details)


QUERIES = {f.__name__: f for f in (lever_jobs, ashby_jobs, smartrecruiters_jobs, workable_jobs, workday_jobs, landed_postings, landed_to_listings, unreadable_payloads)}

_DETAILED = "provider NOT IN ('ashby', 'smartrecruiters', 'workday') OR seq % 7 <> 0 AND NOT (provider = 'ashby' AND seq % 6 = 0)"
_DECODED = "replace(replace(replace(replace(replace(description, '&nbsp;', ' '), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_SECTIONED = "concat_ws(chr(10), CASE WHEN seq % 2 = 0 THEN '<h3>Company Description</h3>About' END, CASE WHEN description <> '' THEN '<h3>Job Description</h3>' || description END)"
_ONE = f"""CASE provider WHEN 'lever' THEN CASE WHEN seq % 2 = 0 THEN description ELSE '<i>' || description || '</i>' END WHEN 'smartrecruiters' THEN {_SECTIONED}
  WHEN 'greenhouse' THEN {_DECODED} WHEN 'waas' THEN {squeeze("description")} WHEN 'workable' THEN '' WHEN 'notion' THEN '' ELSE description END"""
_RAW = {
    "lever_jobs": """SELECT company_id AS provider_slug, CAST(seq AS VARCHAR) AS provider_job_id, title, coalesce(location, 'Full-time') AS location,
      CASE WHEN seq % 2 = 0 THEN description ELSE '<i>' || description || '</i>' END AS description,
      CASE WHEN seq % 5 = 0 THEN 'https://jobs.lever.co/' || company_id ELSE apply_url END AS apply_url, CAST(posted_num AS DOUBLE) AS posted_num FROM raw_jobs_v""",
    "ashby_jobs": """SELECT company_id AS provider_slug, 'j ' || seq AS provider_job_id, title, location, description,
      'https://jobs.ashbyhq.com/' || company_id || '/j%20' || seq AS apply_url, '2001-07-01' AS posted_str FROM raw_jobs_v WHERE seq % 7 <> 0 AND seq % 6 <> 0""",
    "smartrecruiters_jobs": f"""SELECT company_id AS provider_slug, CAST(seq AS VARCHAR) AS provider_job_id, title, CASE WHEN seq % 3 = 0 AND location IS NOT NULL THEN location ELSE 'Lyon' END AS location,
      {_SECTIONED} AS description, 'https://jobs.smartrecruiters.com/' || company_id || '/' || seq AS apply_url,
      CASE WHEN seq % 2 = 0 THEN '2001-07-02' ELSE '2001-07-01' END AS posted_str FROM raw_jobs_v WHERE seq % 7 <> 0""",
    "workable_jobs": """SELECT company_id AS provider_slug, 'W' || seq AS provider_job_id, CASE WHEN seq % 3 = 0 THEN 'short' ELSE title END AS title,
      CASE WHEN seq % 4 <> 0 THEN CASE WHEN coalesce(location, '') = '' THEN '' ELSE location || ', ' END || 'Rome' END AS location, '' AS description,
      'https://apply.workable.com/' || company_id || '/j/W' || seq || '/' AS apply_url, '2001-07-03' AS posted_str FROM raw_jobs_v""",
    "workday_jobs": f"""SELECT 'bravo:wd5:' || company_id AS provider_slug, CASE WHEN seq % 2 = 0 THEN 'JR' || seq WHEN seq % 4 <> 0 THEN 'R' || seq ELSE '/job/x_' || seq END AS provider_job_id, title,
      CASE WHEN seq % 3 = 0 THEN 'Rome' ELSE location END AS location, description, 'https://bravo.wd5.myworkdayjobs.com/wday/cxs/bravo/' || company_id || '/job/x_' || seq AS apply_url,
      {iso("ms")} AS posted_str FROM (SELECT *, {POSTED_ON} AS ms FROM raw_jobs_v) WHERE seq % 7 <> 0""",
    "landed_postings": f"""SELECT provider, company_id, count(*) AS n, min(CASE WHEN provider = 'workable' AND seq % 3 = 0 THEN 'short' ELSE title END) AS first_title
      FROM raw_jobs_v WHERE {_DETAILED} GROUP BY 1, 2""",
    "landed_to_listings": f"""WITH d AS (SELECT provider, {_ONE} AS d FROM raw_jobs_v WHERE {_DETAILED}), s AS (SELECT provider, {sanitized("d")} AS h FROM d),
      b AS (SELECT provider FROM s WHERE length({stripped("h")}) >= 100)
      SELECT t.p AS provider, count(b.provider) AS n FROM unnest(['greenhouse', 'lever', 'ashby', 'smartrecruiters', 'workable', 'workday', 'notion', 'waas', 'custom']) t(p)
      LEFT JOIN b ON b.provider = t.p GROUP BY 1""",
    "unreadable_payloads": """SELECT provider, company_id AS slug, CAST(NULL AS VARCHAR) AS key, CASE WHEN seq % 100 = 1 THEN 'no JSON' ELSE 'no body' END AS parse_error
      FROM raw_jobs_v WHERE seq % 50 = 1""",
}
SQL = {name: with_views(sql) for name, sql in _RAW.items()}
