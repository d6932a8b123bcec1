"""Job-board connectors over landed responses: each turns payloads into postings (schemas.RAW_JOBS and the slug).

Spark tasks don't crawl: a fetcher lands responses as rows, and these are pure transformations of them. `lists` has
slug and body, the JSON of a board's list (one row for each page of it); `details` has slug, key and body, the JSON of one
posting. A posting without a usable detail is dropped where the board needs one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions import detect, html, times
from jobloom.functions.text import truthy
from jobloom.schemas import RAW_JOBS


def _encoded(value: Column) -> Column:
    return F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))


def _jobs(rows: DataFrame, provider: str, **columns: Column) -> DataFrame:
    out = {"provider": F.lit(provider)} | columns
    own = [out.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_JOBS.fields]
    return rows.select(F.col("slug").alias("provider_slug"), *own)


def _listed(lists: DataFrame, schema: str, items: str) -> DataFrame:
    """One row for each item of the lists' JSON."""
    parsed = lists.select("slug", F.from_json("body", schema).alias("b"))
    return parsed.select("slug", F.explode(items).alias("j"))


def _detail(details: DataFrame, schema: str) -> DataFrame:
    """One row for each detail: of several that were landed the greatest that is readable."""
    read = details.select("slug", "key", "body", F.from_json("body", schema).alias("d")).filter("d IS NOT NULL")
    return read.groupBy("slug", "key").agg(F.max_by("d", "body").alias("d"))


def greenhouse(lists: DataFrame) -> DataFrame:
    rows = _listed(lists, "jobs array<struct<id: bigint, title: string, location: struct<name: string>, content: string, absolute_url: string, updated_at: string>>", "b.jobs")
    rows = rows.withColumn("text", html.html_decode_col(F.coalesce("j.content", F.lit(""))))
    return _jobs(
        rows, "greenhouse", provider_job_id=F.col("j.id"), title=F.col("j.title"), location=F.col("j.location.name"), description=F.col("text"),
        apply_url=F.col("j.absolute_url"), posted_str=F.col("j.updated_at"),
    )


def lever(lists: DataFrame) -> DataFrame:
    schema = "array<struct<id: string, text: string, categories: struct<location: string, commitment: string>, descriptionPlain: string, description: string, hostedUrl: string, createdAt: double>>"
    rows = _listed(lists, schema, "b")
    return _jobs(
        rows, "lever", provider_job_id=F.col("j.id"), title=F.col("j.text"), location=F.coalesce("j.categories.location", "j.categories.commitment"),
        description=F.coalesce("j.descriptionPlain", "j.description", F.lit("")),
        apply_url=F.coalesce("j.hostedUrl", F.concat(F.lit("https://jobs.lever.co/"), "slug")), posted_num=F.col("j.createdAt"),
    )


def ashby(lists: DataFrame, details: DataFrame) -> DataFrame:
    rows = _listed(lists, "data struct<jobBoard: struct<jobPostings: array<struct<id: string>>>>", "b.data.jobBoard.jobPostings")
    kind = "data struct<jobPosting: struct<id: string, title: string, locationName: string, descriptionHtml: string, publishedDate: string>>"
    one = _detail(details, kind).select("slug", "key", F.col("d.data.jobPosting").alias("p")).filter("p IS NOT NULL")
    rows = rows.withColumn("key", F.col("j.id")).join(one, ["slug", "key"])
    return _jobs(
        rows, "ashby", provider_job_id=F.col("p.id"), title=F.col("p.title"), location=F.col("p.locationName"), description=F.col("p.descriptionHtml"),
        apply_url=F.concat(F.lit("https://jobs.ashbyhq.com/"), _encoded(F.col("slug")), F.lit("/"), _encoded(F.col("p.id"))), posted_str=F.col("p.publishedDate"),
    )


# The sections of a posting and their headings.
SECTIONS = (
    ("companyDescription", "Company Description"), ("jobDescription", "Job Description"),
    ("qualifications", "Qualifications"), ("additionalInformation", "Additional Information"),
)


def smartrecruiters(lists: DataFrame, details: DataFrame) -> DataFrame:
    rows = _listed(lists, "content array<struct<id: string, name: string, location: struct<fullLocation: string, city: string>, releasedDate: string, createdOn: string>>, totalFound bigint", "b.content")
    kind = "jobAd struct<sections: struct<" + ", ".join(f"{k}: struct<text: string>" for k, _ in SECTIONS) + ">>"
    rows = rows.withColumn("key", F.col("j.id")).join(_detail(details, kind), ["slug", "key"])
    parts = []
    for k, head in SECTIONS:
        text = F.col(f"d.jobAd.sections.{k}.text")
        parts.append(F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"<h3>{head}</h3>"), text)))
    return _jobs(
        rows, "smartrecruiters", provider_job_id=F.col("j.id"), title=F.col("j.name"), location=F.coalesce("j.location.fullLocation", "j.location.city"),
        description=F.array_join(F.array_compact(F.array(*parts)), "\n"),
        apply_url=F.concat(F.lit("https://jobs.smartrecruiters.com/"), _encoded(F.col("slug")), F.lit("/"), _encoded(F.col("j.id"))),
        posted_str=F.coalesce("j.releasedDate", "j.createdOn"),
    )


def workable(lists: DataFrame) -> DataFrame:
    rows = _listed(lists, "results array<struct<shortcode: string, title: string, full_title: string, locations: array<string>, published: string>>", "b.results")
    places = F.filter("j.locations", lambda p: p.isNotNull() & (p != ""))
    return _jobs(
        rows, "workable", provider_job_id=F.col("j.shortcode"), title=F.coalesce("j.full_title", "j.title"),
        location=F.when(F.size(places) > 0, F.array_join(places, ", ")), description=F.lit(""),
        apply_url=F.concat(F.lit("https://apply.workable.com/"), _encoded(F.col("slug")), F.lit("/j/"), _encoded(F.col("j.shortcode")), F.lit("/")),
        posted_str=F.col("j.published"),
    )


def workday(lists: DataFrame, details: DataFrame, now_ms: int) -> DataFrame:
    """slug is tenant:region:site; a detail's key is its path."""
    rows = _listed(lists, "total bigint, jobPostings array<struct<title: string, externalPath: string, locationsText: string, postedOn: string, bulletFields: array<string>>>", "b.jobPostings")
    kind = "jobPostingInfo struct<jobPostingId: string, jobDescription: string, location: struct<locationsText: string, location: string>, postedOn: string>"
    rows = rows.withColumn("key", F.col("j.externalPath")).join(_detail(details, kind), ["slug", "key"])
    part = F.split("slug", ":")
    url = F.concat(F.lit("https://"), part[0], F.lit("."), part[1], F.lit(".myworkdayjobs.com/wday/cxs/"), part[0], F.lit("/"), part[2], F.col("j.externalPath"))
    info = "d.jobPostingInfo"
    return _jobs(
        rows, "workday", provider_job_id=F.coalesce(f"{info}.jobPostingId", F.get("j.bulletFields", F.lit(0)), "j.externalPath"), title=F.col("j.title"),
        location=F.coalesce(f"{info}.location.locationsText", f"{info}.location.location", "j.locationsText"),
        description=F.coalesce(f"{info}.jobDescription", F.lit("")), apply_url=url,
        posted_str=times.parse_posted_on(F.coalesce(f"{info}.postedOn", "j.postedOn"), now_ms),
    )


def _exploded(rows: DataFrame, jobs: Column) -> DataFrame:
    return rows.select(F.col("slug").alias("provider_slug"), F.explode(jobs).alias("j")).select("provider_slug", "j.*")


def notion(pages: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Landed pages (slug, html); where one shows no postings, its landed chunks (slug, body)."""
    shown = pages.withColumn("jobs", html.page_jobs_col(F.col("html")))
    out = _exploded(shown, F.col("jobs"))
    if chunks is None:
        return out
    silent = shown.filter(F.coalesce(F.size("jobs"), F.lit(0)) <= 0).select("slug")
    rest = _exploded(chunks.join(silent, "slug", "left_semi"), html.chunk_jobs_col(F.col("body")))
    one = rest.groupBy("provider_slug", "provider_job_id").agg(F.min(F.struct(*rest.columns)).alias("r"))
    return out.unionByName(one.select("r.*"))


def notion_collections(chunks: DataFrame) -> DataFrame:
    """What to land next: the collections that landed chunks (slug, body) refer to, each once."""
    found = chunks.select("slug", F.explode(html.collection_views_col(F.col("body"))).alias("v")).select("slug", "v.*")
    return found.groupBy("slug", "collection_id", "view_id").agg(F.min("block_id").alias("block_id"), F.min("space_id").alias("space_id"))


def waas(feeds: DataFrame, sites: DataFrame, boards: DataFrame) -> DataFrame:
    """The first of a company's own feed (slug, body), its website's embed and the board's page (slug, html) with postings.

    A website counts only where it embeds the company's own board.
    """
    own = sites.filter(detect.detect_embed(F.col("html"))["slug"] == F.col("slug"))
    ranked = _exploded(feeds, html.feed_jobs_col(F.col("body"), F.col("slug"))).withColumn("rank", F.lit(0))
    for rank, rows in ((1, own), (2, boards)):
        ranked = ranked.unionByName(_exploded(rows, html.embed_jobs_col(F.col("html"), F.col("slug"))).withColumn("rank", F.lit(rank)))
    # A window, no join with the least ranks: that would parse every payload twice.
    best = F.min("rank").over(Window.partitionBy("provider_slug"))
    return ranked.withColumn("best", best).filter("rank = best").drop("rank", "best")


# Where a website may embed a board.
EMBED_PATHS = ("", "/careers", "/jobs", "/join", "/work", "/hiring")


def website_candidates(companies: DataFrame) -> DataFrame:
    """slug, place and url of the pages of a company's website where a board may be embedded."""
    site = F.when(F.col("website").startswith("http"), F.col("website")).otherwise(F.concat(F.lit("https://"), "website"))
    base = F.lower(F.regexp_extract(site, r"^(?i)(https?://[^/?#\s]+)", 1))
    urls = F.array_distinct(F.array(*[F.concat(base, F.lit(p or "/")) for p in EMBED_PATHS]))
    rows = companies.filter(truthy(F.col("website")).isNotNull() & (base != ""))
    return rows.select("slug", F.posexplode(urls).alias("place", "url"))


def custom(pages: DataFrame) -> DataFrame:
    """Landed careers pages (slug: the page's address, html)."""
    return _exploded(pages, html.custom_jobs_col(F.col("html"), F.col("slug")))


#: Providers whose landed lists are all that their connector reads.
SIMPLE: dict[str, Callable[[DataFrame], DataFrame]] = {"greenhouse": greenhouse, "lever": lever, "workable": workable, "custom": custom}
#: Providers that join a list with details.
DETAILED: dict[str, Callable] = {"ashby": ashby, "smartrecruiters": smartrecruiters, "workday": workday}


def all_jobs(parts: list[DataFrame]) -> DataFrame:
    """Postings of several connectors as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
