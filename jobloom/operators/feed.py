"""What is published besides the feed: routes, the sitemap's dates, and audits of what would be shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import company_path, job_path
from jobloom.functions.times import to_iso
from jobloom.operators import search


def company_routes(companies: DataFrame) -> DataFrame:
    return companies.select("slug", company_path(F.col("slug")).alias("path"))


def job_dates(listings: DataFrame, companies: DataFrame, site: str, now_ms: int) -> DataFrame:
    """url (without a slash at its end) and lastmod of every active listing's page."""
    rows = search.with_company(search.matching(listings, search.Filters(), now_ms), companies, (*search.LISTING_COLUMNS, "updated_at"))
    url = F.concat(F.lit(site.rstrip("/")), job_path(F.col("company_slug"), F.col("title"), F.col("id")))
    return rows.groupBy(F.regexp_replace(url, r"/\z", "").alias("url")).agg(F.max("updated_at").alias("lastmod"))


def sitemap(urls: DataFrame, dates: DataFrame) -> DataFrame:
    """urls (url) with the ISO date of what they show, null where they are no listing's page."""
    key = F.regexp_replace("url", r"/\z", "")
    own = dates.select(F.col("url").alias("key"), to_iso(F.col("lastmod")).alias("lastmod"))
    return urls.withColumn("key", key).join(own, "key", "left").select("url", "lastmod")


def foreign_board_urls(listings: DataFrame) -> DataFrame:
    """Active listings whose address looks like a board's job page on another host; matched without regard to case."""
    url = F.col("apply_url")
    return listings.filter((F.col("status") == "active") & url.ilike("%/companies/%/jobs/%") & ~url.ilike("%workatastartup.com%")).select("id", "apply_url")


def quarantined(payloads: DataFrame) -> DataFrame:
    """Landed payloads (slug, body) that are no JSON, with what is wrong: the others go on."""
    return payloads.filter(F.try_parse_json("body").isNull()).select("slug", F.when(F.col("body").isNull(), "no body").otherwise("no JSON").alias("parse_error"))
