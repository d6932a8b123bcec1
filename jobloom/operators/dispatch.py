"""From landed payloads of all boards to postings of known companies, and what couldn't be read.

`lists` (provider, slug, body) holds the JSON of boards' lists, feeds and page chunks, a row for each page of one;
`details` (provider, slug, key, body) the JSON of single postings; `pages` (provider, slug, html) the HTML of boards'
pages, of careers pages (custom) and of company websites that may embed a board (provider `site`). Each provider's
connector reads its own rows; the others never see them. A payload that is no JSON stops nothing: it is set aside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.operators.feed import quarantined
from jobloom.sources import payloads


def sound(landed: DataFrame) -> DataFrame:
    return landed.filter(F.try_parse_json("body").isNotNull())


def unreadable(lists: DataFrame, details: DataFrame) -> DataFrame:
    """provider, slug, key (null of a list) and what is wrong with the payload."""
    both = lists.withColumn("key", F.lit(None).cast("string")).unionByName(details)
    named = quarantined(both.withColumn("slug", F.struct("provider", "slug", "key")))
    return named.select("slug.*", "parse_error")


def postings(lists: DataFrame, details: DataFrame, pages: DataFrame, now_ms: int) -> DataFrame:
    """RAW_JOBS with provider_slug, of all providers."""
    lists, details = sound(lists), sound(details)
    of = lambda rows, provider: rows.filter(F.col("provider") == provider).drop("provider")
    parts = [read(of(pages if name == "custom" else lists, name)) for name, read in payloads.SIMPLE.items()]
    for name, read in payloads.DETAILED.items():
        own = (of(lists, name), of(details, name))
        parts.append(read(*own, now_ms) if name == "workday" else read(*own))
    parts.append(payloads.notion(of(pages, "notion"), of(lists, "notion")))
    parts.append(payloads.waas(of(lists, "waas"), of(pages, "site"), of(pages, "waas")))
    return payloads.all_jobs(parts)


def of_companies(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings with the id of the company whose board they stand on; those of no company are dropped.

    companies: id, provider, provider_slug (see ingest.stored_provider). Of companies with one board the first by id has
    it. seq orders postings of one id: an arbitrary order, but always the same.
    """
    owners = companies.filter("provider_slug IS NOT NULL").groupBy("provider", "provider_slug").agg(F.min("id").alias("company_id"))
    return jobs.join(owners, ["provider", "provider_slug"]).withColumn("seq", F.xxhash64(*jobs.columns))
