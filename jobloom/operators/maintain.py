"""Maintenance of snapshots: expiry, unit repair, description backfill, probe results, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import html, text, times
from jobloom.operators.search import empty_descriptions
from jobloom.schemas import PROBE_RESULTS
from jobloom.sources.shared import one_row

FILLED = 200


def is_over(now_ms: int) -> Column:
    return (F.col("status") == "active") & (F.col("expires_at") < now_ms)


def sweep_expired(listings: DataFrame, now_ms: int) -> DataFrame:
    return listings.withColumn("status", F.when(is_over(now_ms), "expired").otherwise(F.col("status")))


def swept(listings: DataFrame, now_ms: int) -> DataFrame:
    """Only the rows that a sweep changes, as it leaves them."""
    return sweep_expired(listings.filter(is_over(now_ms)), now_ms)


def expire(listings: DataFrame, ids: DataFrame, at_ms: int) -> DataFrame:
    """expires_at set for the ids (column id); the next sweep changes the status."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return listings.join(hit, "id", "left").withColumn("expires_at", F.when(F.col("_hit"), F.lit(at_ms)).otherwise(F.col("expires_at"))).select(*listings.columns)


def repair_units(listings: DataFrame) -> DataFrame:
    return listings.withColumn("expires_at", times.repair_unit(F.col("expires_at")))


def repaired(listings: DataFrame) -> DataFrame:
    """Only the rows whose expiry is in seconds, in milliseconds."""
    return repair_units(listings.filter(F.col("expires_at") < 10_000_000_000))


def unit_counts(listings: DataFrame) -> DataFrame:
    return listings.agg(F.count_if(F.col("expires_at") < 10_000_000_000).alias("in_seconds"), F.count("*").alias("n"))


def main_content(page: Column) -> Column:
    """html.main_content of a page. Natively where one article, and nothing that hides tags, leaves no doubt about its place."""
    article = r"(?i)<article\b[^>]*>([\s\S]*?)</article>"
    clear = (F.regexp_count(page, F.lit("(?i)</?article\\b")) == 2) & page.rlike(article) & ~page.rlike(r"(?i)<!--|<(?:script|style|textarea|title|xmp|iframe|noembed|noframes|plaintext)\b[^>]*>[^<]*</?article")
    return F.when(clear, F.regexp_extract(page, article, 1)).otherwise(html.main_content_col(F.when(~F.coalesce(clear, F.lit(False)), page)))


def backfill_outcomes(listings: DataFrame, fetched: DataFrame, now_ms: int) -> DataFrame:
    """id, outcome and the new description of each listing without one, from landed responses (url, status, html).

    A 4xx expires it; no page is an error; a page with at least FILLED characters of text fills it; else it expires. The
    last response of a url counts (see one_row).
    """
    return outcomes_of(empty_descriptions(listings, now_ms), fetched)


def outcomes_of(wanted: DataFrame, fetched: DataFrame) -> DataFrame:
    """backfill_outcomes of the listings (id, apply_url) in wanted."""
    fetched = fetched.join(wanted.select(F.col("apply_url").alias("url")), "url", "left_semi")
    rows = wanted.join(one_row(fetched, "url").withColumnRenamed("url", "apply_url"), "apply_url", "left")
    rows = rows.withColumn("body", text.sanitize_html(main_content(F.col("html"))))
    outcome = (
        F.when(F.col("status").between(400, 499), "expired")
        .when(text.truthy(F.col("html")).isNull(), "error")
        .when(F.length(text.strip_tags(F.col("body"))) >= FILLED, "filled")
        .otherwise("expired")
    )
    rows = rows.withColumn("outcome", outcome)
    return rows.select("id", "outcome", F.when(F.col("outcome") == "filled", F.col("body")).alias("description_html"))


def apply_backfill(listings: DataFrame, outcomes: DataFrame, now_ms: int) -> DataFrame:
    own = one_row(outcomes.select("id", "outcome", F.col("description_html").alias("_body")), "id")
    rows = listings.join(own, "id", "left")
    rows = rows.withColumn("description_html", F.coalesce("_body", "description_html"))
    return rows.withColumn("expires_at", F.when(F.col("outcome") == "expired", F.lit(now_ms)).otherwise(F.col("expires_at"))).select(*listings.columns)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def apply_probe_results(companies: DataFrame, results: DataFrame, now_ms: int) -> DataFrame:
    """Probe results (id, careers_url, ats_provider, result) written to their companies."""
    own = results.select("id", F.col("careers_url").alias("_url"), F.col("ats_provider").alias("_ats"), F.col("result").alias("_result"))
    rows = companies.join(one_row(own, "id"), "id", "left")
    probed = F.col("_result").isNotNull()
    return rows.withColumns({
        "careers_url": F.when(probed, F.col("_url")).otherwise(F.col("careers_url")),
        "ats_provider": F.when(probed, F.col("_ats")).otherwise(F.col("ats_provider")),
        "careers_probe_at": F.when(probed, F.lit(now_ms)).otherwise(F.col("careers_probe_at")),
        "careers_probe_result": F.when(probed, F.col("_result")).otherwise(F.col("careers_probe_result")),
    }).select(*companies.columns)


def probe_counts(companies: DataFrame) -> DataFrame:
    """Companies by probe result, zero where there are none."""
    known = companies.sparkSession.createDataFrame([(r,) for r in PROBE_RESULTS], "careers_probe_result string")
    counted = companies.groupBy("careers_probe_result").agg(F.count("*").alias("n"))
    return known.join(counted, "careers_probe_result", "left").select("careers_probe_result", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def headless_counts(results: DataFrame) -> DataFrame:
    """processed, upgraded, still without a page, and errors of a second pass (result)."""
    r = F.col("result")
    return results.agg(
        F.count("*").alias("processed"), F.count_if(r.isin("found_ats", "found_custom")).alias("upgraded"),
        F.count_if(r == "no_page").alias("still_no_page"), F.count_if(r.isin("error", "blocked")).alias("errors"),
    )


def count_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Companies with a careers page before and after, and the difference."""
    tag = lambda df, when: df.select(F.lit(when).alias("w"), F.col("careers_url"))
    rows = tag(before, 0).unionByName(tag(after, 1)).filter("careers_url IS NOT NULL")
    return rows.agg(F.count_if(F.col("w") == 0).alias("before"), F.count_if(F.col("w") == 1).alias("after")).withColumn("delta", F.col("after") - F.col("before"))
