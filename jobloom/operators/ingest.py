"""Postings to listings, and upserts into snapshots of the tables.

An upsert takes the rows of the batch, reduced to one for each key, and the snapshot's other rows, and returns the whole new
snapshot; the table store writes it as a new version. Batches are reduced with aggregates that combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import detect, text, times
from jobloom.schemas import LISTINGS, PROVIDERS, THIRTY_DAYS_MS
from jobloom.sources.shared import materialize

LEAST_BODY = 100
SECONDS = 10_000_000_000


def normalize(jobs: DataFrame, now_ms: int, body_chars: bool = False) -> DataFrame:
    """Listings from postings with company_id, provider and provider_slug; other columns of jobs are dropped but `seq`.

    body_chars: with that column, the length of the description's text, which upserts look at.
    """
    rows = _cleaned(jobs, now_ms)
    kept = ["seq"] if "seq" in jobs.columns else []
    kept += [F.length("plain").alias("body_chars")] * body_chars
    return _told(rows).select(*kept, *_listing())


def _cleaned(jobs: DataFrame, now_ms: int) -> DataFrame:
    """jobs with their listing's id, their text as html and plain, when they were posted, and when they expire."""
    rows = jobs.withColumn("html", F.coalesce("description", F.lit("")))
    rows = text.cleaned(rows, "html", "plain").withColumn("posted", times.parse_posted_at(F.col("posted_num"), F.col("posted_str"), now_ms))
    return rows.withColumns({"id": F.concat_ws(":", "provider", "provider_slug", "provider_job_id"), "expires_at": times.expiry(F.col("posted"))})


def _told(rows: DataFrame) -> DataFrame:
    """rows of _cleaned with what their texts say: known words, pay and place."""
    rows = rows.withColumn("said", F.concat("title", F.lit(" "), "plain"))
    rows = rows.withColumn("words", text.known_words(F.col("said")))
    return rows.withColumns({"pay": text.parse_compensation(F.concat("title", F.lit(" "), "said")), "place": text.parse_location(F.col("location"))})


def _listing() -> list[Column]:
    """The columns of listings over rows of _told."""
    listing = {
        "id": F.col("id"), "company_id": F.col("company_id"), "title": F.col("title"),
        "location_city": F.col("place.city"), "location_country": F.col("place.country"), "location_is_remote": F.col("place.is_remote"),
        "location_policy": F.col("place.policy"), "comp_min": F.col("pay.low"), "comp_max": F.col("pay.high"), "comp_currency": F.col("pay.currency"),
        "comp_equity": F.col("pay.equity"), "ai_stack": text.stack_of(F.col("words")), "ai_specialty": text.specialty_of(F.col("words")),
        "ai_compute_access": F.lit(None).cast("string"), "description_html": F.col("html"), "apply_url": F.col("apply_url"),
        "posted_at": F.col("posted"), "expires_at": F.col("expires_at"), "updated_at": F.col("posted"), "status": F.lit("active"),
    }
    return [listing[f.name].cast(f.dataType).alias(f.name) for f in LISTINGS.fields]


def assert_milliseconds(rows: DataFrame) -> DataFrame:
    """Fails the job where a row's expires_at is null or in seconds: one bad row rejects the batch."""
    return rows.withColumn("expires_at", asserted(F.coalesce(F.col("expires_at") >= SECONDS, F.lit(False)), F.col("expires_at")))


def asserted(in_ms: Column, expires_at: Column) -> Column:
    ok = F.assert_true(in_ms, F.concat(F.lit("expires_at is not in milliseconds: "), F.col("id")))
    return F.when(ok.isNull(), expires_at)


def body_length(rows: DataFrame) -> Column:
    """Characters of a listing's text, from body_chars where normalize has left it."""
    return F.col("body_chars") if "body_chars" in rows.columns else F.length(text.strip_tags(F.col("description_html")))


def long_enough(rows: DataFrame) -> DataFrame:
    return rows.filter(body_length(rows) >= LEAST_BODY)


def upsert_listings(listings: DataFrame, batch: DataFrame, now_ms: int) -> DataFrame:
    """listings with a batch (listings and `seq`, their order) upserted on id: see changed_listings."""
    return upsert_merged(listings, merged_listings(batch), now_ms)


def upsert_merged(listings: DataFrame, merged: DataFrame, now_ms: int) -> DataFrame:
    """listings with a batch that merged_listings or merged_postings has brought to a row for each id."""
    names = [f.name for f in LISTINGS.fields]
    # Of stored rows that a batch replaces only the company is needed, and the others only pass: a batch of few ids is
    # broadcast, and the snapshot isn't shuffled.
    return listings.select(*names).join(merged.select("id"), "id", "left_anti").unionByName(changed_listings(listings, merged, now_ms))


def merged_listings(batch: DataFrame) -> DataFrame:
    """A row for each id of a batch (listings and `seq`, their order), written. Rows with short bodies are skipped.

    new: the last row; first_company: the first row's; n: rows of the id.
    """
    return materialize(_merged(batch, body_length(batch), [f.name for f in LISTINGS.fields]), "batch")  # read three times


def merged_postings(jobs: DataFrame, now_ms: int) -> DataFrame:
    """merged_listings of normalize(jobs): only texts' bodies are worked out for all postings, the rest for those that are left."""
    rows = _cleaned(jobs, now_ms)
    last = _merged(rows, F.length("plain"), ["id", "company_id", "title", "location", "apply_url", "html", "plain", "posted", "expires_at"])
    told = _told(last.select("first_company", "n", "new.*"))
    return materialize(told.select("id", F.struct(*_listing()).alias("new"), "first_company", "n"), "batch")


def _merged(batch: DataFrame, body: Column, names: list[str]) -> DataFrame:
    """A row for each id of rows whose bodies are long enough: new (the columns `names` of the last by `seq`), first_company, n."""
    # No filter before the aggregate: Catalyst would push it below the texts' columns and work them out twice.
    rows = batch.withColumn("_kept", body >= LEAST_BODY)
    in_ms = F.coalesce(F.col("expires_at") >= SECONDS, F.lit(False))
    rows = rows.withColumn("expires_at", F.when(F.col("_kept"), asserted(in_ms, F.col("expires_at"))).otherwise(F.col("expires_at")))
    order = F.when(F.col("_kept"), F.col("seq"))
    return rows.groupBy("id").agg(
        F.max_by(F.struct(*names), order).alias("new"), F.min_by("company_id", order).alias("first_company"), F.count_if("_kept").alias("n")
    ).filter("n > 0")


def changed_listings(listings: DataFrame, merged: DataFrame, now_ms: int) -> DataFrame:
    """The rows that an upsert of merged_listings adds to listings or puts in place of theirs.

    A new id keeps its expiry; an id that was there, or comes twice in the batch, is revived for 30 days. The last row of an
    id wins, but its company is the stored one, or the first row's. listings: the rows with these ids, and any others.
    """
    ids = merged.select("id")
    stored = listings.join(ids, "id", "left_semi").select("id", F.lit(True).alias("stored"), F.col("company_id").alias("old_company"))
    both = merged.join(stored, "id", "left")
    conflict = F.col("stored").isNotNull() | (F.col("n") > 1)
    special = {
        "id": F.col("id"),
        "company_id": F.coalesce("old_company", "first_company"),
        "expires_at": F.when(conflict, F.lit(now_ms + THIRTY_DAYS_MS)).otherwise(F.col("new.expires_at")),
        "updated_at": F.lit(now_ms),
        "status": F.when(conflict, "active").otherwise(F.col("new.status")),
    }
    return both.select(*[special.get(f.name, F.col(f"new.{f.name}")).cast(f.dataType).alias(f.name) for f in LISTINGS.fields])


def upsert_companies(companies: DataFrame, batch: DataFrame, overwrite_careers: bool, only_changed: bool = False) -> DataFrame:
    """companies with a batch upserted on slug: id and creation stay, careers_url too unless it is to be overwritten.

    Of rows with one slug in the batch the last by `seq` wins, if there is such a column. only_changed: without the companies
    that the batch doesn't name.
    """
    updated = ["name", "yc_batch", "website", "logo_url", "description"] + ["careers_url"] * overwrite_careers
    names = companies.columns
    own = [F.col(c) if c in batch.columns else F.lit(None).cast(companies.schema[c].dataType).alias(c) for c in names]
    order = "seq" if "seq" in batch.columns else "id"
    merged = batch.select(*own, F.col(order).alias("_order")).groupBy("slug").agg(
        F.max_by(F.struct(*names), "_order").alias("new"), F.min_by(F.struct(*names), "_order").alias("first")
    )
    both = companies.select("slug", F.struct(*names).alias("old")).join(merged, "slug", "right" if only_changed else "full_outer")
    columns = []
    for c in names:
        new = F.col(f"new.{c}") if c in updated else F.coalesce(F.col(f"old.{c}"), F.when(F.col("old").isNull(), F.col(f"first.{c}")))
        columns.append((F.col("slug") if c == "slug" else F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(new)).alias(c))
    return both.select(*columns)


def stored_provider(companies: DataFrame) -> DataFrame:
    """companies with provider and provider_slug: the stored provider, the slug of whatever board the URL names."""
    found = detect.detect(F.col("careers_url"))
    custom = F.col("ats_provider") == "custom"
    ready = F.col("careers_url").isNotNull() & F.col("ats_provider").isNotNull() & (custom | found.isNotNull())
    return companies.withColumns({
        "provider": F.when(ready, F.col("ats_provider")),
        "provider_slug": F.when(ready, F.when(custom, F.col("careers_url")).otherwise(found["slug"])),
    })


def resolved_provider(companies: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """stored_provider, and where there is none what the URL, or the landed page (url, html) behind it, names."""
    rows = stored_provider(companies)
    if pages is None:
        rows = rows.withColumn("_body", F.lit(None).cast("string"))
    else:
        own = pages.groupBy(F.col("url").alias("careers_url")).agg(F.min("html").alias("_body"))
        rows = rows.join(own, "careers_url", "left")
    found = detect.detect_with_body(F.col("careers_url"), F.col("_body"))
    return rows.withColumns({
        "provider": F.coalesce("provider", found["provider"]), "provider_slug": F.coalesce("provider_slug", found["slug"])
    }).drop("_body")


def provider_totals(listings: DataFrame) -> DataFrame:
    """Rows of each provider (column provider), zero where there are none."""
    spark = listings.sparkSession
    known = spark.createDataFrame([(p,) for p in PROVIDERS], "provider string")
    counted = listings.groupBy("provider").agg(F.count("*").alias("n"))
    return known.join(counted, "provider", "left").select("provider", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def provider_breakdown(companies: DataFrame) -> DataFrame:
    """Companies with a careers page by provider, most first."""
    rows = companies.filter(F.col("careers_url").isNotNull()).groupBy("ats_provider").agg(F.count("*").alias("n"))
    return rows.orderBy(F.col("n").desc(), F.col("ats_provider").asc_nulls_first())
