"""Listing search: filters, the join with companies, order, pages and counts.

Filters are plain comparisons of columns, so they reach the Parquet scan. Companies are not hinted for broadcast: Catalyst
and AQE choose by measured size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.text import job_path, normalized_batch, role_slug
from jobloom.operators.ranks import ranked
from jobloom.schemas import SPECIALTIES, THIRTY_DAYS_MS

PAGE = 50
FEED_PAGE, FEED_LIMIT = 50, 1000
LISTING_COLUMNS = (
    "id", "company_id", "title", "location_city", "location_country", "location_is_remote", "location_policy", "comp_min",
    "comp_max", "comp_currency", "ai_stack", "ai_specialty", "description_html", "apply_url", "posted_at", "expires_at",
)


@dataclass(frozen=True)
class Filters:
    specialty: str | None = None
    remote_only: bool = False
    min_comp: float | None = None


def _number(text: str) -> float | None:
    """A query value as a finite number: decimal, with exponent, or hexadecimal; blanks around it are ignored."""
    text = text.strip()
    try:
        n = float(int(text, 16)) if text[:2].lower() == "0x" else float(text.replace("_", "x")) if text else 0.0
    except ValueError:
        return None
    return n if n == n and abs(n) != float("inf") and "n" not in text.lower() else None


def read_filters(query: str) -> Filters:
    """Filters from a query string; unknown values are ignored."""
    values: dict[str, str] = {}
    for k, v in parse_qsl(query.lstrip("?"), keep_blank_values=True):
        values.setdefault(k, v)
    wanted = values.get("specialty")
    least = values.get("min_comp")
    return Filters(wanted if wanted in SPECIALTIES else None, values.get("remote") == "1", _number(least) if least else None)


def filter_href(query: str, **changes: object) -> str:
    """The link with some filters set anew or, if empty, taken away: specialty, remote_only, min_comp."""
    pairs = parse_qsl(query.lstrip("?"), keep_blank_values=True)

    def put(name: str, value: str | None) -> None:
        at = [i for i, (k, _) in enumerate(pairs) if k == name]
        if value is not None and at:
            pairs[at[0]] = (name, value)
        elif value is not None:
            pairs.append((name, value))
        keep = at[:1] if value is not None else []
        pairs[:] = [p for i, p in enumerate(pairs) if p[0] != name or i in keep or i not in at]

    if "specialty" in changes:
        put("specialty", str(changes["specialty"]) if changes["specialty"] else None)
    if "remote_only" in changes:
        put("remote", "1" if changes["remote_only"] else None)
    if "min_comp" in changes:
        n = changes["min_comp"]
        put("min_comp", None if n is None else str(int(n)) if float(n).is_integer() else str(n))
    return f"/?{urlencode(pairs)}" if pairs else "/"


def is_active(now_ms: int) -> Column:
    return (F.col("status") == "active") & (F.col("expires_at") > now_ms)


def pays_at_least(floor: float) -> Column:
    """coalesce(comp_max, comp_min, 0) >= floor, as comparisons that a scan can check."""
    low, high, k = F.col("comp_min"), F.col("comp_max"), F.lit(int(floor) if float(floor).is_integer() else float(floor))
    return (high >= k) | (high.isNull() & (low >= k)) | (high.isNull() & low.isNull() & (F.lit(0) >= k))


def predicates(filters: Filters, now_ms: int) -> list[Column]:
    out = [is_active(now_ms)]
    if filters.specialty:
        out.append(F.col("ai_specialty") == filters.specialty)
    if filters.remote_only:
        out.append(F.col("location_is_remote") == 1)
    if filters.min_comp is not None:
        out.append(pays_at_least(filters.min_comp))
    return out


def matching(listings: DataFrame, filters: Filters, now_ms: int) -> DataFrame:
    return listings.filter(reduce(and_, predicates(filters, now_ms)))


def with_company(listings: DataFrame, companies: DataFrame, columns: Sequence[str] = LISTING_COLUMNS) -> DataFrame:
    """Listings with slug, name, website and logo of their company."""
    own = companies.select(
        F.col("id").alias("company_id"), F.col("slug").alias("company_slug"), F.col("name").alias("company_name"),
        F.col("website").alias("company_website"), F.col("logo_url").alias("company_logo_url"),
    )
    return listings.select(*columns).join(own, "company_id").select(*columns, *own.columns[1:])


def newest_first(rows: DataFrame) -> DataFrame:
    """By recency; equal dates by id, so that pages don't overlap."""
    return rows.orderBy(F.col("posted_at").desc(), F.col("id"))


def recent(listings: DataFrame, companies: DataFrame, filters: Filters, now_ms: int, limit: int = PAGE, offset: int = 0) -> DataFrame:
    return newest_first(with_company(matching(listings, filters, now_ms), companies)).offset(offset).limit(limit)


def count_active(listings: DataFrame, companies: DataFrame, filters: Filters, now_ms: int) -> DataFrame:
    return with_company(matching(listings, filters, now_ms), companies, ("id", "company_id")).agg(F.count("*").alias("n"))


def all_active(listings: DataFrame, companies: DataFrame, now_ms: int) -> DataFrame:
    return newest_first(with_company(matching(listings, Filters(), now_ms), companies))


def companies_by_name(companies: DataFrame) -> DataFrame:
    return companies.select("id", "slug", "name", "website").orderBy("name", "id")


def company_by_slug(companies: DataFrame, slug: str) -> DataFrame:
    return companies.filter(F.col("slug") == slug).select("id", "slug", "name", "website").limit(1)


def active_of_company(listings: DataFrame, companies: DataFrame, company_id: str, now_ms: int) -> DataFrame:
    rows = matching(listings, Filters(), now_ms).filter(F.col("company_id") == company_id)
    return newest_first(with_company(rows, companies))


def by_role_slug(listings: DataFrame, companies: DataFrame, company_slug: str, role: str, now_ms: int) -> DataFrame:
    """The most recent active listing of a company whose title and id make the role's slug."""
    rows = with_company(matching(listings, Filters(), now_ms), companies.filter(F.col("slug") == company_slug))
    return newest_first(rows.filter(role_slug(F.col("title"), F.col("id")) == role)).limit(1)


def newest_by_role_slug(listings: DataFrame, companies: DataFrame, now_ms: int) -> DataFrame:
    """For every company and role slug its most recent active listing, as by_role_slug finds it."""
    rows = with_company(matching(listings, Filters(), now_ms), companies).select(
        "id", "company_slug", "posted_at", role_slug(F.col("title"), F.col("id")).alias("role_slug"),
        job_path(F.col("company_slug"), F.col("title"), F.col("id")).alias("path"),
    )
    order = Window.partitionBy("company_slug", "role_slug").orderBy(F.col("posted_at").desc(), "id")
    return rows.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


def by_session(listings: DataFrame, companies: DataFrame, paid: DataFrame, session_id: str | None = None) -> DataFrame:
    """Listings paid for in a checkout session, or in any."""
    bought = paid if session_id is None else paid.filter(F.col("stripe_session_id") == session_id)
    bought = bought.select(F.col("listing_id").alias("id"), "stripe_session_id")
    rows = with_company(listings, companies).join(bought, "id")
    return rows if session_id is None else rows.drop("stripe_session_id").limit(1)


def page_bounds(total: int, page: int, size: int = PAGE) -> dict[str, int]:
    """Pages, the page within them, and the first and last row shown."""
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    return {"pages": pages, "page": page, "offset": (page - 1) * size, "first": min(total, (page - 1) * size + 1), "last": min(total, page * size)}


def feed_page(rows: DataFrame, total: int, page: int) -> DataFrame:
    """A feed of all rows, or of one page of them where there are more than FEED_LIMIT."""
    return rows if total <= FEED_LIMIT else rows.offset((max(1, page) - 1) * FEED_PAGE).limit(FEED_PAGE)


def feed_pages(rows: DataFrame, size: int = FEED_PAGE) -> DataFrame:
    """rows with page, from 1: what feed_page gives for each page, for all pages at once."""
    placed = ranked(rows, [F.col("posted_at").desc(), F.col("id")], name="_place")
    return placed.withColumn("page", F.expr(f"_place div {size} + 1")).drop("_place")


# --- companies: what to scrape, what to probe


def with_careers(companies: DataFrame) -> DataFrame:
    return companies.filter(F.col("careers_url").isNotNull()).orderBy("slug")


def newest_batch_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("yc_batch").desc_nulls_last(), "slug")


def probe_eligible(companies: DataFrame, now_ms: int, batch: str | None = None, limit: int | None = None) -> DataFrame:
    """With a website and no careers page; never probed, last found something, or failed at least 30 days ago."""
    site = F.col("website").isNotNull() & (F.trim("website") != "") & F.col("careers_url").isNull()
    failed = F.coalesce(F.col("careers_probe_result").isin("no_page", "blocked", "error"), F.lit(False))
    at = F.col("careers_probe_at")
    due = at.isNull() | (at == 0) | ~failed | (at <= now_ms - THIRTY_DAYS_MS)
    rows = companies.filter(site & due)
    if batch:
        rows = rows.filter(normalized_batch(F.col("yc_batch")) == normalized_batch(F.lit(batch)))
    rows = newest_batch_first(rows)
    return rows if limit is None else rows.limit(limit)


def headless_eligible(companies: DataFrame, now_ms: int, limit: int | None = None, batch: str | None = None) -> DataFrame:
    """Probed within 30 days without a page or with an error, of one batch if it is named."""
    since = (now_ms // 1000 - THIRTY_DAYS_MS // 1000) * 1000
    site = F.col("website").isNotNull() & (F.trim("website") != "") & F.col("careers_url").isNull()
    rows = newest_batch_first(companies.filter(site & F.col("careers_probe_result").isin("no_page", "error") & (F.col("careers_probe_at") >= since)))
    if batch:
        rows = rows.filter(normalized_batch(F.col("yc_batch")) == normalized_batch(F.lit(batch)))
    return rows if limit is None else rows.limit(limit)


def empty_descriptions(listings: DataFrame, now_ms: int, least: int = 50) -> DataFrame:
    return listings.filter(is_active(now_ms) & (F.length("description_html") < least)).select("id", "apply_url")
