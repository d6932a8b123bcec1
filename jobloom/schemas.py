"""Table schemas, constraints and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

DAY_MS = 86_400_000
THIRTY_DAYS_MS = 30 * DAY_MS

# Enumerations of the tables' check constraints.
PROVIDERS = ("greenhouse", "lever", "ashby", "smartrecruiters", "workable", "workday", "notion", "waas", "custom")
PROBE_RESULTS = ("found_ats", "found_custom", "no_page", "blocked", "error")
POLICIES = ("remote", "hybrid", "onsite")
SPECIALTIES = ("nlp", "vision", "robotics", "infra", "ops")
STATUSES = ("active", "expired", "filled")
TIERS = ("founding", "standard")

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType()),
}


def _schema(text: str) -> T.StructType:
    """A schema from `name type, ...`, without a session."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


COMPANIES = _schema(
    "id string, slug string, name string, yc_batch string, website string, logo_url string, description string, "
    "careers_url string, ats_provider string, careers_probe_at bigint, careers_probe_result string, created_at bigint"
)
LISTINGS = _schema(
    "id string, company_id string, title string, location_city string, location_country string, location_is_remote int, "
    "location_policy string, comp_min bigint, comp_max bigint, comp_currency string, comp_equity int, ai_stack string, "
    "ai_specialty string, ai_compute_access string, description_html string, apply_url string, posted_at bigint, "
    "expires_at bigint, updated_at bigint, status string"
)
PAID_LISTINGS = _schema(
    "id string, listing_id string, stripe_session_id string, stripe_event_id string, tier string, amount_cents bigint, "
    "currency string, customer_email string, paid_at bigint"
)
#: What a job that wrote tables left of itself, in the same commit: counters is JSON.
RUNS = _schema("id string, run string, job string, at_ms bigint, base bigint, seconds double, counters string")
#: posted_at of a posting is a number or a string: two columns, at most one of them set.
RAW_JOBS = _schema(
    "provider string, provider_job_id string, title string, location string, description string, apply_url string, "
    "posted_num double, posted_str string"
)
DRAFT = _schema(
    "company_name string, company_website string, title string, apply_url string, description_html string, "
    "location_city string, location_country string, location_is_remote int, location_policy string, comp_min bigint, "
    "comp_max bigint, comp_currency string, ai_specialty string, ai_stack array<string>, customer_email string"
)

NOT_NULL = {
    "companies": ("slug", "name", "created_at"),
    "listings": (
        "company_id", "title", "location_country", "location_is_remote", "location_policy", "ai_stack",
        "description_html", "apply_url", "posted_at", "expires_at", "updated_at", "status",
    ),
    "paid_listings": (
        "listing_id", "stripe_session_id", "stripe_event_id", "tier", "amount_cents", "currency", "customer_email", "paid_at",
    ),
    "runs": ("run", "job", "at_ms", "counters"),
}
UNIQUE = {
    "companies": ("id", "slug"),
    "listings": ("id",),
    "paid_listings": ("id", "stripe_session_id", "stripe_event_id"),
    "runs": ("id",),
}
CHECKS = {
    "companies": {"ats_provider": PROVIDERS, "careers_probe_result": PROBE_RESULTS},
    "listings": {"location_policy": POLICIES, "ai_specialty": SPECIALTIES, "status": STATUSES},
    "paid_listings": {"tier": TIERS},
}
FOREIGN_KEYS = {"listings": ("company_id", "companies"), "paid_listings": ("listing_id", "listings")}
DEFAULTS = {"listings": {"ai_stack": "[]"}, "paid_listings": {"currency": "usd"}}
TABLES = {"companies": COMPANIES, "listings": LISTINGS, "paid_listings": PAID_LISTINGS, "runs": RUNS}
