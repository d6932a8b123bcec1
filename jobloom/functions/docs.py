"""Native column expressions over JSON: stack lists, draft chunks, the draft's shape, and structured data for listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import js_trim, let, truthy
from jobloom.functions.times import to_iso
from jobloom.schemas import DRAFT, POLICIES, SPECIALTIES

CHUNK = 450


def parse_ai_stack(value: Column) -> Column:
    """The non-empty strings of a JSON array; anything else gives an empty array."""
    items = F.from_json(value, "array<variant>")
    strings = F.filter(items, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    values = F.filter(F.transform(strings, lambda v: v.cast("string")), lambda s: s != "")
    return F.coalesce(values, F.array().cast("array<string>"))


def encode_chunks(text: Column, size: int = CHUNK) -> Column:
    """map<string, string> of a text's slices d0, d1, ... and their number, draft_chunks."""
    n = F.ceil(F.length(text) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    keys = F.concat(F.transform(at, lambda i: F.concat(F.lit("d"), i.cast("string"))), F.array(F.lit("draft_chunks")))
    parts = F.concat(F.transform(at, lambda i: F.substring(text, i * size + 1, F.lit(size))), F.array(n.cast("string")))
    return F.map_from_arrays(keys, parts)


def decode_chunks(meta: Column) -> Column:
    """The text of encode_chunks; null where the number or a chunk is missing."""
    n = F.regexp_extract(F.element_at(meta, "draft_chunks"), r"^\s*([0-9]+)", 1).try_cast("int")
    parts = lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(meta, F.concat(F.lit("d"), i.cast("string"))))
    joined = lambda parts: F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))
    return let(n, lambda n: let(F.when(n > 0, parts(n)), joined))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def draft_error(text: Column) -> Column:
    """The first thing wrong with a decoded draft, or null."""
    return let(F.try_parse_json(text), lambda root: _draft_error(text, root))


def _draft_error(text: Column, root: Column) -> Column:
    # The messages below.
    get = lambda key: F.try_variant_get(root, f"$.{key}", "variant")
    is_text = lambda key: _kind(get(key)) == "STRING"
    says = lambda key: F.try_variant_get(root, f"$.{key}", "string")
    number = lambda key: _kind(get(key)).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)")
    none = lambda key: _kind(get(key)) == "VOID"
    needed = lambda key: (~(is_text(key) & (F.coalesce(says(key), F.lit("")) != "")), f"draft.{key} must be a non-empty string")
    stack = F.from_json(text, "struct<ai_stack: array<variant>>")["ai_stack"]
    checks = [
        (root.isNull() | ~_kind(root).startswith("OBJECT"), "decoded draft is not an object"),
        needed("location_policy"),
        (~says("location_policy").isin(*POLICIES), "draft.location_policy invalid"),
        (~(number("location_is_remote") & F.coalesce(F.try_variant_get(root, "$.location_is_remote", "double").isin(0.0, 1.0), F.lit(False))), "draft.location_is_remote must be 0 or 1"),
        (~_kind(get("ai_stack")).startswith("ARRAY") | F.exists(stack, lambda v: _kind(v) != "STRING"), "draft.ai_stack must be a string[]"),
        (~none("ai_specialty") & ~(is_text("ai_specialty") & F.coalesce(says("ai_specialty").isin(*SPECIALTIES), F.lit(False))), "draft.ai_specialty invalid"),
        *[needed(k) for k in ("company_name", "company_website", "title", "apply_url", "description_html")],
        (~none("location_city") & ~is_text("location_city"), "draft.location_city must be a string or null"),
        needed("location_country"),
        *[(~none(k) & ~number(k), f"draft.{k} must be a finite number or null") for k in ("comp_min", "comp_max")],
        (~none("comp_currency") & ~is_text("comp_currency"), "draft.comp_currency must be a string or null"),
        needed("customer_email"),
    ]
    out = None
    for wrong, message in checks:
        wrong = F.coalesce(wrong, F.lit(True))
        out = F.when(wrong, message) if out is None else out.when(wrong, message)
    return out


def parse_draft(text: Column) -> Column:
    """The draft as a struct; empty optional strings are null."""
    def read(d: Column) -> Column:
        for name in ("location_city", "comp_currency"):
            d = d.withField(name, truthy(d[name]))
        return d

    return let(F.from_json(text, DRAFT), read)


def form_error(form: dict[str, Column]) -> Column:
    """What is wrong with a trimmed form, the first fault only; null where it is fine."""
    # The messages below.
    filled = [truthy(form[k]).isNotNull() for k in ("company_name", "company_website", "customer_email", "title", "apply_url", "description", "location_country")]
    all_filled = F.lit(True)
    for f in filled:
        all_filled = all_filled & f
    return (
        F.when(~all_filled, "Please fill in every required field.")
        .when(~form["company_website"].rlike("(?i)^https?://"), "Company website must start with http(s)://.")
        .when(~form["customer_email"].rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"), "Billing email looks invalid.")
        .when(~is_web_url(form["apply_url"]), "Apply URL must be a valid http(s) link.")
        .when(~form["location_policy"].isin(*POLICIES), "Pick a valid location policy.")
        .when(truthy(form["ai_specialty"]).isNotNull() & ~form["ai_specialty"].isin(*SPECIALTIES), "Pick a valid AI specialty.")
    )


def is_web_url(url: Column) -> Column:
    """An absolute http or https URL with a host."""
    return js_trim(url).rlike(r"(?i)^https?:/*[^/\\?#\s]+(?:[/\\?#]|\z)")


def website_of_draft(url: Column) -> Column:
    """Scheme and host in lower case, without port and path; what is no URL, in lower case."""
    pattern = r"^(?i)([a-z][a-z0-9+.-]*):/*(?:[^/?#@]*@)?([^/?#:]+)"
    return F.when(
        url.rlike(pattern), F.concat(F.lower(F.regexp_extract(url, pattern, 1)), F.lit("://"), F.lower(F.regexp_extract(url, pattern, 2)))
    ).otherwise(F.lower(url))


def job_posting(r: dict[str, Column]) -> Column:
    """Structured data of a listing as JSON; absent parts are left out. r: the columns of a listing with its company."""
    site = truthy(js_trim(r["company_website"]))
    organization = F.struct(F.lit("Organization").alias("@type"), r["company_name"].alias("name"), site.alias("sameAs"))
    country = truthy(r["location_country"])
    place = F.when(
        (r["location_is_remote"] == 0) & country.isNotNull() & (country != "Unknown"),
        F.struct(
            F.lit("Place").alias("@type"),
            F.struct(F.lit("PostalAddress").alias("@type"), r["location_city"].alias("addressLocality"), country.alias("addressCountry")).alias("address"),
        ),
    )
    value = F.struct(
        F.lit("QuantitativeValue").alias("@type"), F.lit("YEAR").alias("unitText"), r["comp_min"].alias("minValue"), r["comp_max"].alias("maxValue")
    )
    salary = F.when(
        r["comp_min"].isNotNull() | r["comp_max"].isNotNull(),
        F.struct(F.lit("MonetaryAmount").alias("@type"), value.alias("value"), truthy(r["comp_currency"]).alias("currency")),
    )
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"), F.lit("JobPosting").alias("@type"), r["title"].alias("title"),
            r["description_html"].alias("description"), to_iso(r["posted_at"]).alias("datePosted"), to_iso(r["expires_at"]).alias("validThrough"),
            organization.alias("hiringOrganization"), place.alias("jobLocation"),
            F.when(r["location_is_remote"] != 0, "TELECOMMUTE").alias("jobLocationType"), salary.alias("baseSalary"),
            F.lit("FULL_TIME").alias("employmentType"),
        )
    )


def feed_row(columns: list[str]) -> Column:
    """A row of the feed as JSON, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
