"""Paid postings: each event is fulfilled once, in order of (paid_at, event_id), as one batch over three tables.

An event that is paid for already, or repeats an event or a session of the batch, is a duplicate and writes nothing. Its
company is found by the website as it stands or by scheme and host; companies that the batch makes are found by later
events too. Ids follow from the event's id, so the same batch makes the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions import docs
from jobloom.functions.text import let, slugify, truthy
from jobloom.operators import ranks
from jobloom.schemas import COMPANIES, LISTINGS, PAID_LISTINGS, THIRTY_DAYS_MS, TIERS
from jobloom.sources.shared import materialize

FOUNDING_CENTS, STANDARD_CENTS, FOUNDING_SEATS = 19900, 29900, 50
COMPLETED = "checkout.session.completed"
#: Slugs of one root that a task may number.
ROOT_ROWS = 100_000


def price(tier: Column) -> Column:
    return F.when(tier == "founding", FOUNDING_CENTS).otherwise(STANDARD_CENTS).cast("bigint")


def seats_left(paid: DataFrame) -> DataFrame:
    return paid.agg(F.greatest(F.lit(0), FOUNDING_SEATS - F.count("*")).cast("bigint").alias("seats_left"))


def founding_tier(paid: DataFrame) -> DataFrame:
    """The tier by order of payment: the first FOUNDING_SEATS are founding. Only those are ranked, by a top-k."""
    first = paid.select("id", "paid_at", "stripe_event_id").orderBy("paid_at", "stripe_event_id").limit(FOUNDING_SEATS)
    first = first.select("id", F.lit("founding").alias("_tier"))
    return paid.join(F.broadcast(first), "id", "left").select("id", F.coalesce("_tier", F.lit("standard")).alias("tier_by_order"))


def payment_fields(events: DataFrame) -> DataFrame:
    """Events (event_id, type, session_id, amount_total, currency, metadata, paid_at) that complete a session, with their draft.

    draft is decoded from the metadata; error says what is wrong with it, and such events are not fulfilled.
    """
    rows = events.filter(F.col("type") == COMPLETED)
    tier = F.element_at("metadata", "tier")
    tier = F.when(tier.isin(*TIERS), tier).otherwise("standard")
    amount = F.coalesce(F.col("amount_total"), F.element_at("metadata", "amount_cents").try_cast("bigint"), price(tier))
    read = lambda text: F.struct(
        docs.parse_draft(text).alias("draft"), F.coalesce(F.when(text.isNull(), "missing draft"), docs.draft_error(text)).alias("error")
    )
    rows = rows.withColumn("read", let(docs.decode_chunks(F.col("metadata")), read))
    return rows.select(
        "event_id", "session_id", tier.alias("tier"), amount.alias("amount_cents"), F.coalesce("currency", F.lit("usd")).alias("currency"),
        F.col("read.draft").alias("draft"), F.col("read.error").alias("error"), "paid_at",
    )


def _made_id(prefix: str, event_id: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat(F.lit(prefix), event_id), 256), 1, 32))


def new_events(events: DataFrame, paid: DataFrame) -> DataFrame:
    """events with `fresh`: whether the event is the first of its event id and session, and neither is paid for."""
    rows = events.withColumn("at", F.struct("paid_at", "event_id"))
    known = paid.select(F.col("stripe_event_id").alias("event_id")).distinct().withColumn("_paid", F.lit(True))
    sessions = paid.select(F.col("stripe_session_id").alias("session_id")).distinct().withColumn("_session", F.lit(True))
    one = rows.groupBy("event_id").agg(F.min_by(F.struct(*rows.columns), "at").alias("r"), F.count("*").alias("times"))
    one = one.select("r.*", "times").join(known, "event_id", "left").join(sessions, "session_id", "left")
    open_ = one.filter(F.col("_paid").isNull() & F.col("_session").isNull())
    first = open_.groupBy("session_id").agg(F.min("at").alias("first_at"))
    return one.join(first, "session_id", "left").withColumn(
        "fresh", F.col("_paid").isNull() & F.col("_session").isNull() & F.col("at").eqNullSafe(F.col("first_at"))
    ).drop("_paid", "_session", "first_at")


def match_companies(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """rows (website, site: its scheme and host) with the id of the company that has either: two equi-joins, not one on OR."""
    own = companies.filter("website IS NOT NULL")
    by_raw = own.groupBy("website").agg(F.min("id").alias("_by_raw"))
    by_site = own.groupBy(F.lower("website").alias("site")).agg(F.min("id").alias("_by_site"))
    found = rows.join(by_raw, "website", "left").join(by_site, "site", "left")
    return found.withColumn("found_id", F.least("_by_raw", "_by_site")).drop("_by_raw", "_by_site")


def _placed(rows: DataFrame, order: list[Column], spread: bool) -> DataFrame:
    """rows with place, from 0, within their root."""
    if spread:
        return ranks.ranked(rows, order, ["root"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(*order)).cast("bigint") - 1)


def _passed(rows: DataFrame, spread: bool) -> DataFrame:
    """rows (root, place, used: 1 or 0) with passed, the used ones before a row; used ones come first of a place."""
    order = [F.col("place"), F.col("used").desc()]
    if spread:
        return ranks.running(rows, "used", order, ["root"], "passed")
    before = Window.partitionBy("root").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("passed", F.coalesce(F.sum("used").over(before), F.lit(0)))


def unique_slugs(wanted: DataFrame, taken: DataFrame, root_rows: int = ROOT_ROWS) -> DataFrame:
    """wanted (id, root, at) with slug: root, root-2, root-3 and so on, the first free ones in order of `at`.

    taken: column slug. A number that another root's slug takes is passed over in a further round. Where a root has more
    than root_rows wanted and taken slugs, places come from ranges of its rows, so that no task holds them all.
    """
    done, rest = None, wanted
    pattern = r"^(.*?)(?:-([0-9]+))?\z"
    for _ in range(20):
        used = taken.select("slug", F.regexp_extract("slug", pattern, 1).alias("stem"), F.regexp_extract("slug", pattern, 2).try_cast("bigint").alias("number"))
        used = used.select(F.col("stem").alias("root"), "number").filter("number >= 2").union(taken.select(F.col("slug").alias("root"), F.lit(1).cast("bigint"))).distinct()
        used = used.join(rest.select("root").distinct(), "root", "left_semi")
        # `place` counts the free numbers below a used one, and the wanted slugs before one: each wanted slug passes over
        # the used numbers whose place is not beyond its own.
        spread = not rest.union(used.select(F.lit(""), "root", F.lit(None))).groupBy("root").count().filter(F.col("count") > root_rows).isEmpty()
        used = _placed(used, [F.col("number")], spread).select("root", (F.col("number") - F.col("place") - 1).alias("place"), F.lit(1).cast("bigint").alias("used"))
        ranked = _placed(rest, [F.col("at"), F.col("id")], spread).withColumn("used", F.lit(0).cast("bigint"))
        named = _passed(used.unionByName(ranked, allowMissingColumns=True), spread).withColumn("number", F.col("place") + 1 + F.col("passed")).filter("used = 0")
        named = named.select("id", "root", "at", F.when(F.col("number") == 1, F.col("root")).otherwise(F.concat_ws("-", "root", F.col("number").cast("string"))).alias("slug"))
        best = named.groupBy("slug").agg(F.min("at").alias("best"))
        named = materialize(named.join(best, "slug").withColumn("ok", F.col("at") == F.col("best")), "slugs")
        good = named.filter("ok").select("id", "root", "at", "slug")
        done = good if done is None else done.union(good)
        rest = named.filter("NOT ok").select("id", "root", "at")
        if rest.isEmpty():
            return done
        taken = taken.select("slug").union(good.select("slug"))
    raise RuntimeError("slugs did not settle")


@dataclass
class Fulfilled:
    companies: DataFrame  # rows to add
    listings: DataFrame
    paid: DataFrame
    results: DataFrame  # event_id, result: inserted or duplicate


def fulfil(companies: DataFrame, paid: DataFrame, payments: DataFrame) -> Fulfilled:
    """What payments (see payment_fields) add to the tables. Payments with an error are left out."""
    rows = materialize(new_events(materialize(payments.filter("error IS NULL"), "payments"), paid), "events")
    fresh = rows.filter("fresh").withColumn("website", F.col("draft.company_website"))
    fresh = match_companies(fresh.withColumn("site", docs.website_of_draft(F.col("website"))), companies)
    # A company that the batch makes has the website of the event that made it. Events match it by equal text, or where
    # the text in lower case is their scheme and host.
    lost = fresh.filter("found_id IS NULL")
    raw_first = lost.groupBy("website").agg(F.min("at").alias("raw_at"))
    site_first = lost.filter(F.lower("website") == F.col("site")).groupBy("site").agg(F.min("at").alias("site_at"))
    placed = fresh.join(raw_first, "website", "left").join(site_first, "site", "left")
    maker = F.when(F.col("site_at").isNull() | (F.col("raw_at") < F.col("site_at")), F.col("raw_at")).otherwise(F.col("site_at"))
    placed = placed.withColumn("maker", maker["event_id"])
    placed = materialize(placed.withColumn("company_id", F.coalesce("found_id", _made_id("cmp", F.col("maker")))), "placed")
    makers = placed.filter(F.col("found_id").isNull() & (F.col("maker") == F.col("event_id")))
    wanted = makers.select(F.col("company_id").alias("id"), F.coalesce(truthy(slugify(F.col("draft.company_name"))), F.lit("company")).alias("root"), "at")
    slugs = unique_slugs(wanted, companies.select("slug")).select("id", "slug")
    made = makers.select(
        F.col("company_id").alias("id"), F.col("draft.company_name").alias("name"), "website", F.col("paid_at").alias("created_at")
    ).join(slugs, "id")
    none = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    made = made.select(*[F.col(f.name) if f.name in made.columns else none(f) for f in COMPANIES.fields])
    d = F.col("draft")
    listing = {
        "id": _made_id("lst", F.col("event_id")), "company_id": F.col("company_id"), "ai_stack": F.to_json(d["ai_stack"]), "posted_at": F.col("paid_at"),
        "expires_at": F.col("paid_at") + THIRTY_DAYS_MS, "updated_at": F.col("paid_at"), "status": F.lit("active"), "comp_equity": F.lit(None),
        "ai_compute_access": F.lit(None),
    }
    listings = placed.select(*[(listing[f.name] if f.name in listing else d[f.name]).cast(f.dataType).alias(f.name) for f in LISTINGS.fields])
    bought = {
        "id": _made_id("pay", F.col("event_id")), "listing_id": _made_id("lst", F.col("event_id")), "stripe_session_id": F.col("session_id"),
        "stripe_event_id": F.col("event_id"), "customer_email": d["customer_email"],
    }
    new_paid = placed.select(*[(bought[f.name] if f.name in bought else F.col(f.name)).cast(f.dataType).alias(f.name) for f in PAID_LISTINGS.fields])
    results = rows.select("event_id", F.when(F.col("fresh"), "inserted").otherwise("duplicate").alias("result"))
    return Fulfilled(made, listings, new_paid, results)


def into(t, payments: DataFrame) -> dict[str, int]:
    """Fulfils payments in a transaction of the table store: new companies, listings and payments, or none of them.

    Returns how many events were inserted, and how many were duplicates.
    """
    done = fulfil(t.read("companies"), t.read("paid_listings"), payments)
    counts = {r.result: r.n for r in done.results.groupBy("result").agg(F.count("*").alias("n")).collect()}
    if counts.get("inserted"):
        for name, rows in (("companies", done.companies), ("listings", done.listings), ("paid_listings", done.paid)):
            t.upsert(name, rows)
    return counts
