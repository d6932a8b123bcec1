"""Registered queries: name -> Spark callable, and the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom import cli
from jobloom.functions import detect, docs, html, text, times
from jobloom.operators import constraints, feed, fulfil, ingest, maintain, probe, search
from jobloom.plans import boards, proofs
from jobloom.plans.proofs import page_variant
from jobloom.plans.oracle import SQL
from jobloom.schemas import LISTINGS
from jobloom.sources import companies as directory
from jobloom.sources import fetch, payloads, table_source
from jobloom.sources.shared import fresh_dir
from jobloom.sources.store import TableStore
from jobloom.sources.views import NOW_MS, table, view
from jobloom.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return QUERIES | boards.QUERIES | proofs.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: SQL[name] for name in QUERIES if name in SQL} | boards.SQL | proofs.SQL


def _lc(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "listings_v"), view(spark, sf_dir, "companies_v")


# --- search


@register
def recent_listings_page(spark, sf_dir):
    return search.recent(*_lc(spark, sf_dir), search.Filters(), NOW_MS)


@register
def filtered_listings(spark, sf_dir):
    return search.recent(*_lc(spark, sf_dir), search.read_filters("specialty=infra&remote=1&min_comp=100000"), NOW_MS)


@register
def second_page(spark, sf_dir):
    return search.recent(*_lc(spark, sf_dir), search.Filters(min_comp=50000), NOW_MS, search.PAGE, search.PAGE)


@register
def remote_listings(spark, sf_dir):
    rows = search.matching(view(spark, sf_dir, "listings_v"), search.Filters(remote_only=True), NOW_MS)
    return rows.groupBy("location_policy").agg(F.count("*").alias("n"))


@register
def count_active(spark, sf_dir):
    return search.count_active(*_lc(spark, sf_dir), search.Filters(specialty="nlp"), NOW_MS)


@register
def all_active_feed(spark, sf_dir):
    rows = search.all_active(*_lc(spark, sf_dir), NOW_MS)
    return rows.select("id", docs.feed_row(rows.columns).alias("item"))


@register
def all_feed_pages(spark, sf_dir):
    """Every page of the feed at once, by distributed ranks."""
    return search.feed_pages(search.all_active(*_lc(spark, sf_dir), NOW_MS).select("id", "posted_at"))


@register
def feed_second_page(spark, sf_dir):
    total = search.count_active(*_lc(spark, sf_dir), search.Filters(), NOW_MS).first().n
    return search.feed_page(search.all_active(*_lc(spark, sf_dir), NOW_MS).select("id", "posted_at"), total, 2)


@register
def companies_by_name(spark, sf_dir):
    return search.companies_by_name(view(spark, sf_dir, "companies_v"))


@register
def company_by_slug(spark, sf_dir):
    return search.company_by_slug(view(spark, sf_dir, "companies_v"), "customer-000000042")


@register
def company_active_listings(spark, sf_dir):
    return search.active_of_company(*_lc(spark, sf_dir), "co-7", NOW_MS)


@register
def listing_by_role_slug(spark, sf_dir):
    return search.newest_by_role_slug(*_lc(spark, sf_dir), NOW_MS)


@register
def listing_by_session(spark, sf_dir):
    rows = search.by_session(*_lc(spark, sf_dir), view(spark, sf_dir, "paid_v"))
    return rows.select("id", "title", "company_slug", "stripe_session_id")


@register
def companies_with_careers(spark, sf_dir):
    return search.with_careers(view(spark, sf_dir, "companies_v")).select("id", "slug", "careers_url")


@register
def probe_eligible(spark, sf_dir):
    rows = view(spark, sf_dir, "companies_v").withColumn("careers_url", F.lit(None).cast("string"))
    return search.probe_eligible(rows, NOW_MS).select("id", "slug", "yc_batch")


@register
def headless_eligible(spark, sf_dir):
    rows = view(spark, sf_dir, "companies_v").withColumn("careers_url", F.lit(None).cast("string"))
    return search.headless_eligible(rows, NOW_MS).select("id", "slug", "careers_probe_at")


@register
def batch_filter(spark, sf_dir):
    rows = view(spark, sf_dir, "companies_v").withColumn("careers_url", F.lit(None).cast("string"))
    return search.probe_eligible(rows, NOW_MS, batch="Winter  2024", limit=20).select("id", "slug")


@register
def empty_descriptions(spark, sf_dir):
    return search.empty_descriptions(view(spark, sf_dir, "listings_v"), NOW_MS)


# --- counts


@register
def provider_breakdown(spark, sf_dir):
    rows = view(spark, sf_dir, "companies_v")
    rows = rows.withColumn("ats_provider", detect.detect(F.col("careers_url"))["provider"])
    return ingest.provider_breakdown(rows)


@register
def zero_filled_provider_totals(spark, sf_dir):
    rows = view(spark, sf_dir, "raw_jobs_v")
    return ingest.provider_totals(rows.withColumn("provider", F.when(F.col("provider").isin("waas", "custom"), "lever").otherwise(F.col("provider"))))


@register
def probe_result_counts(spark, sf_dir):
    return maintain.probe_counts(view(spark, sf_dir, "companies_v"))


@register
def headless_result_counts(spark, sf_dir):
    return maintain.headless_counts(view(spark, sf_dir, "companies_v").select(F.col("careers_probe_result").alias("result")).filter("result IS NOT NULL"))


@register
def careers_delta(spark, sf_dir):
    rows = view(spark, sf_dir, "companies_v")
    return maintain.count_delta(rows.filter("careers_probe_result = 'found_ats'"), rows)


# --- scalar functions


@register
def slugify_role(spark, sf_dir):
    return view(spark, sf_dir, "listings_v").select("id", text.slugify(F.col("title")).alias("slug"), text.role_slug(F.col("title"), F.col("id")).alias("role"))


@register
def id_suffix(spark, sf_dir):
    return view(spark, sf_dir, "listings_v").select("id", text.id_suffix(F.col("id")).alias("suffix"))


@register
def format_comp(spark, sf_dir):
    return view(spark, sf_dir, "listings_v").select("id", text.format_comp(F.col("comp_min"), F.col("comp_max"), F.col("comp_currency")).alias("comp"))


@register
def format_location(spark, sf_dir):
    return view(spark, sf_dir, "listings_v").select(
        "id", text.format_location(F.col("location_city"), F.col("location_country"), F.col("location_is_remote"), F.col("location_policy")).alias("place")
    )


@register
def format_posted(spark, sf_dir):
    return view(spark, sf_dir, "listings_v").select("id", times.format_posted(F.col("posted_at")).alias("posted"), times.to_iso(F.col("posted_at")).alias("iso"))


@register
def normalize_location(spark, sf_dir):
    return view(spark, sf_dir, "raw_jobs_v").select("seq", text.parse_location(F.col("location")).alias("p")).select("seq", "p.*")


@register
def normalize_comp(spark, sf_dir):
    said = F.concat("title", F.lit(" "), text.strip_tags(F.col("description")))
    return view(spark, sf_dir, "raw_jobs_v").select("seq", text.parse_compensation(said).alias("p")).select("seq", "p.*")


@register
def ai_stack(spark, sf_dir):
    said = F.concat("title", F.lit(" "), text.strip_tags(F.col("description")))
    return view(spark, sf_dir, "raw_jobs_v").select("seq", text.parse_ai_stack(said).alias("stack"))


@register
def ai_specialty(spark, sf_dir):
    said = F.concat("title", F.lit(" "), text.strip_tags(F.col("description")))
    return view(spark, sf_dir, "raw_jobs_v").select("seq", text.parse_specialty(said).alias("specialty"))


@register
def normalize_jobs(spark, sf_dir):
    return ingest.normalize(view(spark, sf_dir, "raw_jobs_v"), NOW_MS)


@register
def strip_tags_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("said"))


@register
def sanitize_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.sanitize_html(F.col("html")).cast("binary")).alias("digest"))


@register
def decode_named_entities(spark, sf_dir):
    return view(spark, sf_dir, "raw_jobs_v").select("seq", text.decode_entities(F.col("description")).alias("decoded"))


@register
def escape_documents(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.escape_html(F.col("html")).cast("binary")).alias("digest"))


@register
def article_main_content(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.main_content_col(F.col("html")).cast("binary")).alias("digest"))


@register
def detect_ats(spark, sf_dir):
    return view(spark, sf_dir, "companies_v").select("id", detect.detect(F.col("careers_url")).alias("d")).select("id", "d.provider", F.col("d.slug").alias("provider_slug"))


@register
def stored_provider(spark, sf_dir):
    rows = view(spark, sf_dir, "companies_v").withColumn("ats_provider", F.when(F.col("yc_batch").isNull(), "custom").otherwise("lever"))
    return ingest.stored_provider(rows).select("id", "provider", "provider_slug")


@register
def careers_token(spark, sf_dir):
    return view(spark, sf_dir, "raw_jobs_v").select("seq", detect.has_careers_token(F.col("apply_url")).alias("in_url"), detect.has_careers_token(F.col("title")).alias("in_title"))


@register
def workday_posted_on(spark, sf_dir):
    return view(spark, sf_dir, "raw_jobs_v").select("seq", times.parse_posted_on(F.col("posted_str"), NOW_MS).alias("iso"))


@register
def parse_posted_at(spark, sf_dir):
    return view(spark, sf_dir, "raw_jobs_v").select("seq", times.parse_posted_at(F.col("posted_num"), F.col("posted_str"), NOW_MS).alias("posted_at"))


@register
def parse_ai_stack_json(spark, sf_dir):
    return view(spark, sf_dir, "listings_v").select("id", F.to_json(docs.parse_ai_stack(F.col("ai_stack"))).alias("tokens"))


@register
def event_props_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("p"))
    return rows.select("event_id", F.element_at("p", "k").alias("k"))


@register
def draft_chunks_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", docs.encode_chunks(F.col("text")).alias("m"))
    return rows.select("doc_id", F.element_at("m", "draft_chunks").alias("n"), F.md5(docs.decode_chunks(F.col("m")).cast("binary")).alias("digest"))


@register
def jobposting_jsonld(spark, sf_dir):
    rows = search.with_company(*_lc(spark, sf_dir))
    return rows.select("id", docs.job_posting({c: F.col(c) for c in rows.columns}).alias("document"))


@register
def description_to_html(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.description_to_html(F.col("text")).cast("binary")).alias("digest"))


@register
def parse_stack(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.parse_stack(F.col("text")), "|").alias("stack"))


@register
def blacklisted_titles(spark, sf_dir):
    odd = ("Sign In ", "Apply now 2", "See all 12 positions", "  Privacy--Policy", "we're hiring 7", "Jobs 1st", "Folders and files\n3 4")
    seq = F.col("seq")
    title = F.when(seq % 8 == 7, F.col("title"))
    for i, t in enumerate(odd):
        title = title.when(seq % 8 == i, F.concat(F.lit(t), F.when(seq % 3 == 0, F.format_string(" %d", seq)).otherwise("")))
    return view(spark, sf_dir, "raw_jobs_v").select("seq", text.is_blacklisted_title(title).alias("listed"))


@register
def page_ids(spark, sf_dir):
    slug = detect.detect(F.col("careers_url"))["slug"]
    rows = view(spark, sf_dir, "companies_v").select("id", slug.alias("s")).filter("s IS NOT NULL")
    return rows.select("id", text.page_id_of_slug(F.col("s")).alias("page_id"), text.page_url(F.col("s")).alias("page_url"))


@register
def optional_fields(spark, sf_dir):
    return view(spark, sf_dir, "raw_jobs_v").select(
        "seq", text.optional_text(F.col("location"), 6).alias("place"), text.optional_amount((F.col("seq") * 3500).cast("string")).alias("large"),
        text.optional_amount(F.concat(F.lit(" "), F.col("seq").cast("string"), F.lit("k"))).alias("amount"),
    )


# --- tables


@register
def upsert_listings(spark, sf_dir):
    merged = ingest.merged_postings(view(spark, sf_dir, "raw_jobs_v"), NOW_MS)
    return ingest.upsert_merged(view(spark, sf_dir, "listings_v"), merged, NOW_MS)


def _company_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "companies_v")
    key = F.substring_index("id", "-", -1).cast("bigint")
    fresh = rows.filter(key % 3 == 0).withColumns({
        "slug": F.when(key % 6 == 0, F.concat("slug", F.lit("-new"))).otherwise(F.col("slug")), "id": F.concat(F.lit("n-"), "id"),
        "name": F.upper("name"), "careers_url": F.lit("https://new.example.com/careers"),
    })
    return rows, fresh


_COMPANY = ("id", "slug", "name", "website", "careers_url", "created_at")


@register
def upsert_companies_keep_careers(spark, sf_dir):
    return ingest.upsert_companies(*_company_batch(spark, sf_dir), overwrite_careers=False).select(*_COMPANY)


@register
def upsert_companies_overwrite(spark, sf_dir):
    return ingest.upsert_companies(*_company_batch(spark, sf_dir), overwrite_careers=True).select(*_COMPANY)


@register
def sweep_expired(spark, sf_dir):
    return maintain.sweep_expired(view(spark, sf_dir, "listings_v"), NOW_MS).groupBy("status").agg(F.count("*").alias("n"))


@register
def repair_units(spark, sf_dir):
    return maintain.repair_units(view(spark, sf_dir, "listings_v")).select("id", "expires_at")


@register
def unit_counts(spark, sf_dir):
    return maintain.unit_counts(view(spark, sf_dir, "listings_v"))


@register
def backfill_outcome(spark, sf_dir):
    listings = view(spark, sf_dir, "listings_v")
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("https://customer.example.com/jobs/"), F.col("page_id").cast("string")).alias("url"),
        F.when(F.col("page_id") % 7 == 0, 404).when(F.col("page_id") % 11 == 0, 503).otherwise(200).cast("int").alias("status"),
        F.when((F.col("page_id") % 7 == 0) | (F.col("page_id") % 11 == 0), None).otherwise(page_variant(F.col("html"), F.col("page_id"))).alias("html"),
    )
    return maintain.outcome_counts(maintain.backfill_outcomes(listings, pages.unionByName(pages), NOW_MS))


@register
def apply_probe_results(spark, sf_dir):
    rows = view(spark, sf_dir, "companies_v")
    results = rows.filter("yc_batch = 'Fall 2025'").select("id", F.lit(None).cast("string").alias("careers_url"), F.lit(None).cast("string").alias("ats_provider"), F.lit("no_page").alias("result"))
    return maintain.apply_probe_results(rows, results, NOW_MS).select("id", "careers_url", "careers_probe_at", "careers_probe_result")


def _payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as payment events: some repeated, of one session, paid for already, or with a draft that is missing or wrong; by few companies."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'purchase'").withColumnRenamed("event_id", "n")
    k = F.col("user_id") % 40
    # By turns a known company's site, the same with a path, a new company's site, and the same with a path.
    known, new = F.format_string("https://customer-%09d.example.com", k + 1), F.format_string("https://new-%d.example.org", k)
    site = F.when(k % 4 == 0, known).when(k % 4 == 1, F.concat(known, F.lit("/about"))).when(k % 4 == 2, new).otherwise(F.concat(F.format_string("https://new-%d.example.org", k - 1), F.lit("/x")))
    draft = F.struct(
        F.concat(F.lit("New Company "), (k % 5).cast("string")).alias("company_name"), site.alias("company_website"), F.lit("Engineer").alias("title"),
        F.lit("https://example.org/apply").alias("apply_url"), F.lit("<p>x</p>").alias("description_html"), F.lit("").alias("location_city"),
        F.lit("US").alias("location_country"), F.lit(1).alias("location_is_remote"), F.when(F.col("n") % 9 == 4, "moon").otherwise("remote").alias("location_policy"),
        F.array(F.lit("cuda")).alias("ai_stack"), F.lit("a@example.org").alias("customer_email"),
    )
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    session = F.floor(F.col("n") / 2)
    told = F.when(F.col("n") % 9 == 5, F.create_map().cast("map<string,string>")).otherwise(docs.encode_chunks(F.to_json(draft)))
    one = rows.select(
        F.concat(F.lit("evt_"), F.col("n").cast("string")).alias("event_id"), F.when(F.col("n") % 31 == 3, "other").otherwise(fulfil.COMPLETED).alias("type"),
        F.concat(F.when(session % 3 == 0, "cs_").otherwise("cs_p"), session.cast("string")).alias("session_id"), F.lit(None).cast("bigint").alias("amount_total"),
        F.lit(None).cast("string").alias("currency"),
        F.map_concat(told, F.create_map(F.lit("tier"), F.when(F.col("n") % 2 == 0, "founding").otherwise("standard"))).alias("metadata"),
        ms.alias("paid_at"),
    )
    return one.unionByName(one.filter(F.col("paid_at") % 3 == 0))


@register
def fulfil_paid(spark, sf_dir):
    done = fulfil.fulfil(view(spark, sf_dir, "companies_v"), view(spark, sf_dir, "paid_v"), fulfil.payment_fields(_payments(spark, sf_dir)))
    paid = done.paid.select("id", "stripe_event_id", "listing_id", "tier", "amount_cents", "currency", "paid_at")
    own = done.listings.select(F.col("id").alias("listing_id"), "company_id", "expires_at", "location_city")
    names = done.companies.select(F.col("id").alias("company_id"), "slug")
    rows = paid.join(own, "listing_id").join(names, "company_id", "left")
    return rows.select("id", "listing_id", "stripe_event_id", "tier", "amount_cents", "currency", "paid_at", "expires_at", F.when(F.col("slug").isNull(), F.col("company_id")).alias("known_company"), "slug")


@register
def fulfil_results(spark, sf_dir):
    done = fulfil.fulfil(view(spark, sf_dir, "companies_v"), view(spark, sf_dir, "paid_v"), fulfil.payment_fields(_payments(spark, sf_dir)))
    return done.results.groupBy("result").agg(F.count("*").alias("n"))


@register
def streamed_payments(spark, sf_dir):
    """Payment events as a stream, delivered twice and fulfilled once, in a store that holds the companies alone."""
    store = TableStore(spark, fresh_dir(spark, "store"))
    store.write("companies", view(spark, sf_dir, "companies_v"))
    landed = fresh_dir(spark, "events")
    _payments(spark, sf_dir).write.json(landed)
    for _ in range(2):
        stream = events.fulfil_stream(store, events.read_events(spark, landed), fresh_dir(spark, "stream"))
        stream.trigger(availableNow=True).start().awaitTermination()
    return store.read("paid_listings").select("stripe_event_id", "stripe_session_id", "tier", "paid_at")


@register
def stored_upsert(spark, sf_dir):
    """Listings in buckets under the commit log: written, upserted from postings, swept and read back."""
    store = TableStore(spark, fresh_dir(spark, "store"), bucket_rows=2_000)
    store.write("companies", view(spark, sf_dir, "companies_v"))
    store.write("listings", view(spark, sf_dir, "listings_v").filter("expires_at >= 10000000000"))
    merged = ingest.merged_postings(view(spark, sf_dir, "raw_jobs_v"), NOW_MS)

    def work(t):
        t.upsert("listings", ingest.changed_listings(t.rows_of("listings", merged.select("id")), merged, NOW_MS))
        t.upsert("listings", maintain.swept(t.read("listings"), NOW_MS))

    store.transact(work)
    return store.read("listings").select("id", "company_id", "title", "status", "expires_at", "updated_at")


@register
def sql_search(spark, sf_dir):
    """A search in SQL alone over the stored tables: folders pruned by the manifest, the library's rules as SQL functions."""
    store = TableStore(spark, fresh_dir(spark, "store"), bucket_rows=5_000)
    store.write("companies", view(spark, sf_dir, "companies_v"))
    store.write("listings", view(spark, sf_dir, "listings_v"), check=False)
    table_source.views(spark, store.root, prefix="stored_")
    return spark.sql(f"""
      SELECT l.id, jobloom_job_path(c.slug, title, l.id) AS path, jobloom_normalized_batch(yc_batch) AS batch, jobloom_repair_unit(expires_at) AS expires_at,
             jobloom_format_comp(comp_min, comp_max, comp_currency) AS pay, jobloom_format_location(location_city, location_country, location_is_remote, location_policy) AS place
      FROM stored_listings l JOIN stored_companies c ON c.id = company_id WHERE status = 'active' AND expires_at > {NOW_MS}""")


@register
def frontier_states(spark, sf_dir):
    """What is still to be asked for, by a log of answers and failures made of the events."""
    k = F.col("event_id")
    urls = table(spark, sf_dir, "events").select(F.concat(F.lit("https://H"), k % 50, F.lit(".com/"), k).alias("url"))
    tries = F.when(k % 3 == 0, 0).when(k % 3 == 1, 1).otherwise(k % 6).cast("int")
    log = table(spark, sf_dir, "events").withColumn("try", F.explode(F.sequence(F.lit(0), tries))).filter("try > 0")
    log = log.select(F.concat(F.lit("https://H"), k % 50, F.lit(".com/"), k).alias("url"), F.when(k % 3 == 1, 200).alias("status"), (F.lit(NOW_MS) + F.col("try")).alias("landed_at"))
    return fetch.frontier(urls, log)


@register
def runs_of_jobs(spark, sf_dir):
    """Two jobs over a store of the views, and what each left in `runs`, in the commit that made its tables."""
    store = TableStore(spark, fresh_dir(spark, "store"))
    store.write("companies", view(spark, sf_dir, "companies_v"))
    store.write("listings", view(spark, sf_dir, "listings_v"), check=False)
    for job in ("repair", "sweep"):
        cli.main([job, "--store", store.root, "--now-ms", str(NOW_MS), "--run", "day"], spark)
    return store.read("runs").select("id", "job", "base", "counters")


@register
def payment_errors(spark, sf_dir):
    """What is wrong with the events that can't be fulfilled."""
    return fulfil.payment_fields(_payments(spark, sf_dir)).groupBy("error").agg(F.count("*").alias("n"))


@register
def founding_tier(spark, sf_dir):
    return fulfil.founding_tier(view(spark, sf_dir, "paid_v"))


@register
def founding_slots(spark, sf_dir):
    """Seats left after the sold listings, and after as many sales as there are nations."""
    sold = [fulfil.seats_left(rows).withColumn("after", F.lit(name)) for name, rows in (("paid", view(spark, sf_dir, "paid_v")), ("nation", table(spark, sf_dir, "nation")))]
    return sold[0].unionByName(sold[1])


@register
def fk_violations(spark, sf_dir):
    paid = view(spark, sf_dir, "paid_v").withColumn("listing_id", F.when(F.col("amount_cents") == 19900, F.concat("listing_id", F.lit("x"))).otherwise(F.col("listing_id")))
    return constraints.orphans(paid, "listing_id", view(spark, sf_dir, "listings_v")).select("id", "listing_id")


@register
def cascade_delete(spark, sf_dir):
    gone = view(spark, sf_dir, "companies_v").filter("yc_batch IS NULL")
    return constraints.cascade(view(spark, sf_dir, "listings_v"), "company_id", gone).agg(F.count("*").alias("n"))


@register
def check_violations(spark, sf_dir):
    rows = view(spark, sf_dir, "listings_v").withColumn("location_policy", F.when(F.col("comp_equity").isNull(), F.col("location_policy")).otherwise("moon"))
    return constraints.check_violations(rows, "listings")


@register
def duplicate_keys(spark, sf_dir):
    rows = ingest.normalize(view(spark, sf_dir, "raw_jobs_v"), NOW_MS)
    return constraints.duplicate_keys(rows, "id")


# --- connectors, page parsing and probes on landed payloads made of the tables


@register
def greenhouse_jobs(spark, sf_dir):
    """Postings of a board's landed list, one list for each company."""
    rows = view(spark, sf_dir, "raw_jobs_v")
    job = F.struct(F.col("seq").alias("id"), "title", F.struct(F.col("location").alias("name")).alias("location"), F.col("description").alias("content"),
                   F.col("apply_url").alias("absolute_url"), F.lit("2026-04-10").alias("updated_at"))
    lists = rows.groupBy(F.col("company_id").alias("slug")).agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("body"))
    found = payloads.greenhouse(lists)
    return found.select("provider_slug", "provider_job_id", "title", "location", "description", "posted_str")


@register
def custom_jobs(spark, sf_dir):
    """Postings that a company's own page states, links or pairs."""
    rows = view(spark, sf_dir, "raw_jobs_v").filter("provider = 'custom'")
    card = F.format_string('<div><h3>%s</h3><span>%s</span><a href="/jobs/%d">More</a></div>', text.escape_html(F.col("title")), text.escape_html(F.coalesce("location", F.lit(""))), F.col("seq"))
    pages = rows.select(F.format_string("https://c%d.example.com/careers", F.col("seq")).alias("slug"), F.concat(F.lit("<html><body>"), card, F.lit("</body></html>")).alias("html"))
    return payloads.custom(pages).select("provider_slug", "title", "location", "apply_url")


@register
def jsonld_jobs(spark, sf_dir):
    rows = view(spark, sf_dir, "raw_jobs_v").filter("provider = 'custom'")
    node = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), "title", F.col("apply_url").alias("url"), F.lit("2026-04-10").alias("datePosted"), F.col("seq").cast("string").alias("description")))
    page = F.concat(F.lit('<script type="application/ld+json">{"@graph": ['), node, F.lit("]}</script>"))
    return payloads.custom(rows.select(F.lit("https://customer.example.com/careers").alias("slug"), page.alias("html"))).select("title", "apply_url", "description", "posted_str")


@register
def notion_jobs(spark, sf_dir):
    rows = view(spark, sf_dir, "raw_jobs_v").filter("provider = 'notion'")
    block_id = F.regexp_replace(F.md5(F.col("seq").cast("string").cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    value = F.to_json(F.struct(F.lit("page").alias("type"), F.lit("collection").alias("parent_table"), F.struct(F.array(F.array("title")).alias("title")).alias("properties")))
    body = F.concat(F.lit('{"recordMap": {"block": {"'), block_id, F.lit('": {"value": {"value": '), value, F.lit("}}}}}"))
    pages = rows.select(F.col("seq").cast("string").alias("slug"), F.lit("<html></html>").alias("html"))
    return payloads.notion(pages, rows.select(F.col("seq").cast("string").alias("slug"), body.alias("body"))).select("provider_slug", "provider_job_id", "title", "apply_url")


@register
def robots_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    body = F.format_string("User-agent: *\nDisallow: /fr/*/x$\nDisallow: /%d\n\nUser-agent: other\nDisallow: /", F.col("page_id") % 10)
    path = F.regexp_extract("url", "^[a-z]+://[^/]*([^?#]*)", 1)
    return rows.select("page_id", html.allowed_by_robots(html.robots_rules_col(body), F.concat(F.lit("/"), F.col("page_id").cast("string"))).alias("by_id"), html.allowed_by_robots(html.robots_rules_col(body), path).alias("by_path"))


@register
def careers_probe(spark, sf_dir):
    """The probe over homepages that link to a board, to a careers page, or to nothing."""
    rows = view(spark, sf_dir, "companies_v")
    companies = rows.select("id", "slug", "website")
    sites = rows.filter("website LIKE 'https%'").withColumn("k", F.substring_index("id", "-", -1).cast("bigint") % 4)
    body = F.when(F.col("k") == 0, F.concat(F.lit('<a href="https://jobs.lever.co/'), "slug", F.lit('">Jobs</a>'))).when(F.col("k") == 1, '<a href="/about">About</a>').otherwise("<p>Hello</p>")
    home = sites.filter("k < 3").select(F.concat("website", F.lit("/")).alias("url"), F.lit(None).cast("string").alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), body.alias("body"))
    careers = sites.filter("k = 1").select(F.concat("website", F.lit("/careers")).alias("url"), F.lit(None).cast("string").alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit("<h1>Open positions</h1>").alias("body"))
    number = F.substring_index("id", "-", -1).cast("bigint")
    robots = sites.select(F.col("website").alias("origin"), F.when(number % 5 == 0, 404).otherwise(200).alias("status"),
                          F.when(number % 3 == 0, "User-agent: *\nDisallow: /careers$ # not this\n").otherwise("User-agent: jobloom\nDisallow:\n\nUser-agent: *\nDisallow: /").alias("body"))
    found = probe.probe(companies, home.unionByName(careers), robots)
    return found.select("id", "careers_url", "ats_provider", "result", F.array_join("checked", " ").alias("checked"), "html_size")


@register
def provider_dispatch(spark, sf_dir):
    """Postings of all boards normalized and counted by provider, as one plan."""
    jobs = ingest.long_enough(ingest.normalize(view(spark, sf_dir, "raw_jobs_v"), NOW_MS))
    assert [f.name for f in LISTINGS.fields] == [c for c in jobs.columns if c != "seq"]
    return ingest.provider_totals(jobs.select(F.substring_index("id", ":", 1).alias("provider")))


@register
def company_routes(spark, sf_dir):
    return feed.company_routes(view(spark, sf_dir, "companies_v"))


@register
def sitemap_dates(spark, sf_dir):
    """Dates of the pages of a site map that holds every listing, active or not, with a slash at the end of some."""
    listings, companies = _lc(spark, sf_dir)
    site = "https://jobs.example.com"
    rows = search.with_company(listings, companies, ("id", "company_id", "title"))
    path = text.job_path(F.col("company_slug"), F.col("title"), F.col("id"))
    urls = rows.select(F.concat(F.lit(site), path, F.when(F.col("id").endswith("1"), "/").otherwise("")).alias("url"))
    return feed.sitemap(urls, feed.job_dates(listings, companies, site, NOW_MS))


@register
def foreign_board_urls(spark, sf_dir):
    rows = view(spark, sf_dir, "listings_v")
    url = F.when(F.col("comp_equity").isNull(), F.lit("https://x.com/COMPANIES/a/jobs/1")).when(F.col("ai_specialty").isNull(), "https://WorkAtAStartup.com/companies/a/jobs/1").otherwise(F.col("apply_url"))
    return feed.foreign_board_urls(rows.withColumn("apply_url", url))


@register
def quarantined_payloads(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("slug"), F.when(F.col("event_id") % 5 == 0, "oops").when(F.col("event_id") % 7 == 0, None).otherwise(F.col("props")).alias("body"))
    return feed.quarantined(rows)


@register
def website_candidates(spark, sf_dir):
    return payloads.website_candidates(view(spark, sf_dir, "companies_v").filter("website LIKE 'https%'"))


@register
def board_jobs(spark, sf_dir):
    """Postings of a board's feed, where it has one, else of what the company's website embeds."""
    rows = view(spark, sf_dir, "raw_jobs_v").filter("provider = 'waas'")
    slug = F.format_string("c%d", F.col("seq"))
    job = F.struct(F.col("seq").alias("id"), "title", "location", F.col("description"))
    feeds = rows.filter("seq % 2 = 0").select(slug.alias("slug"), F.to_json(F.array(job)).alias("body"))
    data = F.to_json(F.struct(F.struct(F.struct(slug.alias("slug"), F.array(job).alias("jobs")).alias("company")).alias("props")))
    page = F.concat(F.lit('<link href="workatastartup.com"><div data-page="'), text.escape_html(data), F.lit('" id="app"></div>'))
    sites = rows.filter("seq % 4 = 1").select(slug.alias("slug"), page.alias("html"))
    boards_ = rows.select(slug.alias("slug"), page.alias("html"))
    found = payloads.waas(feeds, sites, boards_)
    return found.select("provider_slug", "provider_job_id", "title", "location", "apply_url")
