"""Batch jobs over a table store: python -m jobloom.cli <job> --store <folder> [options]. Each prints a line of JSON.

A job is one transaction: what it writes to any table, and a row of `runs` with its counters, become visible in one commit
or not at all. Where another writer commits in between, the job is done again on the new base. Counters come from the plans
that write, not from a second evaluation. Lists of unbounded length (due companies, URLs to render, boards of a run) are
written as tables beside the store's own; the line of JSON holds counts, and the first SHOWN entries.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import docs
from jobloom.operators import dispatch, fulfil, ingest, maintain, probe, search
from jobloom.schemas import PROBE_RESULTS, PROVIDERS, RUNS
from jobloom.session import prepare
from jobloom.sources import companies as directory
from jobloom.sources import fetch
from jobloom.sources.shared import materialize
from jobloom.sources.store import TableStore, Transaction
from jobloom.streaming.events import EVENT_SCHEMA

SHOWN = 100


def _landed(t: Transaction, args: argparse.Namespace, name: str, schema: str) -> DataFrame:
    """A landed table in the folder --landed; empty where it isn't there."""
    spark, where = t.spark, f"{args.landed.rstrip('/')}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(where)


def _beside(t: Transaction, args: argparse.Namespace, name: str, rows: DataFrame) -> None:
    """A table of this run, beside the store's own: written again when the run is."""
    if not args.dry_run:
        rows.write.mode("overwrite").parquet(f"{t.store.root}/{name}/run={args.run}")


def _listed(t: Transaction, args: argparse.Namespace, name: str, rows: DataFrame, column: str) -> list:
    """Writes ordered rows beside the store, and gives a column of the first ones."""
    rows = materialize(rows.limit(args.limit) if args.limit else rows, name)
    _beside(t, args, name, rows)
    return [r[0] for r in rows.select(column).limit(SHOWN).collect()]


def _of_each(column: str, values: tuple[str, ...]) -> dict:
    """Aggregates that count a column's values, by value."""
    return {v: F.count_if(F.col(column) == v) for v in values}


def seed(t: Transaction, now_ms: int, args: argparse.Namespace) -> dict:
    """Curated companies, and the landed directory batches in --batches."""
    put = lambda batch, own: t.upsert("companies", ingest.upsert_companies(t.read("companies"), batch, own, only_changed=True))
    put(directory.curated(t.spark, now_ms), True)
    if args.batches:
        put(directory.ai_companies(directory.read_batches(t.spark, args.batches), now_ms), False)
    return {"companies": t.rows("companies")}


def _upserted(t: Transaction, jobs: DataFrame, now_ms: int) -> dict[str, int]:
    """Postings normalized and upserted; the stored rows that are read are those of the buckets that their ids fall into."""
    merged = ingest.merged_postings(jobs, now_ms)
    return t.upsert("listings", ingest.changed_listings(t.rows_of("listings", merged.select("id")), merged, now_ms))


def load(t: Transaction, now_ms: int, args: argparse.Namespace) -> dict:
    """Postings in --jobs (Parquet: RAW_JOBS with company_id, provider_slug, seq) normalized and upserted."""
    seen = Observation()
    jobs = t.spark.read.parquet(args.jobs)
    jobs = jobs.withColumn("_named", F.substring_index(F.concat_ws(":", "provider", "provider_slug", "provider_job_id"), ":", 1))
    jobs = jobs.observe(seen, *[c.alias(p) for p, c in _of_each("_named", PROVIDERS).items()])
    _upserted(t, jobs.drop("_named"), now_ms)
    return dict(seen.get)


def sweep(t: Transaction, now_ms: int, args: argparse.Namespace) -> dict:
    t.upsert("listings", maintain.swept(t.read("listings"), now_ms))
    return t.rows_by_status()


def repair(t: Transaction, now_ms: int, args: argparse.Namespace) -> dict:
    return {"repaired": t.upsert("listings", maintain.repaired(t.read("listings")))["rows"]}


def eligible(t: Transaction, now_ms: int, args: argparse.Namespace) -> dict:
    """Companies that a probe is due for, in the table `eligible`."""
    rows = search.probe_eligible(t.read("companies"), now_ms, args.only, args.limit).select("id", "slug", "yc_batch")
    return {"eligible": _listed(t, args, "eligible", rows, "slug")}


def scrape(t: Transaction, now_ms: int, args: argparse.Namespace) -> dict:
    """Landed payloads (lists, details, pages in --landed; see operators.dispatch) of the known boards, normalized and upserted.

    Payloads that can't be read go to the table `quarantine` beside the store's own, the postings of each board to `boards`.
    """
    lists = _landed(t, args, "lists", "provider string, slug string, body string")
    details = _landed(t, args, "details", "provider string, slug string, key string, body string")
    pages = _landed(t, args, "pages", "provider string, slug string, html string")
    companies = search.with_careers(t.read("companies"))
    if args.only:
        companies = companies.filter(F.col("slug") == args.only)
    if args.limit:
        companies = companies.limit(args.limit)
    owners = ingest.resolved_provider(companies, pages.filter("provider = 'custom'").select(F.col("slug").alias("url"), "html"))
    found, bad_seen = Observation(), Observation()
    jobs = dispatch.of_companies(dispatch.postings(lists, details, pages, now_ms), owners)
    jobs = materialize(jobs.observe(found, *[c.alias(p) for p, c in _of_each("provider", PROVIDERS).items()]), "postings")
    bad = materialize(dispatch.unreadable(lists, details).observe(bad_seen, F.count(F.lit(1)).alias("n")), "unreadable")
    _beside(t, args, "quarantine", bad)
    _beside(t, args, "boards", jobs.groupBy("provider", "provider_slug", "company_id").agg(F.count("*").alias("postings")))
    _upserted(t, jobs, now_ms)
    return {"postings": dict(found.get), "unreadable": bad_seen.get["n"]}


def _probed(t: Transaction, args: argparse.Namespace, now_ms: int, found: DataFrame) -> tuple[DataFrame, dict, int]:
    """Results of a probe written: the results, their counts, and how many companies have gained a careers page."""
    seen = Observation()
    found = materialize(found.observe(seen, *[c.alias(r) for r, c in _of_each("result", PROBE_RESULTS).items()]), "probe-results")
    companies = t.rows_of("companies", found.select("id"))
    after = maintain.apply_probe_results(companies.join(found.select("id"), "id", "left_semi"), found, now_ms)
    had = companies.select("id", F.col("careers_url").isNotNull().alias("_had"))
    gained = F.coalesce(F.sum(F.col("careers_url").isNotNull().cast("bigint")), F.lit(0))
    before = had.join(found.select("id"), "id", "left_semi").agg(F.count_if("_had").alias("n")).first().n
    done = t.upsert("companies", after, {"with_page": gained})
    _beside(t, args, "probed", found.select("id", "slug", "result", "careers_url", "ats_provider", F.size("checked").alias("checked"), "html_size"))
    return found, {k: v for k, v in seen.get.items() if v}, done["with_page"] - before


def probe_careers(t: Transaction, now_ms: int, args: argparse.Namespace) -> dict:
    """Careers pages of the companies that are due, from landed pages and robots in --landed; with --rendered, a second pass at once.

    A row for each company goes to the table `probed`.
    """
    companies = t.read("companies")
    due = search.probe_eligible(companies, now_ms, args.only, args.limit)
    found = probe.probe(due, _landed(t, args, "pages", fetch.LOG), _landed(t, args, "robots", "origin string, status int, body string"))
    if args.rendered:
        found = probe.after_render(found, t.spark.read.parquet(args.rendered))
    before = companies.filter("careers_url IS NOT NULL").count()
    _, counts, delta = _probed(t, args, now_ms, found)
    return {"results": counts, "before": before, "after": before + delta, "delta": delta}


def headless(t: Transaction, now_ms: int, args: argparse.Namespace) -> dict:
    """The rendered pass: companies probed of late without a page, or with an error, probed anew and then by rendered pages.

    --landed has what a plain fetcher got for them, --rendered what a rendering one got for the URLs of render-list.
    """
    due = search.headless_eligible(t.read("companies"), now_ms, args.limit, args.only)
    found = probe.second_pass(
        due, _landed(t, args, "pages", fetch.LOG), _landed(t, args, "robots", "origin string, status int, body string"), t.spark.read.parquet(args.rendered)
    )
    found, counts, delta = _probed(t, args, now_ms, found)
    return maintain.headless_counts(found).first().asDict() | {"results": counts, "delta": delta}


def render_list(t: Transaction, now_ms: int, args: argparse.Namespace) -> dict:
    """What a rendering fetcher should land for the pass `headless`, in the table `render_list`."""
    due = search.headless_eligible(t.read("companies"), now_ms, args.limit, args.only)
    urls = probe.render_urls(due.select("id", "slug", probe.website_url(F.col("website")).alias("site"))).orderBy("id", "place")
    args.limit = None  # of companies, not of URLs
    return {"urls": _listed(t, args, "render_list", urls, "url")}


def land(t: Transaction, now_ms: int, args: argparse.Namespace) -> dict:
    """Responses for the URLs in --urls (Parquet, column url) landed in the table `pages` of --landed, or with --browser in `rendered`."""
    urls = t.spark.read.parquet(args.urls)
    if args.dry_run:
        return {r.state: r.n for r in fetch.frontier(urls, _landed(t, args, "pages", fetch.LOG)).groupBy("state").agg(F.count("*").alias("n")).collect()}
    get, slots = fetch.plain_fetch, fetch.Scheduler()
    if args.browser:
        get, slots = fetch.rendering_fetch(args.browser), fetch.Scheduler(fetch.RENDER_SLOTS, fetch.HOST_PAUSE, fetch.PAUSE)
    return fetch.land_frontier(urls, f"{args.landed.rstrip('/')}/{'rendered' if args.browser else 'pages'}", get, slots)


def backfill(t: Transaction, now_ms: int, args: argparse.Namespace) -> dict:
    """Descriptions of listings without one, from landed responses (pages in --landed)."""
    pages = _landed(t, args, "pages", fetch.LOG).select("url", "status", F.col("body").alias("html"))
    listings = t.read("listings")
    wanted = search.empty_descriptions(listings, now_ms)
    if args.limit:
        wanted = wanted.orderBy("id").limit(args.limit)
    seen = Observation()
    out = maintain.outcomes_of(wanted, pages).observe(seen, *[c.alias(o) for o, c in _of_each("outcome", ("filled", "expired", "error")).items()])
    out = materialize(out, "backfill")
    own = t.rows_of("listings", out.select("id")).join(out.select("id"), "id", "left_semi")
    t.upsert("listings", maintain.apply_backfill(own, out, now_ms))
    return {k: v for k, v in seen.get.items() if v}


def fulfil_payments(t: Transaction, now_ms: int, args: argparse.Namespace) -> dict:
    """Landed payment events (payments in --landed) fulfilled once each: company, listing and payment in one commit."""
    seen = Observation()
    payments = fulfil.payment_fields(_landed(t, args, "payments", EVENT_SCHEMA))
    payments = materialize(payments.observe(seen, F.count_if(F.col("error").isNotNull()).alias("refused")), "payments")
    return fulfil.into(t, payments) | dict(seen.get)


def feed(t: Transaction, now_ms: int, args: argparse.Namespace) -> dict:
    """The whole feed of active listings, a line of JSON each, in the folder feed beside the tables; with --pages a file for each page."""
    rows = search.all_active(t.read("listings"), t.read("companies"), now_ms)
    seen = Observation()
    lines = rows.observe(seen, F.count(F.lit(1)).alias("items")).select(docs.feed_row(rows.columns).alias("value"))
    if args.dry_run:
        return {"items": rows.count()}
    lines.write.mode("overwrite").text(f"{t.store.root}/feed")
    out = dict(seen.get)
    if args.pages:
        paged = search.feed_pages(rows).select("page", docs.feed_row(rows.columns).alias("value"))
        paged.write.partitionBy("page").mode("overwrite").text(f"{t.store.root}/feed_pages")
    return out


@dataclass(frozen=True)
class Job:
    run: Callable[[Transaction, int, argparse.Namespace], dict]
    needs: tuple[str, ...] = ()
    takes: tuple[str, ...] = ()


JOBS = {
    "seed": Job(seed, takes=("batches",)), "load": Job(load, ("jobs",)), "scrape": Job(scrape, ("landed",), ("only", "limit")), "sweep": Job(sweep),
    "repair": Job(repair), "eligible": Job(eligible, takes=("only", "limit")), "probe": Job(probe_careers, ("landed",), ("only", "limit", "rendered")),
    "headless": Job(headless, ("landed", "rendered"), ("only", "limit")), "render-list": Job(render_list, takes=("only", "limit")),
    "land": Job(land, ("landed", "urls"), ("browser",)),
    "backfill": Job(backfill, ("landed",), ("limit",)), "fulfil": Job(fulfil_payments, ("landed",)), "feed": Job(feed, takes=("pages",)),
}
#: What runs once a day: companies, postings, expiry, feed.
DAILY = ("seed", "scrape", "sweep", "feed")
OPTIONS = ("jobs", "batches", "rendered", "urls", "browser", "only", "limit", "pages")


def run_job(store: TableStore, name: str, now_ms: int, args: argparse.Namespace) -> dict:
    """One job as one commit, with its row in `runs`; a dry run commits nothing and leaves nothing."""

    def work(t: Transaction) -> dict:
        began, base = time.monotonic(), t.base
        try:
            out = JOBS[name].run(t, now_ms, args)
            if not args.dry_run:
                row = (f"{args.run}:{name}", args.run, name, now_ms, base, round(time.monotonic() - began, 3), json.dumps(out))
                t.upsert("runs", store.spark.createDataFrame([row], RUNS))
            return out
        finally:
            if args.dry_run:
                t.abort()

    if args.dry_run:
        return work(store.begin())
    return store.transact(work)


def daily(store: TableStore, now_ms: int, args: argparse.Namespace) -> dict:
    """The day's steps, a commit each. Those that a run of this name has finished (see `runs`) aren't done again."""
    runs = store.read("runs").filter(F.col("run") == args.run)
    done = {r.job: json.loads(r.counters) for r in runs.filter(F.col("job").isin(*DAILY)).select("job", "counters").collect()}
    return {name: done[name] if name in done and not args.again else run_job(store, name, now_ms, args) for name in DAILY}


def parser() -> argparse.ArgumentParser:
    def whole(text: str) -> int:
        if not text.isdigit() or int(text) < 1:
            raise argparse.ArgumentTypeError(f"{text} is no whole number above 0")
        return int(text)

    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=sorted([*JOBS, "daily", "vacuum"]))
    p.add_argument("--store", required=True)
    p.add_argument("--now-ms", type=int)
    p.add_argument("--run", help="name of the run; else the day, and for other jobs than daily the time")
    p.add_argument("--again", action="store_true", help="daily: do finished steps again")
    p.add_argument("--jobs", help="postings to load")
    p.add_argument("--batches", help="folder of landed directory batches")
    p.add_argument("--landed", help="folder of landed tables")
    p.add_argument("--rendered", help="pages that a rendering fetcher landed (url, final_url, body)")
    p.add_argument("--urls", help="land: table with a column url")
    p.add_argument("--browser", help="land: command of a headless browser that renders")
    p.add_argument("--pages", action="store_true", help="feed: a file for each page, too")
    p.add_argument("--dry-run", action="store_true", help="compute and count, commit nothing")
    p.add_argument("--only", help="one batch of companies, or (scrape) the slug of one")
    p.add_argument("--limit", type=whole, help="at most so many companies, or listings")
    return p


def _checked(p: argparse.ArgumentParser, args: argparse.Namespace) -> None:
    """Refuses options that the job doesn't read (but for --landed, which names a folder of many tables), and asks for those that it needs."""
    jobs = [JOBS[j] for j in (DAILY if args.job == "daily" else [args.job]) if j in JOBS]
    takes = {o for j in jobs for o in (*j.needs, *j.takes)} - (set() if args.job != "daily" else {"only", "limit"})
    for option in OPTIONS:
        if getattr(args, option) and option not in takes:
            p.error(f"{args.job} doesn't take --{option}")
    for job in jobs:
        for option in job.needs:
            if not getattr(args, option):
                p.error(f"{args.job} needs --{option}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = parser()
    args = p.parse_args(argv)
    _checked(p, args)
    spark = prepare(spark or SparkSession.builder.getOrCreate())
    now_ms = args.now_ms if args.now_ms is not None else int(time.time() * 1000)
    day = datetime.fromtimestamp(now_ms / 1000, UTC)
    args.run = args.run or (day.strftime("%Y-%m-%d") if args.job == "daily" else f"{args.job}-{day.strftime('%Y%m%dT%H%M%S')}-{now_ms % 1000:03d}")
    store = TableStore(spark, args.store)
    if args.job == "vacuum":
        out = store.vacuum()
    else:
        out = daily(store, now_ms, args) if args.job == "daily" else run_job(store, args.job, now_ms, args)
    print(json.dumps({"job": args.job} | out))
    return out


if __name__ == "__main__":
    main()
