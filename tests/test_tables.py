"""Search, upserts, the table store, fulfilment and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from jobloom.functions import html
from jobloom.operators import constraints, fulfil, ingest, maintain, search
from jobloom.schemas import COMPANIES, LISTINGS, PAID_LISTINGS, THIRTY_DAYS_MS
from jobloom.sources import companies as directory
from jobloom.sources import table_source
from jobloom.sources.store import LEAST_FOLDERS, Conflict, TableStore
from jobloom.sources.views import NOW_MS, view
from jobloom.streaming import events

BODY = "<p>" + "long text " * 20 + "</p>"


def listing(i, **own):
    row = dict(id=i, company_id="c1", title="T", location_city=None, location_country="US", location_is_remote=1, location_policy="remote", comp_min=None, comp_max=None,
               comp_currency=None, comp_equity=None, ai_stack="[]", ai_specialty=None, ai_compute_access=None, description_html=BODY, apply_url="u",
               posted_at=NOW_MS, expires_at=NOW_MS + 5, updated_at=NOW_MS, status="active")
    return tuple((row | own).values())


def listings(spark, *rows):
    return spark.createDataFrame(list(rows), LISTINGS)


def batch(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LISTINGS.fields))


def company(i, slug=None, website=None):
    return (i, slug or i, i, None, website, None, None, None, None, None, None, NOW_MS)


# --- search


def test_filters_from_a_query_string():
    assert search.read_filters("?specialty=nlp&remote=1&min_comp=1e5") == search.Filters("nlp", True, 100000.0)
    assert search.read_filters("specialty=x&remote=true&min_comp=abc") == search.Filters()
    assert search.read_filters("min_comp=Infinity") == search.Filters() and search.read_filters("min_comp=") == search.Filters()
    assert search.filter_href("page=2&remote=1", remote_only=False, specialty="nlp") == "/?page=2&specialty=nlp"
    assert search.filter_href("min_comp=5", min_comp=None) == "/" and search.filter_href("min_comp=5&x=1", min_comp=50000) == "/?min_comp=50000&x=1"


def test_pages():
    assert search.page_bounds(120, 9) == {"pages": 3, "page": 3, "offset": 100, "first": 101, "last": 120}
    assert search.page_bounds(0, 0) == {"pages": 1, "page": 1, "offset": 0, "first": 0, "last": 0}


def test_pages_are_disjoint_and_complete(spark, small):
    rows, companies = view(spark, small, "listings_v"), view(spark, small, "companies_v")
    seen = [r.id for p in range(3) for r in search.recent(rows, companies, search.Filters(), NOW_MS, 40, 40 * p).collect()]
    assert len(seen) == len(set(seen)) == min(120, search.count_active(rows, companies, search.Filters(), NOW_MS).first().n)


def test_filters_reach_the_scan(spark, tmp_path):
    listings(spark, listing("a", comp_max=10)).write.parquet(f"file://{tmp_path}/l")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    rows = search.matching(spark.read.parquet(f"file://{tmp_path}/l"), search.Filters("nlp", True, 100), NOW_MS)
    plan = rows.select("id", "title")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(c in pushed for c in ("status", "expires_at", "ai_specialty", "location_is_remote", "comp_max")) and "description_html" not in plan.split("ReadSchema")[1]


def test_expiry_edge(spark):
    rows = listings(spark, listing("now", expires_at=NOW_MS), listing("past", expires_at=NOW_MS - 1), listing("next", expires_at=NOW_MS + 1))
    assert {r.id for r in search.matching(rows, search.Filters(), NOW_MS).collect()} == {"next"}
    assert {r.id for r in maintain.sweep_expired(rows, NOW_MS).filter("status = 'expired'").collect()} == {"past"}


# --- upserts


def test_upsert_cases(spark):
    old = listings(spark, listing("old", company_id="kept", status="expired", title="before"), listing("rest", title="same"))
    new = batch(spark, listing("old", company_id="other", title="after"), listing("one", expires_at=NOW_MS - 7), listing("two", company_id="first", title="x"), listing("two", company_id="last", title="y"),
                listing("short", description_html="<p>short</p>"))
    got = {r.id: r for r in ingest.upsert_listings(old, new, NOW_MS + 1).collect()}
    assert set(got) == {"old", "rest", "one", "two"}
    assert (got["old"].company_id, got["old"].title, got["old"].status, got["old"].expires_at) == ("kept", "after", "active", NOW_MS + 1 + THIRTY_DAYS_MS)
    assert got["one"].expires_at == NOW_MS - 7 and got["one"].updated_at == NOW_MS + 1
    assert (got["two"].company_id, got["two"].title, got["two"].expires_at) == ("first", "y", NOW_MS + 1 + THIRTY_DAYS_MS)
    again = ingest.upsert_listings(ingest.upsert_listings(old, new, NOW_MS), new, NOW_MS)
    thrice = ingest.upsert_listings(again, new, NOW_MS)
    assert sorted(again.collect()) == sorted(thrice.collect())


def test_upsert_refuses_seconds(spark):
    with pytest.raises(Exception, match="not in milliseconds"):
        ingest.upsert_listings(listings(spark), batch(spark, listing("a"), listing("b", expires_at=NOW_MS // 1000)), NOW_MS).collect()


def test_company_upserts(spark):
    curated = directory.curated(spark, NOW_MS)
    none = spark.createDataFrame([], COMPANIES)
    once = ingest.upsert_companies(none, curated, overwrite_careers=True)
    assert once.count() == 12 and sorted(ingest.upsert_companies(once, curated, True).collect(), key=str) == sorted(once.collect(), key=str)
    rows = spark.createDataFrame([(1, "N", "s", "w", "", "l", "", "long", "Winter 2024", ["Generative AI"]), (2, "M", "t", "w", None, None, "one", None, "x", ["fintech"])], directory.BATCH_SCHEMA)
    found = directory.ai_companies(rows, NOW_MS).collect()
    assert [(r.slug, r.logo_url, r.description) for r in found] == [("s", "l", "long")]


def test_landed_batches(spark, tmp_path):
    (tmp_path / "winter-2024.json").write_text(json.dumps([{"id": 1, "name": "N", "slug": "s", "tags": ["AI"]}]))
    (tmp_path / "other.json").write_text("[]")
    assert directory.read_batches(spark, f"file://{tmp_path}").count() == 1


def test_backfill(spark):
    rows = listings(spark, *[listing(i, description_html="", apply_url=i) for i in ("dead", "down", "gone", "thin", "full")])
    page = lambda t: f"<article>{t}</article>"
    fetched = spark.createDataFrame([("dead", 404, None), ("down", 503, None), ("thin", 200, page("x")), ("full", 200, page("<p onclick='a'>" + "word " * 60 + "</p>")), ("thin", 200, page("x"))], "url string, status int, html string")
    out = maintain.backfill_outcomes(rows, fetched, NOW_MS)
    assert sorted((r.id, r.outcome) for r in out.collect()) == sorted({"dead": "expired", "down": "error", "gone": "error", "thin": "expired", "full": "filled"}.items())
    assert maintain.apply_backfill(rows, out.union(out), NOW_MS).count() == rows.count()
    long = "word " * 60
    pages = {"main": f"<nav>n</nav><main>{long}</main>", "head": f"<body><nav>n</nav><h1>T</h1><p>{long}</p></body>", "body": f"<body><p>{long}</p></body>", "bare": f"<p>{long}",
             "told": f"<!-- <article>no</article> --><main>{long}</main>", "two": f"<article>{long}</article><article>x</article>", "thin": f"<main>x</main><p>{long}</p>"}
    for page_html, kept in ((h, html.main_content(h)) for h in pages.values()):
        one = spark.createDataFrame([(page_html,)], "html string").select(maintain.main_content(F.col("html")).alias("c")).first().c
        assert one == kept
    rows = listings(spark, *[listing(i, description_html="", apply_url=i) for i in pages])
    fetched = spark.createDataFrame([(i, 200, h) for i, h in pages.items()], "url string, status int, html string")
    assert {r.id: r.outcome for r in maintain.backfill_outcomes(rows, fetched, NOW_MS).collect()} == {i: "expired" if i == "thin" else "filled" for i in pages}
    out = maintain.backfill_outcomes(
        listings(spark, *[listing(i, description_html="", apply_url=i) for i in ("dead", "down", "gone", "thin", "full")]),
        spark.createDataFrame([("dead", 404, None), ("full", 200, page("<p onclick='a'>" + "word " * 60 + "</p>"))], "url string, status int, html string"), NOW_MS,
    )
    rows = listings(spark, *[listing(i, description_html="", apply_url=i) for i in ("dead", "down", "gone", "thin", "full")])
    after = {r.id: r for r in maintain.apply_backfill(rows, out, NOW_MS).collect()}
    assert after["dead"].expires_at == NOW_MS and after["full"].description_html.startswith("<p>word") and after["down"].expires_at == NOW_MS + 5


# --- store


def test_store(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/db")
    assert store.read("companies").count() == 0
    first = store.write("companies", spark.createDataFrame([company("c1")], COMPANIES))
    store.write("listings", listings(spark, listing("a"), listing("b", status="expired")))
    assert store.read("listings").count() == 2 and store.columns("listings").names == LISTINGS.names
    with pytest.raises(ValueError, match="foreign key"):
        store.write("listings", listings(spark, listing("a", company_id="nobody")))
    with pytest.raises(ValueError, match="unique"):
        store.write("companies", spark.createDataFrame([company("c1"), company("c2", slug="c1")], COMPANIES))
    with pytest.raises(ValueError, match="check"):
        store.write("listings", listings(spark, listing("a", status="odd")))
    with pytest.raises(ValueError, match="unknown columns: x"):
        store.write("companies", spark.createDataFrame([company("c1")], COMPANIES).withColumn("x", F.lit(1)))
    assert store.current("companies") == first and len(store.stale_versions("companies")) == 1
    store.write("listings", listings(spark, listing("a")).drop("updated_at", "ai_compute_access", "ai_stack"))
    row = store.read("listings").first()
    assert row.updated_at == row.posted_at and row.ai_stack == "[]"
    with pytest.raises(ValueError, match="ai_stack is null"):
        store.write("listings", listings(spark, listing("a", ai_stack=None)))


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = TableStore(spark, f"file://{tmp_path}/db")
    one = store.write("companies", spark.createDataFrame([company("c1")], COMPANIES))
    both = spark.createDataFrame([company("c1"), company("c2")], COMPANIES)
    with monkeypatch.context() as m:
        m.setattr(TableStore, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("dies")))
        with pytest.raises(RuntimeError, match="dies"):
            store.write("companies", both)
    assert store.current("companies") == one
    commits = tmp_path / "db/_commits"
    (commits / "_abc").write_text("{}")  # written, not yet there under its name
    (commits / "c-000000000001.json").write_text('{"tables": {"comp')  # cut off
    assert store.current("companies") == one and store.read("companies").count() == 1
    two = store.write("companies", both)
    assert store.current("companies") == two and store.read("companies").count() == 2
    (commits / "c-000000000003.json").write_text(json.dumps({"base": 2, "tables": {"companies": one}, "notes": {}}))  # another writer was faster
    with pytest.raises(Conflict, match="another writer"):
        store._publish(2, {"companies": two}, {})


def test_the_second_of_two_writers_on_one_base_fails(spark, tmp_path):
    first, second = (TableStore(spark, f"file://{tmp_path}/db") for _ in range(2))
    first.write("companies", spark.createDataFrame([company("base")], COMPANIES))
    a, b = first.read("companies"), second.read("companies")
    first.write("companies", a.unionByName(spark.createDataFrame([company("fromA")], COMPANIES)))
    with pytest.raises(Conflict, match="another writer"):
        second.write("companies", b.unionByName(spark.createDataFrame([company("fromB")], COMPANIES)))
    tries = []

    def work(t):
        tries.append(t.base)
        t.upsert("companies", spark.createDataFrame([company("fromB")], COMPANIES))
        if len(tries) == 1:  # another one commits while this one works
            first.transact(lambda other: other.upsert("companies", spark.createDataFrame([company("fromC")], COMPANIES)))

    second.transact(work)
    assert {r.id for r in first.read("companies").collect()} == {"base", "fromA", "fromB", "fromC"} and len(tries) == 2


def test_a_crash_between_tables_shows_none_of_them(spark, tmp_path, monkeypatch):
    store = TableStore(spark, f"file://{tmp_path}/db")

    def work(t):
        t.upsert("companies", spark.createDataFrame([company("c1")], COMPANIES))
        t.upsert("listings", listings(spark, listing("a")))  # its parent is of the same transaction
        assert t.read("listings").count() == 1

    with monkeypatch.context() as m:
        m.setattr(TableStore, "_create", lambda *_: (_ for _ in ()).throw(OSError("dies")))
        with pytest.raises(OSError, match="dies"):
            store.transact(work)
    assert store.read("companies").count() == store.read("listings").count() == 0
    store.transact(work)
    assert store.read("companies").count() == store.read("listings").count() == 1
    assert store.commit()["number"] == 0 and set(store.commit()["tables"]) == {"companies", "listings"}


def test_an_upsert_writes_only_the_buckets_it_touches(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/db", bucket_rows=10)
    store.write("companies", spark.createDataFrame([company("c1")], COMPANIES))
    rows = [listing(f"l{i}", title=f"t{i}", expires_at=NOW_MS + i, status="active" if i % 3 else "expired") for i in range(200)]
    store.write("listings", listings(spark, *rows))
    before = store.manifest("listings", store.current("listings"))
    assert before["buckets"] == 20 and sum(e["rows"] for e in before["entries"]) == 200
    files = lambda: {p for p in (tmp_path / "db/listings").rglob("*.parquet")}
    known = files()
    done = store.transact(lambda t: t.upsert("listings", listings(spark, listing("l7", title="new"), listing("fresh"))))
    assert done["rows"] == 2 and 1 <= done["buckets"] <= 2 and done["written"] < 60
    new = files() - known
    assert 0 < len(new) <= 4 and len(known & files()) == len(known)
    after = store.manifest("listings", store.current("listings"))
    assert len({e["path"] for e in before["entries"]} & {e["path"] for e in after["entries"]}) >= len(before["entries"]) - 4
    want = {r[0]: r for r in rows} | {"l7": listing("l7", title="new"), "fresh": listing("fresh")}
    assert {r.id: tuple(r) for r in store.read("listings").collect()} == want
    # Rows whose ids are new to their buckets are put beside what is there.
    known = files()
    done = store.transact(lambda t: t.upsert("listings", listings(spark, listing("other"))))
    assert done["written"] == 1 and len(files() - known) == 1
    store.transact(lambda t: t.remove("listings", spark.createDataFrame([("other",), ("l7",), ("nobody",)], "id string")))
    assert {r.id for r in store.read("listings").collect()} == set(want) - {"l7"}
    assert store.transact(lambda t: t.upsert("listings", listings(spark))) == {"rows": 0, "buckets": 0, "written": 0}


def test_small_buckets_share_folders(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/db", bucket_rows=2)
    store.write("companies", spark.createDataFrame([company("c1")], COMPANIES))
    rows = [listing(f"l{i}", title=f"t{i}", expires_at=NOW_MS + i, status="active" if i % 3 else "expired") for i in range(400)]
    store.write("listings", listings(spark, *rows))
    files = lambda: {p for p in (tmp_path / "db/listings").rglob("*.parquet")}
    entries = lambda: store.manifest("listings", store.current("listings"))["entries"]
    assert store.manifest("listings", store.current("listings"))["buckets"] == 200 and len(files()) <= 2 * LEAST_FOLDERS < len(entries())
    want = {r[0]: r for r in rows}

    def same():
        table_source.views(spark, store.root, prefix="shared_")
        assert {r.id: tuple(r) for r in store.read("listings").collect()} == want
        assert sorted(map(tuple, spark.table("shared_listings").collect()), key=str) == sorted(want.values(), key=str)
        late = spark.sql(f"SELECT id FROM shared_listings WHERE status = 'active' AND expires_at > {NOW_MS + 390}").collect()
        assert sorted(r.id for r in late) == sorted(k for k, r in want.items() if r[LISTINGS.names.index("status")] == "active" and r[LISTINGS.names.index("expires_at")] > NOW_MS + 390)
        assert sum(e["rows"] for e in entries()) == len(want)

    same()
    known, before = files(), entries()
    done = store.transact(lambda t: t.upsert("listings", listings(spark, listing("l7", title="new"), listing("fresh"))))
    assert 1 <= done["buckets"] <= 2 and done["written"] < 20 and 0 < len(files() - known) <= 4
    assert sum(e in entries() for e in before) >= len(before) - 4
    want |= {"l7": listing("l7", title="new"), "fresh": listing("fresh")}
    same()
    one = spark.createDataFrame([("l9",)], "id string")
    assert 1 <= store.begin().rows_of("listings", one).count() < 20 and store.begin().rows_of("listings", one).filter("id = 'l9'").count() == 1
    # What upserts leave behind is at most as much as the listed rows of the buckets beside it.
    for k in range(3):
        more = [listing(f"l{i}", title=f"r{k}") for i in range(k, 400, 4)]
        store.transact(lambda t: t.upsert("listings", listings(spark, *more)))  # noqa: B023
        want |= {r[0]: r for r in more}
        same()
        listed, held, total = {}, {}, {}
        for e in entries():
            total[e["bucket"]] = total.get(e["bucket"], 0) + e["rows"]
        for e in entries():
            folder = "/".join(e["path"].split("/")[:2])
            listed.setdefault(folder, []).append(e)
            held[folder] = e["held"]
        assert all(held[f] - sum(e["rows"] for e in own) <= sum(total[b] for b in {e["bucket"] for e in own}) for f, own in listed.items())
    store.transact(lambda t: t.remove("listings", spark.createDataFrame([("l7",), ("nobody",)], "id string")))
    del want["l7"]
    same()
    with pytest.raises(ValueError, match="unique id"):
        store.transact(lambda t: t.upsert("listings", listings(spark, listing("a"), listing("a"))))


def test_postings_are_merged_before_their_texts_are_read(spark, small, monkeypatch):
    jobs = view(spark, small, "raw_jobs_v")
    key = lambda rows: sorted(map(str, rows.collect()))
    want = key(ingest.merged_listings(ingest.normalize(jobs, NOW_MS, body_chars=True)))
    read, merged = [], ingest._told
    monkeypatch.setattr(ingest, "_told", lambda rows: read.append(rows.count()) or merged(rows))
    assert key(ingest.merged_postings(jobs, NOW_MS)) == want and read == [len(want)] and 0 < len(want) < jobs.count()
    # A posting that isn't the last of its id is still held to milliseconds.
    body = F.lit("long enough " * 12)
    twice = jobs.limit(1).withColumns({"description": body, "posted_num": F.lit(-3_000_000_000_000).cast("double"), "posted_str": F.lit(None).cast("string")})
    later = twice.withColumns({"seq": F.col("seq") + 1, "posted_num": F.lit(996_000_000).cast("double")})
    with pytest.raises(Exception, match="not in milliseconds"):
        ingest.merged_postings(twice.unionByName(later), NOW_MS)
    assert ingest.merged_postings(later, NOW_MS).count() == 1


def test_upserts_of_the_store_keep_constraints(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/db", bucket_rows=2)
    store.write("companies", spark.createDataFrame([company("c1"), company("c2"), company("c3")], COMPANIES))
    put = lambda name, rows: store.transact(lambda t: t.upsert(name, rows))
    with pytest.raises(ValueError, match="unique slug"):
        put("companies", spark.createDataFrame([company("c9", slug="c2")], COMPANIES))
    put("companies", spark.createDataFrame([company("c2", slug="c2")], COMPANIES))  # its own slug isn't taken
    with pytest.raises(ValueError, match="unique id"):
        put("companies", spark.createDataFrame([company("c9"), company("c9", slug="c10")], COMPANIES))
    with pytest.raises(ValueError, match="foreign key"):
        put("listings", listings(spark, listing("a", company_id="nobody")))
    with pytest.raises(ValueError, match="check"):
        put("listings", listings(spark, listing("a", status="odd")))
    assert store.read("companies").count() == 3 and store.read("listings").count() == 0


def test_vacuum_spares_readers(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/db")
    for k in range(4):
        store.write("companies", spark.createDataFrame([company(f"c{k}")], COMPANIES))
    assert len(store.stale_versions("companies")) == 3
    assert store.vacuum() == {"commits": 0, "manifests": 0, "folders": 0}  # all of it is young
    assert store.vacuum(spared_ms=-1000, keep=1) == {"commits": 2, "manifests": 2, "folders": 2}
    assert store.read("companies").first().id == "c3" and store.commit(2)["base"] == 1
    store.write("companies", spark.createDataFrame([company("c9")], COMPANIES))
    assert store.commit()["number"] == 4


def test_a_store_where_files_are_not_created_once_is_refused(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/db")
    store._path = lambda text, own=store._path: (own(text)[0], Renamed(own(text)[1]))
    with pytest.raises(ValueError, match="only once"):
        store._create(f"file://{tmp_path}/db/x", "{}")


class Renamed:
    """A file system of another kind."""

    def __init__(self, own):
        self.own = own

    def __getattr__(self, name):
        return getattr(self.own, name)

    def getUri(self):
        return type("Uri", (), {"getScheme": lambda _: "s3a"})()


def test_constraints(spark):
    rows = listings(spark, listing("a", title=None), listing("b", ai_specialty="x"), listing("c", expires_at=5), listing("d"))
    assert {r.id: r.breach for r in constraints.check_violations(rows, "listings").collect()} == {"a": "title is null", "b": "ai_specialty is out of range", "c": "expires_at is in seconds"}


# --- fulfilment


def event(i, website="https://new.com", name="New Co", session=None, at=NOW_MS, **own):
    draft = {"company_name": name, "company_website": website, "title": "Engineer", "apply_url": "https://a.com", "description_html": "<p>x</p>", "location_country": "US",
             "location_is_remote": 1, "location_policy": "remote", "ai_stack": ["cuda"], "customer_email": "a@b.c"} | own
    text = json.dumps(draft)
    parts = {f"d{k}": text[j : j + 450] for k, j in enumerate(range(0, len(text), 450))}
    return (i, fulfil.COMPLETED, session or f"cs_{i}", None, None, parts | {"draft_chunks": str(len(parts)), "tier": "founding"}, at)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), events.EVENT_SCHEMA)


def test_fulfilment(spark):
    companies = spark.createDataFrame([company("c1", website="https://Known.com"), company("c2", slug="new-co"), company("c3", slug="new-co-3")], COMPANIES)
    paid = spark.createDataFrame([("p", "l", "cs_old", "old", "founding", 1, "usd", "e", 1)], PAID_LISTINGS)
    rows = [event("old"), event("e1", "https://known.com/jobs", at=NOW_MS + 1), event("e2", at=NOW_MS + 2), event("e2", at=NOW_MS + 2), event("e3", "https://NEW.com/x", at=NOW_MS + 3),
            event("e4", "https://b.org", session="cs_e2", at=NOW_MS + 4), event("e5", "https://other.com", at=NOW_MS + 5), event("e6", "https://x.com", title="", at=NOW_MS + 6),
            event("e7", "https://z.org", name="!!", at=NOW_MS + 7)]
    done = fulfil.fulfil(companies, paid, fulfil.payment_fields(frame(spark, *rows)))
    assert {r.event_id: r.result for r in done.results.collect()} == {"old": "duplicate", "e1": "inserted", "e2": "inserted", "e3": "inserted", "e4": "duplicate", "e5": "inserted", "e7": "inserted"}
    made = {r.website: r for r in done.companies.collect()}
    assert {w: r.slug for w, r in made.items()} == {"https://new.com": "new-co-2", "https://other.com": "new-co-4", "https://z.org": "company"}
    by_event = {r.stripe_event_id: r for r in done.paid.collect()}
    home = {r.id: r.company_id for r in done.listings.collect()}
    assert home[by_event["e1"].listing_id] == "c1" and home[by_event["e3"].listing_id] == home[by_event["e2"].listing_id] == made["https://new.com"].id
    row = done.listings.first()
    assert row.comp_equity is None and row.ai_stack == '["cuda"]' and row.status == "active"
    assert by_event["e1"].amount_cents == 19900 and by_event["e1"].currency == "usd"


def test_stream_fulfils_once(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/db")
    folder = tmp_path / "in"
    folder.mkdir()

    def land(name, *rows):
        names = [p.split()[0] for p in events.EVENT_SCHEMA.replace("map<string,string>", "map").split(", ")]
        (folder / name).write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
        q = events.fulfil_stream(store, events.read_events(spark, f"file://{folder}"), f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    land("1.json", event("a"), event("b", "https://two.com"))
    land("2.json", event("a"), event("c", "https://two.com", at=NOW_MS + 9), ("d", "other.type", "s", None, None, {}, 1))
    assert store.read("paid_listings").count() == store.read("listings").count() == 3 and store.read("companies").count() == 2


def test_stream_keeps_what_it_let_through(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/db")
    folder = tmp_path / "in"
    folder.mkdir()
    names = [p.split()[0] for p in events.EVENT_SCHEMA.replace("map<string,string>", "map").split(", ")]

    def land(name, *rows, checkpoint="cp", crash=False):
        (folder / name).write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
        target = store
        if crash:
            target = TableStore(spark, store.root)

            def dies(*_):
                raise OSError("dies")

            target._create = dies
        q = events.fulfil_stream(target, events.read_events(spark, f"file://{folder}"), f"file://{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
        if crash:
            with pytest.raises(Exception, match="dies"):
                q.awaitTermination()
        else:
            q.awaitTermination()
        return q

    sold = lambda: {r.stripe_event_id for r in store.read("paid_listings").collect()}
    # Two events of a session in one batch: the first by time counts. One without a usable draft takes no session.
    land("1.json", event("late", session="s", at=NOW_MS + 9), event("early", session="s", at=NOW_MS), event("bad", session="t", title=""))
    assert sold() == {"early"}
    q = land("2.json", event("early", session="s"), event("third", session="s", at=NOW_MS - 99), event("good", session="t"))
    assert sold() == {"early", "good"}  # repeated and rival deliveries end in the state, and so does one that is late
    state = q.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 2
    before = store.commit()["number"]
    land("3.json", event("x", "https://x.com", session="u"), crash=True)
    assert store.commit()["number"] == before and sold() == {"early", "good"}
    land("4.json")  # the batch that broke off runs again
    assert sold() == {"early", "good", "x"}
    # A new checkpoint knows nothing: the tables do.
    land("5.json", event("early", session="s"), event("y", "https://y.com", session="u"), checkpoint="other")
    assert sold() == {"early", "good", "x"} and store.read("listings").count() == 3


def test_a_batch_is_fulfilled_once(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/db")
    payments = fulfil.payment_fields(frame(spark, event("a")))
    assert events.fulfil_batch(store, payments, "s", 4) == {"inserted": 1}
    number = store.commit()["number"]
    assert events.fulfil_batch(store, payments, "s", 4) == {} and store.commit()["number"] == number
    assert events.fulfil_batch(store, payments, "s", 5) == {"duplicate": 1} and store.commit()["notes"] == {"s": 5}


def test_state_of_old_sessions_is_forgotten(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    names = [p.split()[0] for p in events.EVENT_SCHEMA.replace("map<string,string>", "map").split(", ")]
    left = []
    for k in range(3):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, event(f"e{k}{i}")))) for i in range(5)))
        payments = fulfil.payment_fields(events.read_events(spark, f"file://{folder}"))
        q = events.first_of_sessions(payments, remembered_ms=1).writeStream.foreachBatch(lambda df, _: df.count())
        q = q.option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        left.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(left) <= 10
