"""The landing fetcher and the batch jobs."""

import http.server
import json
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from jobloom import cli
from jobloom.schemas import COMPANIES
from jobloom.sources import fetch
from jobloom.sources.store import TableStore
from jobloom.sources.views import NOW_MS, view
from jobloom.streaming.events import EVENT_SCHEMA
from tests.test_tables import event as paid_event


def test_landing(spark):
    busy, most, per_host, lock = set(), [0], {}, threading.Lock()

    def get(url):
        host = url.split("/")[2]
        with lock:
            assert host not in busy
            busy.add(host)
            most[0] = max(most[0], len(busy))
        time.sleep(0.01)
        with lock:
            busy.discard(host)
            per_host[host] = per_host.get(host, 0) + 1
        if url.endswith("bad"):
            raise TimeoutError("slow")
        return fetch.Response(url, 200, "text/html", "x")

    urls = [f"https://h{i % 4}.com/{i}" for i in range(16)] + ["https://h0.com/0", "https://h9.com/bad"]
    rows = fetch.land(spark, urls, get, fetch.Scheduler(slots=3)).collect()
    assert len(rows) == 17 and most[0] <= 3 and per_host["h0.com"] == 4
    assert [r.error for r in rows if r.status is None] == ["TimeoutError: slow"]


def test_landing_goes_on_after_a_crash(spark, tmp_path):
    folder, asked, now, held = f"file://{tmp_path}/pages", [], [1000.0], []
    urls = spark.createDataFrame([(f"https://h{i % 7}.com/{i}",) for i in range(40)] + [(None,), ("https://h1.com/1",)], "url string").repartition(5)

    def get(url, dies=None):
        asked.append(url)
        if dies and len(asked) >= dies:
            raise SystemExit  # no failure of a URL: the process ends
        if url.endswith("/9"):
            raise TimeoutError("slow")
        return fetch.Response(url, 200, "text/html", "x" * 1000)

    def write(rows, schema, own=spark.createDataFrame):
        held.append(len(rows))
        return own(rows, schema)

    land = lambda get: fetch.land_frontier(urls, folder, get, fetch.Scheduler(slots=3), chunk=8, clock=lambda: now[0])
    with pytest.raises(SystemExit):
        land(lambda url: get(url, 20))
    done = {r.url for r in spark.read.parquet(folder).collect()}
    assert len(done) == 16 and len({u.split("/")[2] for u in asked[:8]}) == 7  # hosts take turns
    asked.clear()
    spark_create, spark.createDataFrame = spark.createDataFrame, write
    try:
        assert land(get) == {"asked": 24, "answered": 23, "failed": 1} or "https://h2.com/9" in done
    finally:
        spark.createDataFrame = spark_create
    assert not done & set(asked) and max(held) <= 8
    assert land(get)["asked"] == 0  # the failure isn't due yet
    for _ in range(5):
        now[0] += 10_000
        asked.clear()
        land(get)
    log = spark.read.schema(fetch.LOG).parquet(folder)
    states = {r.url: (r.state, r.attempts) for r in fetch.frontier(urls, log).collect()}
    assert states.pop("https://h2.com/9") == ("given_up", fetch.TRIES) and set(states.values()) == {("landed", 1)} and not asked


class Slow(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/slow":
            time.sleep(1.5)
        status = {"/gone": 404, "/moved": 302}.get(self.path, 200)
        self.send_response(status)
        if status == 302:
            self.send_header("Location", "/there")
        self.end_headers()
        if status == 200:
            self.wfile.write("é".encode())

    def log_message(self, *args):
        pass


def test_plain_fetch():
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Slow) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_port}"
        assert fetch.plain_fetch(f"{base}/x") == fetch.Response(f"{base}/x", 200, None, "é")
        assert fetch.plain_fetch(f"{base}/moved").final_url == f"{base}/there" and fetch.plain_fetch(f"{base}/gone").status == 404
        with pytest.raises(TimeoutError):
            fetch.plain_fetch(f"{base}/slow", timeout=0.3)  # connects at once, answers late
        server.shutdown()
    with socket.socket() as full:  # a queue that is full never lets a connection through
        full.bind(("127.0.0.1", 0))
        full.listen(0)
        waiting = [socket.socket() for _ in range(4)]
        for s in waiting:
            s.setblocking(False)
            s.connect_ex(full.getsockname())
        start = time.monotonic()
        with pytest.raises(OSError):
            fetch.plain_fetch(f"http://127.0.0.1:{full.getsockname()[1]}/x", timeout=20, connect=0.3)
        assert time.monotonic() - start < 5
        for s in waiting:
            s.close()


def test_rendering_fetch(spark, tmp_path):
    browser = tmp_path / "browser"
    browser.write_text("#!/bin/sh\nfor last; do :; done\ncase $last in *empty) ;; *fails) exit 3 ;; *late) sleep 5 ;; *) echo \"<p>$last</p>\" ;; esac\n")
    browser.chmod(0o755)
    get = fetch.rendering_fetch(str(browser), timeout=1.0)
    rows = {r.url: r for r in fetch.land(spark, [f"http://a.com/{k}" for k in ("page", "empty", "fails", "late")], get, fetch.Scheduler(fetch.RENDER_SLOTS)).collect()}
    assert rows["http://a.com/page"].body.strip() == "<p>http://a.com/page</p>" and rows["http://a.com/page"].status == 200
    assert all(rows[f"http://a.com/{k}"].status is None and rows[f"http://a.com/{k}"].error for k in ("empty", "fails", "late"))


def test_pauses():
    now = [0.0]
    starts = []
    s = fetch.Scheduler(host_pause=1.0, pause=0.25, clock=lambda: now[0], sleep=lambda d: now.__setitem__(0, now[0] + d))
    for host in ("a", "b", "a"):
        s.run(host, lambda: starts.append(now[0]))
    assert starts == [0.0, 0.25, 1.0]


def test_batch_jobs(spark, small, tmp_path):
    where = f"file://{tmp_path}/db"
    run = lambda *args: cli.main([*args, "--store", where, "--now-ms", str(NOW_MS)], spark)
    assert run("seed") == {"companies": 12} == run("seed")
    jobs = view(spark, small, "raw_jobs_v").withColumn("company_id", F.lit("curated-modal")).withColumn("posted_num", F.col("posted_num").cast("double"))
    jobs.write.parquet(f"file://{tmp_path}/jobs")
    totals = run("load", "--jobs", f"file://{tmp_path}/jobs")
    assert len(totals) == 9 and sum(totals.values()) == 1500
    n = TableStore(spark, where).read("listings").count()
    run("load", "--jobs", f"file://{tmp_path}/jobs")
    assert TableStore(spark, where).read("listings").count() == n > 0
    assert sum(run("sweep").values()) == n and run("repair") == {"repaired": 0} and run("eligible", "--limit", "3") == {"eligible": []}


def test_jobs_over_landed_tables(spark, tmp_path):
    store, landed = TableStore(spark, f"file://{tmp_path}/db"), f"file://{tmp_path}/landed"
    run = lambda *args: cli.main([*args, "--store", store.root, "--landed", landed, "--now-ms", str(NOW_MS)], spark)
    urls = {"a": "https://jobs.lever.co/a", "b": "https://boards.greenhouse.io/b", "c": "https://c.example.com/careers", "d": None}
    rows = [(i, i, i, None, f"https://{i}.example.com/", None, None, u, None, None, None, NOW_MS) for i, u in urls.items()]
    store.write("companies", spark.createDataFrame(rows, COMPANIES))
    body = "<p>" + "long text " * 30 + "</p>"
    lever = json.dumps([{"id": "1", "text": "T", "description": body, "hostedUrl": "https://x.com/1"}])
    lists = [("lever", "a", lever), ("greenhouse", "b", "{oops"), ("greenhouse", "b", json.dumps({"jobs": [{"id": 7, "title": "G", "content": "", "absolute_url": "https://x.com/7"}]}))]
    ld = f'<script type="application/ld+json">{json.dumps({"@type": "JobPosting", "title": "C", "description": body.replace("</", "<\\/")})}</script>'
    spark.createDataFrame(lists, "provider string, slug string, body string").write.parquet(f"{landed}/lists")
    pages = [("custom", "https://c.example.com/careers", ld)]
    spark.createDataFrame(pages, "provider string, slug string, html string").write.parquet(f"{landed}/pages")
    assert run("scrape", "--dry-run")["unreadable"] == 1 and store.read("listings").count() == 0
    done = run("scrape")
    assert {p: n for p, n in done["postings"].items() if n} == {"lever": 1, "greenhouse": 1, "custom": 1}
    assert {(r.company_id, r.title) for r in store.read("listings").collect()} == {("a", "T"), ("c", "C")}
    assert spark.read.parquet(f"{store.root}/quarantine").first().slug == "b"

    whole = run("daily")
    assert whole["seed"] == {"companies": 16} and whole["sweep"] == {"active": 2} and whole["feed"] == {"items": 2}
    assert {json.loads(r.value)["company_slug"] for r in spark.read.text(f"{store.root}/feed").collect()} == {"a", "c"}
    store.write("companies", store.read("companies").filter("id NOT LIKE 'curated%'"))

    landed = f"file://{tmp_path}/fetched"
    got = [("https://d.example.com/", 200, '<a href="https://jobs.ashbyhq.com/d">Jobs</a>'), ("https://x.com/e", 200, f"<main>{body}</main>")]
    spark.createDataFrame([(u, None, s, "text/html", b, None) for u, s, b in got], fetch.LANDED).write.parquet(f"{landed}/pages")
    assert run("probe", "--dry-run")["delta"] == 1 and store.read("companies").filter("id = 'd'").first().careers_url is None
    done = run("probe")
    assert done["results"] == {"found_ats": 1} and store.read("companies").filter("id = 'd'").first().ats_provider == "ashby"
    assert run("render-list") == {"urls": []}
    empty = store.read("listings").limit(1).withColumns({"id": F.lit("e"), "description_html": F.lit(""), "apply_url": F.lit("https://x.com/e")})
    store.write("listings", store.read("listings").unionByName(empty))
    assert run("backfill") == {"filled": 1} and run("backfill") == {}
    spark.createDataFrame([paid_event("p1"), paid_event("p1"), paid_event("p2", title="")], EVENT_SCHEMA).write.parquet(f"{landed}/payments")
    assert run("fulfil", "--dry-run") == {"inserted": 1, "refused": 1} and store.read("paid_listings").count() == 0
    assert run("fulfil") == {"inserted": 1, "refused": 1} and run("fulfil")["duplicate"] == 1
    assert store.read("paid_listings").count() == 1


def test_the_rendered_pass_reaches_the_companies_it_lists(spark, tmp_path):
    store, landed = TableStore(spark, f"file://{tmp_path}/db"), f"file://{tmp_path}/landed"
    run = lambda *args: cli.main([*args, "--store", store.root, "--landed", landed, "--now-ms", str(NOW_MS)], spark)
    day, batches = NOW_MS - 86_400_000, {"a": "Winter 2024", "b": "Summer 2024", "c": None, "d": None}
    probed = {"a": ("no_page", day), "b": ("error", day), "c": (None, None), "d": ("no_page", day)}
    rows = [(i, i, i, batches[i], f"https://{i}.example.com", None, None, None, None, at, result, NOW_MS) for i, (result, at) in probed.items()]
    store.write("companies", spark.createDataFrame(rows, COMPANIES))
    listed = run("render-list")["urls"]
    assert [u for u in listed if "ycombinator" not in u] == [f"https://{i}.example.com/{p}" for i in "abd" for p in ("", "careers")]
    assert spark.read.parquet(f"{store.root}/render_list").count() == len(listed) == 9
    assert run("render-list", "--only", "winter 2024")["urls"] == listed[:3] == run("render-list", "--limit", "1")["urls"]
    spark.createDataFrame([("https://a.example.com/", None, 200, "text/html", "<div id=app></div>", None)], fetch.LANDED).write.parquet(f"{landed}/pages")
    shown = [("https://a.example.com/careers", '<a href="https://jobs.lever.co/a">Jobs</a>'), ("https://b.example.com/", '<a href="https://jobs.ashbyhq.com/b">Jobs</a>')]
    spark.createDataFrame([(u, None, b) for u, b in shown], "url string, final_url string, body string").write.parquet(f"{landed}/rendered")
    done = run("headless", "--rendered", f"{landed}/rendered", "--only", "Winter 2024")
    assert (done["processed"], done["upgraded"]) == (1, 1)
    done = run("headless", "--rendered", f"{landed}/rendered")
    assert (done["processed"], done["upgraded"], done["errors"], done["delta"]) == (2, 1, 1, 1)
    after = {r.id: (r.ats_provider, r.careers_probe_result) for r in store.read("companies").collect()}
    assert after == {"a": ("lever", "found_ats"), "b": ("ashby", "found_ats"), "c": (None, None), "d": (None, "error")}
    assert run("headless", "--rendered", f"{landed}/rendered")["processed"] == 1
    with pytest.raises(SystemExit):
        run("headless")  # needs rendered pages


@pytest.mark.parametrize("args", [["sweep", "--limit", "5"], ["seed", "--only", "x"], ["repair", "--only", "x"], ["fulfil", "--landed", "l", "--limit", "1"], ["eligible", "--limit", "0"],
                                  ["eligible", "--limit", "x"], ["probe"], ["load"], ["daily", "--landed", "l", "--limit", "2"]])
def test_options_that_a_job_does_not_read_are_refused(spark, tmp_path, args):
    with pytest.raises(SystemExit):
        cli.main([*args, "--store", f"file://{tmp_path}/db"], spark)


def test_a_daily_run_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    store, landed = TableStore(spark, f"file://{tmp_path}/db"), f"file://{tmp_path}/landed"
    run = lambda *args: cli.main(["daily", *args, "--store", store.root, "--landed", landed, "--now-ms", str(NOW_MS)], spark)
    spark.createDataFrame([("lever", "x", "{oops")], "provider string, slug string, body string").write.parquet(f"{landed}/lists")
    with monkeypatch.context() as m:
        m.setitem(cli.JOBS, "sweep", cli.Job(lambda *_: (_ for _ in ()).throw(OSError("dies"))))
        with pytest.raises(OSError, match="dies"):
            run()
    ran = lambda: {r.job: (r.id, json.loads(r.counters)) for r in store.read("runs").collect()}
    assert set(ran()) == {"seed", "scrape"} and ran()["seed"][1] == {"companies": 12}
    number = store.commit()["number"]
    done = run()
    assert set(done) == set(cli.DAILY) and store.commit()["number"] == number + 2  # sweep and feed alone
    assert spark.read.parquet(f"{store.root}/quarantine").count() == 1
    assert run() == done and store.commit()["number"] == number + 2
    assert run("--again") == done and spark.read.parquet(f"{store.root}/quarantine").count() == 1
    assert store.read("runs").count() == 4 and {r[0] for r in ran().values()} == {f"2001-07-25:{j}" for j in cli.DAILY}
