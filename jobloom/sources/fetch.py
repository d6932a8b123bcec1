"""Landing of responses: a fetcher on the driver, one request at a time for each host, that writes what it gets as rows.

`fetch(url)` is given by the caller (plain HTTP, a rendering browser, a test's table) and returns a Response or raises.
Spark tasks never fetch: connectors and the probe read the landed table.
"""

from __future__ import annotations

import ssl
import subprocess
import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from http.client import HTTPConnection, HTTPSConnection
from itertools import islice
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import HTTPHandler, HTTPSHandler, OpenerDirector, Request, build_opener

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators.ranks import ranked
from jobloom.sources.shared import discard, materialize

LANDED = "url string, final_url string, status int, content_type string, body string, error string"
LOG = f"{LANDED}, landed_at bigint"
#: URLs that are asked for before what came is written; how often one without an answer is asked again, and after how long, in ms.
CHUNK, TRIES, AGAIN_MS = 500, 4, 60_000
# Requests in flight and pauses of the plain and of the rendering fetcher; in seconds the timeouts of
# connecting, reading, reading a body for detection, and rendering, and how long a page may go on loading.
PLAIN_SLOTS, RENDER_SLOTS, HOST_PAUSE, PAUSE = 6, 2, 1.0, 0.25
CONNECT, TIMEOUT, DETECT_TIMEOUT, RENDER_TIMEOUT, RENDER_IDLE = 10.0, 15.0, 2.0, 25.0, 1.5


@dataclass(frozen=True)
class Response:
    final_url: str
    status: int
    content_type: str | None
    body: str


def _opener(connect: float, read: float) -> OpenerDirector:
    """An opener whose connections have a timeout for connecting and another for each read."""

    def timed(kind: type) -> type:
        class Timed(kind):
            def connect(self) -> None:
                self.timeout = connect
                super().connect()
                self.sock.settimeout(read)

        return Timed

    class Plain(HTTPHandler):
        def http_open(self, request: Request):
            return self.do_open(timed(HTTPConnection), request)

    class Secure(HTTPSHandler):
        def https_open(self, request: Request):
            return self.do_open(timed(HTTPSConnection), request, context=ssl.create_default_context())

    return build_opener(Plain, Secure)


def plain_fetch(url: str, timeout: float = TIMEOUT, connect: float = CONNECT) -> Response:
    """A GET that follows redirects; an error status is a response, a failed connection raises."""
    request = Request(url, headers={"User-Agent": "Mozilla/5.0"})
    try:
        with _opener(min(connect, timeout), timeout).open(request) as r:
            return Response(r.url, r.status, r.headers.get("content-type"), r.read().decode("utf-8", "replace"))
    except HTTPError as e:
        return Response(e.url or url, e.code, e.headers.get("content-type"), "")


def rendering_fetch(browser: str, timeout: float = RENDER_TIMEOUT, idle: float = RENDER_IDLE) -> Callable[[str], Response]:
    """A fetcher that lets a headless browser, a command of the Chromium kind, load a page and print its document.

    The document is taken once the page has been idle; a browser that fails, or prints nothing, raises.
    """

    def fetch(url: str) -> Response:
        flags = ["--headless", "--disable-gpu", f"--timeout={int(1000 * timeout)}", f"--virtual-time-budget={int(1000 * idle)}", "--dump-dom"]
        ran = subprocess.run([browser, *flags, url], capture_output=True, timeout=timeout, check=True)  # noqa: S603
        body = ran.stdout.decode("utf-8", "replace")
        if not body.strip():
            raise ValueError("the browser printed nothing")
        return Response(url, 200, "text/html", body)

    return fetch


class Scheduler:
    """At most `slots` calls at once, one for each host; `host_pause` after a call to a host, `pause` between any two starts."""

    def __init__(self, slots: int = PLAIN_SLOTS, host_pause: float = 0.0, pause: float = 0.0, clock=time.monotonic, sleep=time.sleep):
        self.slots, self.host_pause, self.pause, self.clock, self.sleep = slots, host_pause, pause, clock, sleep
        self.hosts: dict[str, threading.Lock] = {}
        self.free: dict[str, float] = {}
        self.next_start, self.gate = 0.0, threading.Lock()

    def run(self, host: str, call: Callable):
        with self.gate:
            lock = self.hosts.setdefault(host, threading.Lock())
        with lock:
            with self.gate:
                start = max(self.clock(), self.next_start, self.free.get(host, 0.0))
                self.next_start = start + self.pause
            self.sleep(max(0.0, start - self.clock()))
            try:
                return call()
            finally:
                self.free[host] = self.clock() + self.host_pause


def _rows(urls: Iterable[str], fetch: Callable[[str], Response], scheduler: Scheduler) -> list[tuple]:
    """A row of LANDED for each different URL, in order; a failure has no status and says why."""

    def one(url: str) -> tuple:
        try:
            r = scheduler.run(urlsplit(url).netloc.lower(), lambda: fetch(url))
            return url, r.final_url, r.status, r.content_type, r.body, None
        except Exception as e:  # noqa: BLE001  a failure of one URL is its row
            return url, None, None, None, None, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(max(1, scheduler.slots)) as pool:
        return list(pool.map(one, dict.fromkeys(urls)))


def land(spark: SparkSession, urls: Iterable[str], fetch: Callable[[str], Response] = plain_fetch, scheduler: Scheduler | None = None) -> DataFrame:
    """Rows of LANDED for each different URL, in order; a failure has no status and says why."""
    return spark.createDataFrame(_rows(urls, fetch, scheduler or Scheduler()), LANDED)


def frontier(urls: DataFrame, log: DataFrame) -> DataFrame:
    """url, host, state, attempts and next_at (ms) of each different url, by what has been landed (LOG) so far.

    state: new, landed, failed (no answer, to be asked again from next_at on) or given_up after TRIES attempts.
    """
    asked = urls.select("url").filter("url IS NOT NULL").distinct()
    seen = log.groupBy("url").agg(F.count("*").alias("attempts"), F.max(F.col("status").isNotNull()).alias("answered"), F.max("landed_at").alias("last"))
    rows = asked.join(seen, "url", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    state = F.when(F.col("attempts") == 0, "new").when(F.col("answered"), "landed").when(F.col("attempts") >= TRIES, "given_up").otherwise("failed")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    # The pause doubles with each attempt.
    again = F.coalesce(F.col("last"), F.lit(0)) + F.lit(AGAIN_MS) * F.expr("shiftleft(1L, CAST(least(attempts, 20) - 1 AS INT))")
    return rows.select("url", host.alias("host"), state.alias("state"), "attempts", F.when(state == "failed", again).otherwise(0).alias("next_at"))


def land_frontier(
    urls: DataFrame, folder: str, fetch: Callable[[str], Response] = plain_fetch, scheduler: Scheduler | None = None, chunk: int = CHUNK,
    clock: Callable[[], float] = time.time,
) -> dict[str, int]:
    """Lands what the table at `folder` (LOG) lacks of urls (url), in chunks that are written as they come.

    The table is the only state: after a crash a further run asks for what isn't there, and for failures that are due. Hosts
    take turns, so that a chunk keeps all slots busy; the driver holds one chunk's responses, however many URLs there are.
    """
    spark, scheduler = urls.sparkSession, scheduler or Scheduler()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    log = spark.read.schema(LOG).parquet(folder) if there else spark.createDataFrame([], LOG)
    due = frontier(urls, log).filter(F.col("state").isin("new", "failed") & (F.col("next_at") <= int(clock() * 1000)))
    queue = materialize(ranked(due.select("url", "host", "next_at"), [F.col("next_at"), F.col("url")], ["host"], "turn").orderBy("turn", "host"), "frontier")
    counts = {"asked": 0, "answered": 0, "failed": 0}
    waiting = queue.orderBy("turn", "host").select("url").toLocalIterator()
    while some := [r.url for r in islice(waiting, chunk)]:
        rows = [(*row, int(clock() * 1000)) for row in _rows(some, fetch, scheduler)]
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)
        answered = sum(r[2] is not None for r in rows)
        counts = {"asked": counts["asked"] + len(rows), "answered": counts["answered"] + answered, "failed": counts["failed"] + len(rows) - answered}
    discard(queue)
    return counts
