"""Careers-page probe over landed pages: which board, or own page, lists a company's jobs.

Pages are judged once each, whoever asks for them. A company's candidates are visited in the order in which they are
queued: those of its homepage first, then those that visited pages name. The order is that of a breadth-first walk, so
whole levels are expanded at a time and the walk's end is the first page that decides. It goes on until no undecided
company has a URL that it hasn't seen; only landed pages name new ones, so it ends. Nothing is fetched here: `pages`
holds what a fetcher landed (url, final_url, status, content_type, body; status null after a transport error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions import detect, html
from jobloom.functions.text import let, truthy
from jobloom.sources.shared import discard, materialize, one_row

# Where careers pages usually are, and the accelerator's own job pages.
CAREERS_PATHS = ("/careers", "/jobs", "/join", "/work", "/hiring")
YC_JOBS = "https://www.ycombinator.com/companies"
RENDER_BELOW = 30_720
COMPACT = 8  # levels after which what the walk has written is put into one table


def is_html(content_type: Column) -> Column:
    return truthy(content_type).isNull() | content_type.rlike("(?i)(?:text/html|application/xhtml\\+xml)")


def is_yc_jobs_page(url: Column) -> Column:
    return url.startswith(f"{YC_JOBS}/") & url.rlike(r"/jobs(?:[/?#]|\z)")


def website_url(website: Column) -> Column:
    """The website as a URL, https where it names no scheme; null where it can't be one."""
    url = F.when(website.rlike("^(?i)[a-z][a-z0-9+.-]*:"), website).otherwise(F.concat(F.lit("https://"), website))
    root = F.regexp_extract(url, r"^(?i)(https?://[^/?#\s]+)([^\s]*)\z", 1)
    path = F.regexp_extract(url, r"^(?i)(https?://[^/?#\s]+)([^\s]*)\z", 2)
    return F.when(root != "", F.concat(F.lower(root), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?i)(https?://[^/?#]+)", 1))


def path_of(url: Column) -> Column:
    return F.coalesce(truthy(F.regexp_extract(url, r"^(?i)https?://[^/?#]+(/[^?#]*)", 1)), F.lit("/"))


def judge(pages: DataFrame) -> DataFrame:
    """For each page: ok, html, size, the careers links on it, and found: struct<url, provider> in either order of tests."""
    rows = one_row(pages, "url").withColumns({
        "final_url": F.coalesce("final_url", "url"), "ok": F.coalesce(F.col("status").between(200, 299), F.lit(False)), "html": is_html(F.col("content_type")),
    })
    rows = rows.withColumn("size", F.when(F.col("ok") & F.col("html"), F.length("body")).otherwise(0))
    readable = F.col("ok") & F.col("html") & F.col("body").isNotNull()
    rows = rows.withColumn("links", html.links_col(F.when(readable, F.col("body")), F.col("final_url")))
    pair = lambda url, provider: F.struct(url.alias("url"), provider.alias("provider"))
    boards = F.transform("links", lambda link: pair(link["url"], detect.detect(link["url"])["provider"]))
    embed = F.when(F.col("ok") & F.col("html"), detect.detect_embed(F.col("body")))
    on_page = lambda found, url, provider: F.when(found.isNotNull(), pair(url, provider))
    rows = rows.withColumns({
        "by_url": F.when(F.col("ok"), let(detect.detect(F.col("final_url")), lambda d: on_page(d, F.col("final_url"), d["provider"]))),
        "embed": let(embed, lambda d: on_page(d, detect.embed_company_url(d["slug"]), F.lit("waas"))),
        "yc": F.when(F.col("ok") & F.col("html") & is_yc_jobs_page(F.col("final_url")), pair(F.col("final_url"), F.lit("custom"))),
        "linked": F.get(F.filter(boards, lambda b: b["provider"].isNotNull()), F.lit(0)),
        "career_links": F.transform(F.filter("links", lambda link: link["careers"]), lambda link: link["url"]),
    })
    # The costly test, only where no other decides.
    undecided = readable & F.coalesce("by_url", "embed", "yc", "linked").isNull()
    rows = rows.withColumn("shows", html.looks_like_careers_col(F.when(undecided, F.col("body")), F.col("final_url")))
    own = F.when(F.col("shows"), pair(F.col("final_url"), F.lit("custom")))
    return rows.select(
        "url", "final_url", "status", "ok", "html", "size", "career_links",
        F.coalesce("embed", "by_url", "linked").alias("home_found"), F.coalesce(F.col("by_url"), F.col("yc"), F.col("embed"), F.col("linked"), own).alias("found"),
    )


def robots_policies(robots: DataFrame) -> DataFrame:
    """origin and its rules from landed robots.txt files (origin, status, body); what isn't there allows all."""
    rows = robots.filter(F.col("status").between(200, 299) & F.col("body").isNotNull())
    return rows.groupBy("origin").agg(F.min("body").alias("body")).select("origin", html.robots_rules_col(F.col("body")).alias("rules"))


def probe(companies: DataFrame, pages: DataFrame, robots: DataFrame) -> DataFrame:
    """id, slug, careers_url, ats_provider, result, checked and html_size of each company (id, slug, website)."""
    kept: list[DataFrame] = []

    def held(df: DataFrame, label: str) -> DataFrame:
        kept.append(materialize(df, label))
        return kept[-1]

    judged = held(judge(pages), "judged")
    sites = companies.select("id", "slug", "website", website_url(F.col("website")).alias("site"))
    no_site = truthy(F.col("website")).isNull()
    home = sites.join(judged.withColumnRenamed("url", "site"), "site", "left")
    hit, failed = F.col("home_found").isNotNull(), F.col("status").isNull()
    verdict = (
        F.when(no_site, "no_page").when(F.col("site").isNull() | failed, "error")
        .when(F.col("ok") & F.col("html") & hit, "found_ats").when(F.col("status").between(400, 599), "no_page")
    )
    home = held(home.withColumn("result", verdict), "homepages")
    base = origin(F.col("final_url"))
    usual = F.when(F.col("ok") & F.col("html"), F.array(*[F.concat(base, F.lit(p)) for p in CAREERS_PATHS])).otherwise(F.array().cast("array<string>"))
    queue = F.concat(usual, F.coalesce("career_links", F.array().cast("array<string>")), F.array(F.concat(F.lit(f"{YC_JOBS}/"), "slug", F.lit("/jobs"))))
    level = home.filter("result IS NULL").select("id", "site", F.posexplode(queue).alias("place", "url"))
    level = level.groupBy("id", "site", "url").agg(F.min("place").cast("bigint").alias("place"))
    visited, seen, levels = None, level.select("id", "url"), 0
    rules = robots_policies(robots)
    event = F.when(F.col("blocked"), "blocked").when(F.col("status").isNull(), "error").when(F.col("found").isNotNull(), "hit").when(F.col("status").between(400, 599), "stop").otherwise("none")
    while True:
        level = level.withColumn("place", F.lit(levels << 32).cast("bigint") + F.row_number().over(Window.partitionBy("id").orderBy("place")))
        rows = level.withColumn("origin", origin(F.col("site"))).join(rules, "origin", "left").join(judged, "url", "left")
        blocked = F.col("rules").isNotNull() & ~html.allowed_by_robots(F.col("rules"), path_of(F.col("url")))
        rows = rows.withColumn("blocked", F.coalesce(blocked, F.lit(False))).withColumn("event", event)
        rows = held(rows.drop("rules", "origin"), "visited")
        visited = rows if visited is None else visited.unionByName(rows)
        more = rows.filter("NOT blocked AND ok AND html AND found IS NULL")
        more = more.select("id", "site", "place", F.posexplode("career_links").alias("k", "url"))
        more = more.groupBy("id", "site", "url").agg(F.min(F.struct("place", "k")).alias("place")).join(seen, ["id", "url"], "left_anti")
        # Whoever is decided is done: all that is queued lies behind.
        more = held(more.join(rows.filter("event IN ('hit', 'stop')").select("id"), "id", "left_anti"), "queued")
        if more.isEmpty():
            break
        levels += 1
        seen, level = seen.union(more.select("id", "url")), more
        if levels % COMPACT == 0:
            seen, visited = held(seen, "seen"), held(visited, "visited")
    ends = visited.filter("event IN ('hit', 'stop')").groupBy("id").agg(F.min("place").alias("end_place"), F.min_by(F.struct("event", "found"), "place").alias("end"))
    walked = visited.join(ends, "id", "left").filter("end_place IS NULL OR place <= end_place")
    ended = walked.groupBy("id").agg(
        F.first("end").alias("end"), F.count_if(F.col("event") == "blocked").alias("n_blocked"), F.count_if(F.col("event") == "error").alias("n_error"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda s: s["url"]).alias("urls"),
        F.sum(F.when(F.col("event") != "blocked", F.coalesce("size", F.lit(0))).otherwise(0)).alias("bytes"),
    )
    out = home.join(ended, "id", "left")
    won = (F.col("result") == "found_ats") | (F.col("end.event") == "hit")
    found = F.when(F.col("result") == "found_ats", F.col("home_found")).when(F.col("end.event") == "hit", F.col("end.found"))
    result = F.coalesce(
        "result", F.when(F.col("end.event") == "hit", F.when(found["provider"] == "custom", "found_custom").otherwise("found_ats")),
        F.when(F.col("n_blocked") > 0, "blocked").when(F.col("n_error") > 0, "error").otherwise("no_page"),
    )
    first = F.when(F.col("site").isNotNull() & ~no_site, F.array("site")).otherwise(F.array().cast("array<string>"))
    out = out.select(
        "id", "slug", "site", F.when(won, found["url"]).alias("careers_url"), F.when(won, found["provider"]).alias("ats_provider"), result.alias("result"),
        F.concat(first, F.coalesce("urls", F.array().cast("array<string>"))).alias("checked"), (F.coalesce("size", F.lit(0)) + F.coalesce("bytes", F.lit(0))).alias("html_size"),
    )
    out = materialize(out, "probed")
    discard(*kept)
    return out


def render_urls(sites: DataFrame) -> DataFrame:
    """id, place and url: what to render for each of sites (id, slug, site), in the order in which it counts."""
    urls = F.array(F.concat(F.lit(f"{YC_JOBS}/"), "slug", F.lit("/jobs")), F.col("site"), F.concat(origin(F.col("site")), F.lit("/careers")))
    return sites.select("id", F.posexplode(F.array_distinct(F.array_compact(urls))).alias("place", "url"))


def render_candidates(outcomes: DataFrame) -> DataFrame:
    """What to render after a probe: companies without a page that showed less than RENDER_BELOW of HTML; url by place."""
    return render_urls(outcomes.filter((F.col("result") == "no_page") & (F.col("html_size") < RENDER_BELOW)))


def after_render(outcomes: DataFrame, rendered: DataFrame) -> DataFrame:
    """outcomes, improved by rendered pages (url, final_url, body): the first candidate that decides."""
    return _improved(outcomes, render_candidates(outcomes), rendered)


def second_pass(companies: DataFrame, pages: DataFrame, robots: DataFrame, rendered: DataFrame) -> DataFrame:
    """Companies that an earlier probe left without a page, or with an error, probed anew, and then by their rendered pages.

    The plain probe comes first, as the site may have changed; whoever has no page after it, and showed less than
    RENDER_BELOW of HTML, is decided by the first rendered page that shows one. So is whoever ends as an error only because
    URLs weren't landed at all, not even as failures.
    """
    outcomes = materialize(probe(companies, pages, robots), "probed-anew")
    errors = outcomes.filter((F.col("result") == "error") & F.col("site").isNotNull() & (F.col("html_size") < RENDER_BELOW))
    failed = one_row(pages, "url").filter("status IS NULL").select("url")
    failed = errors.select("id", F.explode("checked").alias("url")).join(failed, "url", "left_semi").select("id")
    unasked = errors.join(failed, "id", "left_anti").select("id", "slug", "site")
    return _improved(outcomes, render_candidates(outcomes).unionByName(render_urls(unasked)), rendered)


def _improved(outcomes: DataFrame, candidates: DataFrame, rendered: DataFrame) -> DataFrame:
    pages = rendered.select("url", "final_url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), "body")
    hits = candidates.join(judge(pages).select("url", "found"), "url").filter("found IS NOT NULL")
    best = hits.groupBy("id").agg(F.min_by("found", "place").alias("rendered"))
    rows = outcomes.join(best, "id", "left")
    hit = F.col("rendered").isNotNull()
    return rows.withColumns({
        "careers_url": F.when(hit, F.col("rendered.url")).otherwise(F.col("careers_url")),
        "ats_provider": F.when(hit, F.col("rendered.provider")).otherwise(F.col("ats_provider")),
        "result": F.when(hit & (F.col("rendered.provider") == "custom"), "found_custom").when(hit, "found_ats").otherwise(F.col("result")),
    }).select(*outcomes.columns)
