"""DuckDB SQL for the registered queries, written independently of the Spark expressions."""

from __future__ import annotations

from jobloom.functions.text import TITLE_BLACKLIST
from jobloom.schemas import LISTINGS
from jobloom.sources.views import NOW_MS, with_views

N = NOW_MS
# ECMAScript white space as a class of RE2.
W = r"\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
ACTIVE = f"status = 'active' AND expires_at > {N}"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{W}]+|[{W}]+$', '', 'g')"


def squeeze(x: str) -> str:
    return trim(f"regexp_replace({x}, '[{W}]+', ' ', 'g')")


def bare(x: str, by: str) -> str:
    """Without scripts and styles."""
    one = rf"regexp_replace({x}, '<script\b[^>]*>[\s\S]*?</script>', '{by}', 'gi')"
    return rf"regexp_replace({one}, '<style\b[^>]*>[\s\S]*?</style>', '{by}', 'gi')"


def stripped(x: str) -> str:
    tags = f"regexp_replace({bare(x, ' ')}, '<[^>]+>', ' ', 'g')"
    return squeeze(f"regexp_replace(regexp_replace({tags}, '&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi')")


def sanitized(x: str) -> str:
    return rf"""regexp_replace({bare(x, "")}, '[{W}]on[a-z]+[{W}]*=[{W}]*("[^\n]*?"|''[^\n]*?''|[^{W}>]+)', '', 'gi')"""


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def suffix(x: str) -> str:
    return f"substr(list_last(string_split({x}, ':')), 1, 8)"


def role(title: str = "title", i: str = "id") -> str:
    return f"{slug(title)} || '-' || {suffix(i)}"


def word(x: str, words: str) -> str:
    return rf"regexp_matches({x}, '\b(?:{words})\b', 'i')"


def iso(ms: str) -> str:
    return f"strftime(epoch_ms({ms}), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


ROW = (
    "l.id, l.company_id, title, location_city, location_country, location_is_remote, location_policy, comp_min, comp_max, "
    "comp_currency, ai_stack, ai_specialty, description_html, apply_url, posted_at, expires_at, "
    "c.slug AS company_slug, c.name AS company_name, c.website AS company_website, c.logo_url AS company_logo_url"
)
JOIN = "listings_v l JOIN companies_v c ON c.id = l.company_id"
RECENT = "ORDER BY posted_at DESC, l.id"
PAY = "coalesce(comp_max, comp_min, 0)"
SAID = f"title || ' ' || {stripped('description')}"

# The matchers, each a provider, a pattern and how its groups make the slug.
EMBED = r"/companies/([a-z0-9-]+)/jobs/[^\"''\\s<]+"
URLS = (
    ("waas", r"(?:www\.)?workatastartup\.com/companies/([a-z0-9-]+)"),
    ("greenhouse", r"boards\.greenhouse\.io/([a-z0-9-]+)"),
    ("greenhouse", r"job-boards\.greenhouse\.io/([a-z0-9-]+)"),
    ("greenhouse", r"([a-z0-9-]+)\.greenhouse\.io"),
    ("lever", r"jobs\.lever\.co/([a-z0-9-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([^/?#]+)"),
    ("smartrecruiters", r"(?:jobs|careers)\.smartrecruiters\.com/([a-z0-9-]+)"),
    ("workable", r"apply\.workable\.com/([a-z0-9-]+)"),
    ("workable", r"([a-z0-9-]+)\.workable\.com"),
)
GUARD = r"(?:^|[^a-z0-9])(careers?|jobs?|hiring|hire|roles?|positions?|openings?|we[-_]?are[-_]?hiring)(?:[^a-z0-9]|$)"


def detected(x: str, what: str) -> str:
    """The provider or the slug that a URL names, over the forms that the view holds."""
    cases = [(f"regexp_matches({x}, '{EMBED}', 'i')", "waas", f"regexp_extract({x}, '{EMBED}', 1, 'i')")]
    for provider, pattern in URLS:
        own = rf"^(?:https?://)?{pattern}(?:[/?#].*)?$"
        cases.append((f"regexp_matches({x}, '{own}', 'i')", provider, f"regexp_extract({x}, '{own}', 1, 'i')"))
    day = r"^(?:https?://)?([a-z0-9-]+)\.(wd[0-9]+)\.myworkdayjobs\.com/(?:[a-z]{2}-[A-Z]{2}/)?([^/?#]+)(?:[/?#].*)?$"
    cases.append((f"regexp_matches({x}, '{day}', 'i')", "workday", " || ':' || ".join(f"regexp_extract({x}, '{day}', {i}, 'i')" for i in (1, 2, 3))))
    site = r"^(?:https?://)?([a-z0-9-]+)\.notion\.site/([^/?#]+)(?:[/?#].*)?$"
    cases.append((f"regexp_matches({x}, '{site}', 'i') AND regexp_matches({x}, '{GUARD}', 'i')", "notion", f"regexp_extract({x}, '{site}', 1, 'i') || ':' || regexp_extract({x}, '{site}', 2, 'i')"))
    so = r"^(?:https?://)?(?:www\.)?notion\.so/([^/?#]+)/(?:[^/?#]+-)?([a-f0-9]{32})(?:[/?#].*)?$"
    cases.append((f"regexp_matches({x}, '{so}', 'i')", "notion", f"regexp_extract({x}, '{so}', 1, 'i') || ':' || regexp_extract({x}, '{so}', 2, 'i')"))
    body = r"https?://([a-z0-9-]+)\.greenhouse\.io\b"
    cases.append((f"regexp_matches({x}, '{body}', 'i')", "greenhouse", f"regexp_extract({x}, '{body}', 1, 'i')"))
    return "CASE " + " ".join(f"WHEN {test} THEN " + (f"'{p}'" if what == "provider" else s) for test, p, s in cases) + " END"


# The stack's tokens, and specialties with their words.
TOKENS = (
    "pytorch", "tensorflow", "jax", "triton", "cuda", "vllm", "tgi", "tensorrt", "xla", "mojo", "rust", "cuda kernels", "rlhf",
    "dpo", "lora", "flash attention", "mixture of experts", "moe", "transformers",
)
SPECIALTIES = (
    ("robotics", "robotics|robot|autonomous vehicle|motion planning|manipulation"),
    ("vision", "computer vision|vision model|image segmentation|ocr"),
    ("nlp", "nlp|natural language|llm|language model|transformers|prompt"),
    ("infra", "inference|serving|distributed systems|gpu|compiler|cuda|training infrastructure"),
    ("ops", "mlops|platform reliability|sre|on-call|incident response|observability"),
)


def stack(x: str) -> str:
    cases = ", ".join(f"CASE WHEN {word(x, t)} THEN '\"{t}\"' END" for t in TOKENS)
    return f"'[' || coalesce(array_to_string([t FOR t IN [{cases}] IF t IS NOT NULL], ','), '') || ']'"


def specialty(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {word(x, w)} THEN '{s}'" for s, w in SPECIALTIES) + " END"


PAY_RANGE = rf"\$(\d+)(k)?[{W}]?(?:-|to|–)[{W}]?\$?(\d+)(k)?"


def pay(x: str, i: int) -> str:
    g = lambda k: f"regexp_extract({x}, '{PAY_RANGE}', {k}, 'i')"
    return f"CASE WHEN regexp_matches({x}, '{PAY_RANGE}', 'i') THEN CAST({g(i)} AS BIGINT) * CASE WHEN {g(i + 1)} <> '' THEN 1000 ELSE 1 END END"


PLACE = rf"""p0 AS (SELECT *, {trim("regexp_replace(location, '[–—]', '-', 'g')")} AS t FROM raw_jobs_v),
p1 AS (SELECT *, coalesce({word("lower(t)", "hybrid")}, false) AS hybrid, coalesce({word("lower(t)", "remote")}, false) AS remote,
         {trim(f"regexp_replace(regexp_replace(t, '{chr(92)}b(?:remote|hybrid|on[- ]?site){chr(92)}b', '', 'gi'), '^[{W}:-]+|[{W}:-]+$', '', 'g')")} AS rest FROM p0),
p2 AS (SELECT *, [x FOR x IN [{trim("y")} FOR y IN string_split(rest, ',')] IF x <> ''] AS parts FROM p1),
p3 AS (SELECT *, CASE WHEN coalesce(rest, '') = '' THEN NULL WHEN len(parts) >= 2 THEN parts[1] WHEN (hybrid OR remote) AND len(parts) = 1 THEN NULL ELSE rest END AS city,
         CASE WHEN coalesce(rest, '') = '' THEN 'Unknown' WHEN len(parts) >= 2 THEN parts[len(parts)] WHEN (hybrid OR remote) AND len(parts) = 1 THEN parts[1] ELSE 'Unknown' END AS country,
         CASE WHEN hybrid OR remote THEN 1 ELSE 0 END AS is_remote, CASE WHEN hybrid THEN 'hybrid' WHEN remote THEN 'remote' ELSE 'onsite' END AS policy FROM p2)"""
POSTED = f"""coalesce(CASE WHEN posted_num > 1000000000000 THEN posted_num ELSE posted_num * 1000 END,
  CASE WHEN regexp_matches(posted_str, '^\\d{{4}}-') THEN epoch_ms(CAST(posted_str AS TIMESTAMP)) END, {N})"""
NORMALIZED = f"""{PLACE},
n0 AS (SELECT *, {sanitized("description")} AS html FROM p3),
n1 AS (SELECT *, title || ' ' || {stripped("html")} AS said, {POSTED} AS posted FROM n0),
n2 AS (SELECT seq, provider || ':' || provider_slug || ':' || provider_job_id AS id, company_id, title, city AS location_city, country AS location_country,
         is_remote AS location_is_remote, policy AS location_policy, {pay("title || ' ' || said", 1)} AS comp_min, {pay("title || ' ' || said", 3)} AS comp_max,
         CASE WHEN regexp_matches(said, '{PAY_RANGE}', 'i') THEN 'USD' END AS comp_currency, CASE WHEN {word("said", "equity")} THEN 1 END AS comp_equity,
         {stack("said")} AS ai_stack, {specialty("said")} AS ai_specialty, CAST(NULL AS VARCHAR) AS ai_compute_access, html AS description_html, apply_url, posted AS posted_at,
         posted + 2592000000 AS expires_at, posted AS updated_at, 'active' AS status FROM n1)"""
PROBE = f"""website IS NOT NULL AND trim(website) <> '' AND (careers_probe_at IS NULL OR careers_probe_at = 0
  OR coalesce(careers_probe_result NOT IN ('no_page', 'blocked', 'error'), true) OR careers_probe_at <= {N - 2592000000})"""
BATCH = f"regexp_replace(lower({trim('yc_batch')}), '[^a-z0-9]+', '-', 'g')"
POSTED_ON = f"""CASE WHEN regexp_matches(posted_str, '^\\d{{4}}-') THEN epoch_ms(CAST(posted_str AS TIMESTAMP))
  WHEN lower(posted_str) = 'posted today' THEN {N} WHEN lower(posted_str) = 'posted yesterday' THEN {N} - 86400000
  WHEN regexp_matches(posted_str, '^Posted \\d+\\+? Days? Ago$', 'i') THEN {N} - CAST(regexp_extract(posted_str, '(\\d+)', 1) AS BIGINT) * 86400000 END"""
KEY = "CAST(substr(id, 4) AS BIGINT)"
FRESH = f"""fresh AS (SELECT 'n-' || id AS id, CASE WHEN {KEY} % 6 = 0 THEN slug || '-new' ELSE slug END AS slug, upper(name) AS name, website,
  'https://new.example.com/careers' AS careers_url, created_at FROM companies_v WHERE {KEY} % 3 = 0)"""


def companies_after(careers: str) -> str:
    return f"""WITH {FRESH}
SELECT coalesce(c.id, f.id) AS id, coalesce(c.slug, f.slug) AS slug, coalesce(f.name, c.name) AS name,
  CASE WHEN f.id IS NULL THEN c.website ELSE f.website END AS website, {careers} AS careers_url, coalesce(c.created_at, f.created_at) AS created_at
FROM companies_v c FULL JOIN fresh f ON c.slug = f.slug"""


PAYMENTS = """e0 AS (SELECT 'evt_' || event_id AS event_id, CASE WHEN event_id // 2 % 3 = 0 THEN 'cs_' ELSE 'cs_p' END || (event_id // 2) AS session_id,
  CASE WHEN event_id % 2 = 0 THEN 'founding' ELSE 'standard' END AS tier, CAST(epoch_us(ts) // 1000 AS BIGINT) AS paid_at, user_id % 40 AS k
  FROM events WHERE event_type = 'purchase' AND event_id % 31 <> 3 AND event_id % 9 NOT IN (4, 5)),
e1 AS (SELECT *, CASE k % 4 WHEN 0 THEN 'https://customer-' || lpad(CAST(k + 1 AS VARCHAR), 9, '0') || '.example.com'
    WHEN 1 THEN 'https://customer-' || lpad(CAST(k + 1 AS VARCHAR), 9, '0') || '.example.com/about'
    WHEN 2 THEN 'https://new-' || k || '.example.org' ELSE 'https://new-' || (k - 1) || '.example.org/x' END AS site,
  event_id IN (SELECT stripe_event_id FROM paid_v) OR session_id IN (SELECT stripe_session_id FROM paid_v) AS known_payment FROM e0),
e2 AS (SELECT *, CASE WHEN NOT known_payment THEN row_number() OVER (PARTITION BY session_id, known_payment ORDER BY paid_at, event_id) END AS turn FROM e1),
e3 AS (SELECT *, regexp_extract(site, '^https://[^/]+') AS root FROM e2 WHERE turn = 1),
e4 AS (SELECT e3.*, c.id AS known FROM e3 LEFT JOIN companies_v c ON c.website = root),
-- Of the sites that no company has, those with a path make a company until the plain form has made one.
e5 AS (SELECT *, min(CASE WHEN known IS NULL AND site = root THEN (paid_at, event_id) END) OVER (PARTITION BY root) AS plain_at,
         min((paid_at, event_id)) OVER (PARTITION BY site) AS site_at FROM e4),
e6 AS (SELECT *, CASE WHEN known IS NOT NULL THEN NULL WHEN plain_at IS NULL OR site_at < plain_at THEN site_at ELSE plain_at END AS maker FROM e5),
m0 AS (SELECT DISTINCT maker FROM e6 WHERE maker IS NOT NULL),
m1 AS (SELECT maker, 'new-company-' || (k % 5) AS base FROM m0 JOIN e6 USING (maker) WHERE (e6.paid_at, e6.event_id) = maker),
m2 AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY maker) AS i FROM m1),
m3 AS (SELECT maker, CASE WHEN i = 1 THEN base ELSE base || '-' || i END AS slug FROM m2)"""

#: Columns that an upsert takes from the last row as they are.
KEPT = [f.name for f in LISTINGS.fields if f.name not in ("id", "company_id", "expires_at", "updated_at", "status")]
# Pages with an article, with main, with a heading alone, and with none of them: the main content of each.
CONTENT = r"""CASE page_id % 4 WHEN 0 THEN regexp_extract(html, '<article>([\s\S]*?)</article>', 1) WHEN 1 THEN regexp_extract(html, '<article>([\s\S]*?)</article>', 1)
  WHEN 2 THEN replace(regexp_extract(regexp_replace(html, '</?article>', '', 'g'), '(<h1>[\s\S]*?)(?:</body>|$)', 1), '</h1>', '</h1>' || chr(10))
  ELSE regexp_extract(regexp_replace(regexp_replace(html, '</?article>', '', 'g'), '(</?)h1>', '\1div>', 'g'), '<body>([\s\S]*?)(?:</body>|$)', 1) END"""

_RAW = {
    "recent_listings_page": f"SELECT {ROW} FROM {JOIN} WHERE {ACTIVE} {RECENT} LIMIT 50",
    "filtered_listings": f"SELECT {ROW} FROM {JOIN} WHERE {ACTIVE} AND ai_specialty = 'infra' AND location_is_remote = 1 AND {PAY} >= 100000 {RECENT} LIMIT 50",
    "second_page": f"SELECT {ROW} FROM {JOIN} WHERE {ACTIVE} AND {PAY} >= 50000 {RECENT} LIMIT 50 OFFSET 50",
    "remote_listings": f"SELECT location_policy, count(*) AS n FROM listings_v WHERE {ACTIVE} AND location_is_remote = 1 GROUP BY 1",
    "count_active": f"SELECT count(*) AS n FROM {JOIN} WHERE {ACTIVE} AND ai_specialty = 'nlp'",
    "all_active_feed": f"""SELECT id, CAST(to_json(r) AS VARCHAR) AS item FROM (SELECT r.id AS id, r FROM (SELECT {ROW} FROM {JOIN} WHERE {ACTIVE}) r)""",
    "feed_second_page": f"""SELECT id, posted_at FROM (SELECT l.id, posted_at, row_number() OVER ({RECENT}) AS k, count(*) OVER () AS n FROM {JOIN} WHERE {ACTIVE})
      WHERE n <= 1000 OR k BETWEEN 51 AND 100""",
    "all_feed_pages": f"""SELECT id, posted_at, (k - 1) // 50 + 1 AS page FROM (SELECT l.id, posted_at, row_number() OVER ({RECENT}) AS k FROM {JOIN} WHERE {ACTIVE})""",
    "companies_by_name": "SELECT id, slug, name, website FROM companies_v",
    "company_by_slug": "SELECT id, slug, name, website FROM companies_v WHERE slug = 'customer-000000042'",
    "company_active_listings": f"SELECT {ROW} FROM {JOIN} WHERE {ACTIVE} AND l.company_id = 'co-7'",
    "listing_by_role_slug": f"""SELECT id, company_slug, posted_at, role_slug, '/jobs/' || company_slug || '/' || role_slug AS path FROM (
      SELECT l.id, c.slug AS company_slug, posted_at, {role("title", "l.id")} AS role_slug,
        row_number() OVER (PARTITION BY c.slug, {role("title", "l.id")} ORDER BY posted_at DESC, l.id) AS k FROM {JOIN} WHERE {ACTIVE}) WHERE k = 1""",
    "listing_by_session": f"SELECT l.id, title, c.slug AS company_slug, stripe_session_id FROM {JOIN} JOIN paid_v p ON p.listing_id = l.id",
    "companies_with_careers": "SELECT id, slug, careers_url FROM companies_v WHERE careers_url IS NOT NULL",
    "probe_eligible": f"SELECT id, slug, yc_batch FROM companies_v WHERE {PROBE}",
    "headless_eligible": f"""SELECT id, slug, careers_probe_at FROM companies_v WHERE website IS NOT NULL AND trim(website) <> ''
      AND careers_probe_result IN ('no_page', 'error') AND careers_probe_at >= {N - 2592000000}""",
    "batch_filter": f"SELECT id, slug FROM companies_v WHERE {PROBE} AND {BATCH} = 'winter-2024' ORDER BY slug LIMIT 20",
    "empty_descriptions": f"SELECT id, apply_url FROM listings_v WHERE {ACTIVE} AND length(description_html) < 50",
    "provider_breakdown": f"SELECT {detected('careers_url', 'provider')} AS ats_provider, count(*) AS n FROM companies_v WHERE careers_url IS NOT NULL GROUP BY 1",
    "zero_filled_provider_totals": """SELECT p AS provider, count(seq) AS n FROM unnest(['greenhouse', 'lever', 'ashby', 'smartrecruiters', 'workable', 'workday', 'notion', 'waas', 'custom']) t(p)
      LEFT JOIN raw_jobs_v ON CASE WHEN provider IN ('waas', 'custom') THEN 'lever' ELSE provider END = p GROUP BY 1""",
    "probe_result_counts": """SELECT r AS careers_probe_result, count(id) AS n FROM unnest(['found_ats', 'found_custom', 'no_page', 'blocked', 'error']) t(r)
      LEFT JOIN companies_v ON careers_probe_result = r GROUP BY 1""",
    "headless_result_counts": """SELECT count(*) AS processed, count(*) FILTER (r IN ('found_ats', 'found_custom')) AS upgraded, count(*) FILTER (r = 'no_page') AS still_no_page,
      count(*) FILTER (r IN ('error', 'blocked')) AS errors FROM (SELECT careers_probe_result AS r FROM companies_v WHERE careers_probe_result IS NOT NULL)""",
    "careers_delta": """SELECT count(*) FILTER (careers_probe_result = 'found_ats') AS before, count(*) AS after,
      count(*) - count(*) FILTER (careers_probe_result = 'found_ats') AS delta FROM companies_v WHERE careers_url IS NOT NULL""",
    "slugify_role": f"SELECT id, {slug('title')} AS slug, {role()} AS role FROM listings_v",
    "id_suffix": f"SELECT id, {suffix('id')} AS suffix FROM listings_v",
    "format_comp": """SELECT id, CASE WHEN comp_min IS NULL AND comp_max IS NULL THEN 'Comp undisclosed' WHEN comp_max IS NULL THEN c || format('{:,}', comp_min) || '+'
      WHEN comp_min IS NULL THEN 'Up to ' || c || format('{:,}', comp_max) ELSE c || format('{:,}', comp_min) || '-' || c || format('{:,}', comp_max) END AS comp
      FROM (SELECT *, CASE WHEN coalesce(comp_currency, 'USD') = 'USD' THEN '$' ELSE comp_currency || ' ' END AS c FROM listings_v)""",
    "format_location": """SELECT id, CASE WHEN location_is_remote <> 0 THEN 'Remote' WHEN coalesce(location_city, '') <> '' THEN location_city || ', ' || location_country
      WHEN location_country <> '' THEN location_country ELSE location_policy END AS place FROM listings_v""",
    "format_posted": f"SELECT id, strftime(epoch_ms(posted_at), '%b %-d, %Y') AS posted, {iso('posted_at')} AS iso FROM listings_v",
    "normalize_location": f"WITH {PLACE} SELECT seq, city, country, is_remote, policy FROM p3",
    "normalize_comp": f"""SELECT seq, {pay("said", 1)} AS low, {pay("said", 3)} AS high, CASE WHEN regexp_matches(said, '{PAY_RANGE}', 'i') THEN 'USD' END AS currency,
      CASE WHEN {word("said", "equity")} THEN 1 END AS equity FROM (SELECT seq, {SAID} AS said FROM raw_jobs_v)""",
    "ai_stack": f"SELECT seq, {stack('said')} AS stack FROM (SELECT seq, {SAID} AS said FROM raw_jobs_v)",
    "ai_specialty": f"SELECT seq, {specialty('said')} AS specialty FROM (SELECT seq, {SAID} AS said FROM raw_jobs_v)",
    "normalize_jobs": f"WITH {NORMALIZED} SELECT * FROM n2",
    "strip_tags_pages": f"SELECT page_id, {stripped('html')} AS said FROM pages",
    "sanitize_pages": f"SELECT page_id, md5({sanitized('html')}) AS digest FROM pages",
    "decode_named_entities": """SELECT seq, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(description, '&nbsp;', ' ', 'gi'),
      '&quot;', '"', 'gi'), '&#39;', '''', 'g'), '&apos;', '''', 'gi'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&amp;', '&', 'gi') AS decoded FROM raw_jobs_v""",
    "escape_documents": f"SELECT page_id, md5({escaped('html')}) AS digest FROM pages",
    "article_main_content": r"SELECT page_id, md5(regexp_extract(html, '<article\b[^>]*>([\s\S]*?)</article>', 1, 'i')) AS digest FROM pages",
    "detect_ats": f"SELECT id, {detected('careers_url', 'provider')} AS provider, {detected('careers_url', 'slug')} AS provider_slug FROM companies_v",
    "stored_provider": f"""SELECT id, CASE WHEN careers_url IS NULL THEN NULL WHEN yc_batch IS NULL THEN 'custom' WHEN p IS NOT NULL THEN 'lever' END AS provider,
      CASE WHEN careers_url IS NULL THEN NULL WHEN yc_batch IS NULL THEN careers_url WHEN p IS NOT NULL THEN s END AS provider_slug
      FROM (SELECT *, {detected("careers_url", "provider")} AS p, {detected("careers_url", "slug")} AS s FROM companies_v)""",
    "careers_token": f"SELECT seq, regexp_matches(apply_url, '{GUARD}', 'i') AS in_url, regexp_matches(title, '{GUARD}', 'i') AS in_title FROM raw_jobs_v",
    "workday_posted_on": f"SELECT seq, {iso('ms')} AS iso FROM (SELECT seq, {POSTED_ON} AS ms FROM raw_jobs_v)",
    "parse_posted_at": f"SELECT seq, CAST({POSTED} AS BIGINT) AS posted_at FROM raw_jobs_v",
    "parse_ai_stack_json": """SELECT id, CAST(to_json([e ->> '$' FOR e IN CASE WHEN json_valid(ai_stack) AND json_type(CASE WHEN json_valid(ai_stack) THEN ai_stack END) = 'ARRAY'
        THEN json_extract(ai_stack, '$[*]') ELSE [] END IF json_type(e) = 'VARCHAR' AND e ->> '$' <> '']) AS VARCHAR) AS tokens FROM listings_v""",
    "event_props_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "draft_chunks_roundtrip": "SELECT doc_id, CAST(CAST(ceil(length(text) / 450) AS BIGINT) AS VARCHAR) AS n, CASE WHEN text <> '' THEN md5(text) END AS digest FROM documents",
    "jobposting_jsonld": f"""SELECT l.id, '{{"@context":"https://schema.org","@type":"JobPosting","title":' || to_json(title) || ',"description":' || to_json(description_html)
      || ',"datePosted":"' || {iso("posted_at")} || '","validThrough":"' || {iso("expires_at")} || '","hiringOrganization":{{"@type":"Organization","name":' || to_json(c.name)
      || CASE WHEN {trim("coalesce(c.website, '')")} <> '' THEN ',"sameAs":' || to_json({trim("c.website")}) ELSE '' END || '}}'
      || CASE WHEN location_is_remote = 0 AND location_country NOT IN ('', 'Unknown') THEN ',"jobLocation":{{"@type":"Place","address":{{"@type":"PostalAddress"'
         || CASE WHEN location_city IS NOT NULL THEN ',"addressLocality":' || to_json(location_city) ELSE '' END || ',"addressCountry":' || to_json(location_country) || '}}}}' ELSE '' END
      || CASE WHEN location_is_remote <> 0 THEN ',"jobLocationType":"TELECOMMUTE"' ELSE '' END
      || CASE WHEN comp_min IS NOT NULL OR comp_max IS NOT NULL THEN ',"baseSalary":{{"@type":"MonetaryAmount","value":{{"@type":"QuantitativeValue","unitText":"YEAR"'
         || CASE WHEN comp_min IS NOT NULL THEN ',"minValue":' || comp_min ELSE '' END || CASE WHEN comp_max IS NOT NULL THEN ',"maxValue":' || comp_max ELSE '' END || '}}'
         || CASE WHEN coalesce(comp_currency, '') <> '' THEN ',"currency":' || to_json(comp_currency) ELSE '' END || '}}' ELSE '' END
      || ',"employmentType":"FULL_TIME"}}' AS document FROM {JOIN}""",
    "description_to_html": f"""SELECT doc_id, md5(CASE WHEN len(p) = 0 THEN '<p></p>' ELSE array_to_string(['<p>' || replace({escaped("x")}, chr(10), '<br>') || '</p>' FOR x IN p], '') END) AS digest
      FROM (SELECT doc_id, [y FOR y IN [{trim("z")} FOR z IN string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '\\n{{2,}}')] IF y <> ''] AS p FROM documents)""",
    "parse_stack": f"""SELECT doc_id, array_to_string(list_slice([y FOR y IN [lower({trim("z")}) FOR z IN string_split_regex(text, '[,\\n]')] IF y <> '' AND length(y) <= 40], 1, 24), '|') AS stack FROM documents""",
    "blacklisted_titles": f"""WITH t AS (SELECT seq, CASE WHEN seq % 8 = 7 THEN title ELSE (['Sign In ', 'Apply now 2', 'See all 12 positions', '  Privacy--Policy', 'we''re hiring 7', 'Jobs 1st',
        'Folders and files' || chr(10) || '3 4'])[seq % 8 + 1] || CASE WHEN seq % 3 = 0 THEN ' ' || seq ELSE '' END END AS title FROM raw_jobs_v),
      w AS (SELECT seq, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS said FROM t),
      b AS (SELECT seq, said, [x FOR x IN string_split(said, ' ') IF NOT regexp_matches(x, '^[0-9]+$')] AS bare FROM w)
      SELECT seq, said IN ({", ".join(f"'{t}'" for t in TITLE_BLACKLIST)}) OR array_to_string(bare, ' ') IN ({", ".join(f"'{t}'" for t in TITLE_BLACKLIST)}) AS listed FROM b""",
    "page_ids": f"""SELECT id, CASE WHEN s = 'bravo:51f0d2ab7c3e4f88a6b9043d2c1e7f60' THEN '51f0d2ab-7c3e-4f88-a6b9-043d2c1e7f60' END AS page_id,
      CASE WHEN s = 'bravo:51f0d2ab7c3e4f88a6b9043d2c1e7f60' THEN 'https://www.notion.so/bravo/51f0d2ab7c3e4f88a6b9043d2c1e7f60'
           WHEN position(':' IN s) = 0 THEN 'https://www.notion.so/' || s ELSE 'https://' || split_part(s, ':', 1) || '.notion.site/' || substr(s, position(':' IN s) + 1) END AS page_url
      FROM (SELECT id, {detected("careers_url", "slug")} AS s FROM companies_v) WHERE s IS NOT NULL""",
    "optional_fields": f"""SELECT seq, nullif(substr({trim("location")}, 1, 6), '') AS place, CASE WHEN seq * 3500 <= 10000000 THEN CAST(seq * 3500 AS BIGINT) END AS large, CASE WHEN seq <= 10000000 THEN CAST(seq AS BIGINT) END AS amount FROM raw_jobs_v""",
    "upsert_listings": f"""WITH {NORMALIZED},
      b AS (SELECT * FROM n2 WHERE length({stripped("description_html")}) >= 100),
      g AS (SELECT id, count(*) AS n, arg_min(company_id, seq) AS first_company, max(seq) AS last FROM b GROUP BY id),
      u AS (SELECT b.*, g.n, g.first_company FROM g JOIN b ON b.id = g.id AND b.seq = g.last)
      SELECT coalesce(l.id, u.id) AS id, coalesce(l.company_id, u.first_company) AS company_id, {", ".join(f"CASE WHEN u.id IS NULL THEN l.{c} ELSE u.{c} END AS {c}" for c in KEPT)},
        CASE WHEN u.id IS NULL THEN l.expires_at WHEN l.id IS NOT NULL OR u.n > 1 THEN {N + 2592000000} ELSE u.expires_at END AS expires_at,
        CASE WHEN u.id IS NULL THEN l.updated_at ELSE {N} END AS updated_at, CASE WHEN u.id IS NULL THEN l.status ELSE 'active' END AS status
      FROM listings_v l FULL JOIN u ON l.id = u.id""",
    "upsert_companies_keep_careers": companies_after("CASE WHEN c.id IS NULL THEN f.careers_url ELSE c.careers_url END"),
    "upsert_companies_overwrite": companies_after("CASE WHEN f.id IS NULL THEN c.careers_url ELSE f.careers_url END"),
    "runs_of_jobs": f"""WITH s AS (SELECT CASE WHEN status = 'active' AND CASE WHEN expires_at < 10000000000 THEN expires_at * 1000 ELSE expires_at END < {N} THEN 'expired' ELSE status END AS status,
        expires_at < 10000000000 AS wrong FROM listings_v),
      c AS (SELECT string_agg('"' || status || '": ' || n, ', ' ORDER BY status) AS parts FROM (SELECT status, count(*) AS n FROM s GROUP BY status))
      SELECT 'day:repair' AS id, 'repair' AS job, CAST(1 AS BIGINT) AS base, '{{"repaired": ' || count(*) FILTER (wrong) || '}}' AS counters FROM s
      UNION ALL SELECT 'day:sweep', 'sweep', 2, '{{' || parts || '}}' FROM c""",
    "sweep_expired": f"SELECT CASE WHEN status = 'active' AND expires_at < {N} THEN 'expired' ELSE status END AS status, count(*) AS n FROM listings_v GROUP BY 1",
    "repair_units": "SELECT id, CASE WHEN expires_at < 10000000000 THEN expires_at * 1000 ELSE expires_at END AS expires_at FROM listings_v",
    "unit_counts": "SELECT count(*) FILTER (expires_at < 10000000000) AS in_seconds, count(*) AS n FROM listings_v",
    "backfill_outcome": f"""SELECT CASE WHEN page_id % 7 = 0 THEN 'expired' WHEN page_id IS NULL OR page_id % 11 = 0 THEN 'error'
        WHEN length({stripped(sanitized("(" + CONTENT + ")"))}) >= 200 THEN 'filled' ELSE 'expired' END AS outcome, count(*) AS n
      FROM listings_v LEFT JOIN pages ON apply_url = 'https://customer.example.com/jobs/' || page_id WHERE {ACTIVE} AND length(description_html) < 50 GROUP BY 1""",
    "apply_probe_results": f"""SELECT id, CASE WHEN yc_batch = 'Fall 2025' THEN NULL ELSE careers_url END AS careers_url, CASE WHEN yc_batch = 'Fall 2025' THEN {N} ELSE careers_probe_at END AS careers_probe_at,
      CASE WHEN yc_batch = 'Fall 2025' THEN 'no_page' ELSE careers_probe_result END AS careers_probe_result FROM companies_v""",
    "fulfil_paid": f"""WITH {PAYMENTS}
      SELECT 'pay_' || substr(sha256('pay' || event_id), 1, 32) AS id, 'lst_' || substr(sha256('lst' || event_id), 1, 32) AS listing_id, event_id AS stripe_event_id, tier, CAST(CASE tier WHEN 'founding' THEN 19900 ELSE 29900 END AS BIGINT) AS amount_cents, 'usd' AS currency, paid_at, paid_at + 2592000000 AS expires_at,
        known AS known_company, slug FROM e6 LEFT JOIN m3 USING (maker)""",
    "fulfil_results": f"WITH {PAYMENTS} SELECT CASE WHEN turn = 1 THEN 'inserted' ELSE 'duplicate' END AS result, count(*) AS n FROM e2 GROUP BY 1",
    "streamed_payments": """WITH e AS (SELECT 'evt_' || event_id AS stripe_event_id, CASE WHEN event_id // 2 % 3 = 0 THEN 'cs_' ELSE 'cs_p' END || (event_id // 2) AS stripe_session_id,
        CASE WHEN event_id % 2 = 0 THEN 'founding' ELSE 'standard' END AS tier, CAST(epoch_us(ts) // 1000 AS BIGINT) AS paid_at
        FROM events WHERE event_type = 'purchase' AND event_id % 31 <> 3 AND event_id % 9 NOT IN (4, 5)),
      t AS (SELECT *, row_number() OVER (PARTITION BY stripe_session_id ORDER BY paid_at, stripe_event_id) AS turn FROM e)
      SELECT stripe_event_id, stripe_session_id, tier, paid_at FROM t WHERE turn = 1""",
    "payment_errors": """SELECT CASE event_id % 9 WHEN 4 THEN 'draft.location_policy invalid' WHEN 5 THEN 'missing draft' END AS error,
      CAST(sum(CASE WHEN epoch_us(ts) // 1000 % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM events WHERE event_type = 'purchase' AND event_id % 31 <> 3 GROUP BY 1""",
    "founding_tier": "SELECT id, CASE WHEN row_number() OVER (ORDER BY paid_at, stripe_event_id) <= 50 THEN 'founding' ELSE 'standard' END AS tier_by_order FROM paid_v",
    "founding_slots": "SELECT 'paid' AS after, greatest(0, 50 - count(*)) AS seats_left FROM paid_v UNION ALL SELECT 'nation', greatest(0, 50 - count(*)) FROM nation",
    "fk_violations": "SELECT id, listing_id || 'x' AS listing_id FROM paid_v WHERE amount_cents = 19900",
    "cascade_delete": "SELECT count(*) AS n FROM listings_v WHERE company_id NOT IN (SELECT id FROM companies_v WHERE yc_batch IS NULL)",
    "check_violations": """SELECT id, CASE WHEN comp_equity IS NOT NULL THEN 'location_policy is out of range' ELSE 'expires_at is in seconds' END AS breach
      FROM listings_v WHERE comp_equity IS NOT NULL OR expires_at < 10000000000""",
    "duplicate_keys": "SELECT provider || ':' || provider_slug || ':' || provider_job_id AS key, count(*) AS n FROM raw_jobs_v GROUP BY 1 HAVING count(*) > 1",
    "greenhouse_jobs": """SELECT company_id AS provider_slug, CAST(seq AS VARCHAR) AS provider_job_id, title, location,
      replace(replace(replace(replace(replace(description, '&nbsp;', ' '), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS description, '2026-04-10' AS posted_str FROM raw_jobs_v""",
    "custom_jobs": f"""SELECT 'https://c' || seq || '.example.com/careers' AS provider_slug, title,
      CASE WHEN regexp_matches({squeeze("location")}, '(remote|anywhere|hybrid|on[- ]?site|[A-Z][a-z]+,?\\s*[A-Z]{{2,}})', 'i') THEN {squeeze("location")} END AS location,
      'https://c' || seq || '.example.com/jobs/' || seq AS apply_url FROM raw_jobs_v WHERE provider = 'custom'""",
    "jsonld_jobs": "SELECT title, apply_url, CAST(seq AS VARCHAR) AS description, '2026-04-10' AS posted_str FROM raw_jobs_v WHERE provider = 'custom'",
    "notion_jobs": """SELECT CAST(seq AS VARCHAR) AS provider_slug, substr(md5(CAST(seq AS VARCHAR)), 1, 8) AS provider_job_id, title, 'https://www.notion.so/' || md5(CAST(seq AS VARCHAR)) AS apply_url
      FROM raw_jobs_v WHERE provider = 'notion'""",
    "robots_rules": r"""SELECT page_id, NOT starts_with('/' || page_id, '/' || (page_id % 10)) AS by_id,
      NOT (regexp_matches(p, '^/fr/.*/x$') OR starts_with(p, '/' || (page_id % 10))) AS by_path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS p FROM pages)""",
    "careers_probe": """WITH c AS (SELECT *, CAST(substr(id, 4) AS BIGINT) AS n FROM companies_v),
      r AS (SELECT *, CASE WHEN website LIKE 'https%' THEN n % 4 END AS k, website LIKE 'https%' AND n % 3 = 0 AND n % 5 <> 0 AS shut,
        CASE n % 4 WHEN 0 THEN length('<a href="https://jobs.lever.co/">Jobs</a>') + length(slug) WHEN 1 THEN length('<a href="/about">About</a>') WHEN 2 THEN length('<p>Hello</p>') END AS home,
        website || '/ ' || website || '/careers' AS first_two, website || '/jobs ' || website || '/join ' || website || '/work ' || website || '/hiring https://www.ycombinator.com/companies/' || slug || '/jobs' AS others FROM c)
      SELECT id, CASE WHEN k = 0 THEN 'https://jobs.lever.co/' || slug WHEN k = 1 AND NOT shut THEN website || '/careers' END AS careers_url,
        CASE WHEN k = 0 THEN 'lever' WHEN k = 1 AND NOT shut THEN 'custom' END AS ats_provider,
        CASE WHEN k = 0 THEN 'found_ats' WHEN k = 1 AND NOT shut THEN 'found_custom' WHEN k IN (1, 2) AND shut THEN 'blocked' WHEN website IS NULL THEN 'no_page' ELSE 'error' END AS result,
        CASE WHEN k IS NULL THEN '' WHEN k IN (0, 3) THEN website || '/' WHEN k = 1 AND NOT shut THEN first_two ELSE first_two || ' ' || others END AS checked,
        CASE WHEN k IN (0, 2) OR k = 1 AND shut THEN home WHEN k = 1 THEN home + length('<h1>Open positions</h1>') ELSE 0 END AS html_size FROM r""",
    "provider_dispatch": f"""WITH {NORMALIZED}, b AS (SELECT split_part(id, ':', 1) AS p FROM n2 WHERE length({stripped("description_html")}) >= 100)
      SELECT t.p AS provider, count(b.p) AS n FROM unnest(['greenhouse', 'lever', 'ashby', 'smartrecruiters', 'workable', 'workday', 'notion', 'waas', 'custom']) t(p)
      LEFT JOIN b ON b.p = t.p GROUP BY 1""",
    "company_routes": "SELECT slug, '/companies/' || slug AS path FROM companies_v",
    "sitemap_dates": f"""WITH r AS (SELECT 'https://jobs.example.com/jobs/' || c.slug || '/' || {role("title", "l.id")} AS u, l.id, updated_at, {ACTIVE} AS on_ FROM {JOIN}),
      d AS (SELECT u, max(updated_at) AS last FROM r WHERE on_ GROUP BY u)
      SELECT r.u || CASE WHEN ends_with(id, '1') THEN '/' ELSE '' END AS url, {iso("last")} AS lastmod FROM r LEFT JOIN d ON d.u = r.u""",
    "foreign_board_urls": """SELECT id, url AS apply_url FROM (SELECT id, status, CASE WHEN comp_equity IS NULL THEN 'https://x.com/COMPANIES/a/jobs/1'
        WHEN ai_specialty IS NULL THEN 'https://WorkAtAStartup.com/companies/a/jobs/1' ELSE apply_url END AS url FROM listings_v)
      WHERE status = 'active' AND url ILIKE '%/companies/%/jobs/%' AND url NOT ILIKE '%workatastartup.com%'""",
    "quarantined_payloads": """SELECT CAST(event_id AS VARCHAR) AS slug, CASE WHEN event_id % 5 = 0 THEN 'no JSON' ELSE 'no body' END AS parse_error FROM events
      WHERE event_id % 5 = 0 OR event_id % 7 = 0""",
    "website_candidates": """SELECT slug, CAST(i - 1 AS INTEGER) AS place, website || (['/', '/careers', '/jobs', '/join', '/work', '/hiring'])[i] AS url
      FROM (SELECT slug, website, unnest([1, 2, 3, 4, 5, 6]) AS i FROM companies_v WHERE website LIKE 'https%')""",
    "board_jobs": f"""SELECT 'c' || seq AS provider_slug, CAST(seq AS VARCHAR) AS provider_job_id, title, nullif({squeeze("location")}, '') AS location,
      'https://www.workatastartup.com/application?signup_job_id=' || seq AS apply_url FROM raw_jobs_v WHERE provider = 'waas'""",
}
#: Upserted, and then swept; the store takes no expiry in seconds.
_RAW["stored_upsert"] = f"""SELECT id, company_id, title, CASE WHEN status = 'active' AND expires_at < {N} THEN 'expired' ELSE status END AS status, expires_at, updated_at
  FROM ({_RAW["upsert_listings"].replace("FROM listings_v l FULL JOIN", "FROM (SELECT * FROM listings_v WHERE expires_at >= 10000000000) l FULL JOIN")})"""
_RAW["sql_search"] = f"""SELECT l.id, '/jobs/' || c.slug || '/' || {role("title", "l.id")} AS path, regexp_replace(lower(trim(coalesce(yc_batch, ''))), '[^a-z0-9]+', '-', 'g') AS batch,
    CASE WHEN expires_at < 10000000000 THEN expires_at * 1000 ELSE expires_at END AS expires_at, comp AS pay, place
  FROM listings_v l JOIN companies_v c ON c.id = l.company_id JOIN ({_RAW["format_comp"]}) f ON f.id = l.id JOIN ({_RAW["format_location"]}) p ON p.id = l.id
  WHERE {ACTIVE}"""
_RAW["frontier_states"] = f"""SELECT 'https://H' || (event_id % 50) || '.com/' || event_id AS url, 'h' || (event_id % 50) || '.com' AS host,
    CASE WHEN event_id % 3 = 0 THEN 'new' WHEN event_id % 3 = 1 THEN 'landed' WHEN event_id % 6 = 5 THEN 'given_up' ELSE 'failed' END AS state,
    CAST(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE event_id % 6 END AS BIGINT) AS attempts, CAST(CASE WHEN event_id % 6 = 2 THEN {N} + 2 + 120000 ELSE 0 END AS BIGINT) AS next_at FROM events"""
SQL = {name: with_views(sql) for name, sql in _RAW.items()}
