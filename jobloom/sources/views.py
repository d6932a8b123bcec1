"""The engine's tables as views over the star-schema tables: one portable SQL text for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from jobloom.session import prepare

#: "Now" of all registered queries: 2001-07-25T00:00:00Z.
NOW_MS = 996019200000
SPARK_MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)"
DUCKDB_MS = "epoch_ms(o_orderdate)"

VIEWS = {
    "companies_v": r"""
SELECT 'co-' || CAST(c_custkey AS STRING) AS id, lower(replace(c_name, '#', '-')) AS slug, c_name AS name,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Winter 2024' WHEN 2 THEN 'Summer 2024'
       WHEN 3 THEN 'Spring 2025' ELSE 'Fall 2025' END AS yc_batch,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN '   '
       ELSE 'https://' || lower(replace(c_name, '#', '-')) || '.example.com' END AS website,
  CAST(NULL AS STRING) AS logo_url, n_name AS description,
  CASE c_custkey % 16
    WHEN 0 THEN NULL
    WHEN 1 THEN 'https://boards.greenhouse.io/' || lower(replace(c_name, '#', '-'))
    WHEN 2 THEN 'https://' || lower(replace(c_name, '#', '-')) || '.greenhouse.io/jobs'
    WHEN 3 THEN 'https://jobs.lever.co/' || lower(replace(c_name, '#', '-')) || '/123'
    WHEN 4 THEN 'https://jobs.ashbyhq.com/' || lower(replace(c_name, '#', '-'))
    WHEN 5 THEN 'https://jobs.smartrecruiters.com/' || lower(replace(c_name, '#', '-'))
    WHEN 6 THEN 'https://apply.workable.com/' || lower(replace(c_name, '#', '-'))
    WHEN 7 THEN 'https://bravo.wd5.myworkdayjobs.com/en-US/Site' || CAST(c_custkey AS STRING)
    WHEN 8 THEN 'https://delta-labs.notion.site/delta-jobs-' || CAST(c_custkey AS STRING)
    WHEN 9 THEN 'https://delta-labs.notion.site/winter-guide'
    WHEN 10 THEN 'https://www.notion.so/bravo/Careers-51f0d2ab7c3e4f88a6b9043d2c1e7f60'
    WHEN 11 THEN 'https://www.workatastartup.com/companies/' || lower(replace(c_name, '#', '-'))
    WHEN 12 THEN 'https://example.com/companies/bravo/jobs/first-engineer'
    WHEN 13 THEN 'https://example.com/companies/bravo/jobs/lead-engineer'
    WHEN 14 THEN 'https://boards.greenhouse.io'
    ELSE 'https://' || lower(replace(c_name, '#', '-')) || '.example.com/careers' END AS careers_url,
  CAST(NULL AS STRING) AS ats_provider,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(990000000000 + (c_custkey % 80) * 86400000 AS BIGINT) END AS careers_probe_at,
  CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'found_ats' WHEN 2 THEN 'found_custom'
       WHEN 3 THEN 'no_page' WHEN 4 THEN 'blocked' ELSE 'error' END AS careers_probe_result,
  CAST(800000000000 + c_custkey * 1000 AS BIGINT) AS created_at
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "listings_v": r"""
SELECT
  CASE WHEN o_orderkey % 13 = 0 THEN 'lst_' || CAST(10000000 + o_orderkey AS STRING)
       ELSE 'greenhouse:customer:' || CAST(4253300000 + o_orderkey AS STRING) END AS id,
  'co-' || CAST(o_custkey AS STRING) AS company_id,
  CASE o_orderkey % 8
    WHEN 0 THEN 'Senior ML Engineer' WHEN 1 THEN 'Battery, Motor & Sensor (BMS) Engineer'
    WHEN 2 THEN 'Research Scientist, NLP' WHEN 3 THEN '  Robotics -- Lead  '
    WHEN 4 THEN 'Ingénieur données' WHEN 5 THEN 'Platform/Infra SRE'
    WHEN 6 THEN 'Computer Vision Intern' ELSE 'C++ & CUDA kernels dev' END AS title,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'New York' WHEN 2 THEN '' ELSE 'Paris' END AS location_city,
  CASE o_orderkey % 5 WHEN 0 THEN 'Unknown' WHEN 1 THEN '' WHEN 2 THEN 'FR' ELSE 'US' END AS location_country,
  CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS location_is_remote,
  CASE o_orderkey % 3 WHEN 0 THEN 'onsite' WHEN 1 THEN 'hybrid' ELSE 'remote' END AS location_policy,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS comp_min,
  CASE WHEN o_orderkey % 6 < 2 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) + 20000 END AS comp_max,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'EUR' ELSE 'USD' END AS comp_currency,
  CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE NULL END AS comp_equity,
  CASE o_orderkey % 5 WHEN 0 THEN '[]' WHEN 1 THEN '["pytorch","cuda"]' WHEN 2 THEN 'not json'
       WHEN 3 THEN '{"a":1}' ELSE '["rust","",1,null]' END AS ai_stack,
  CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'nlp' WHEN 2 THEN 'vision' WHEN 3 THEN 'robotics'
       WHEN 4 THEN 'infra' ELSE 'ops' END AS ai_specialty,
  CAST(NULL AS STRING) AS ai_compute_access,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '<p>Order ' || CAST(o_orderkey AS STRING)
       || ' builds serving systems with equity &amp; care, for teams that ship models to production every single week of the year.</p>'
       END AS description_html,
  'https://customer.example.com/jobs/' || CAST(o_orderkey AS STRING) AS apply_url,
  CAST({MS} AS BIGINT) AS posted_at,
  CASE WHEN o_orderkey % 101 = 0 THEN CAST(({MS} + 2592000000) / 1000 AS BIGINT)
       ELSE CAST({MS} + 2592000000 * (1 + o_orderkey % 24) AS BIGINT) END AS expires_at,
  CAST({MS} AS BIGINT) AS updated_at,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'filled' ELSE 'expired' END AS status
FROM orders""",
    "raw_jobs_v": r"""
SELECT o_orderkey AS seq, 'co-' || CAST(o_custkey AS STRING) AS company_id,
  CASE o_orderkey % 9 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby'
    WHEN 3 THEN 'smartrecruiters' WHEN 4 THEN 'workable' WHEN 5 THEN 'workday' WHEN 6 THEN 'notion'
    WHEN 7 THEN 'waas' ELSE 'custom' END AS provider,
  'customer' AS provider_slug, CAST(4253300000 + o_orderkey % 100 AS STRING) AS provider_job_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'Senior ML Engineer' WHEN 1 THEN 'Applied Scientist'
    WHEN 2 THEN 'Robotics Software Engineer' ELSE 'Site Reliability (SRE)' END AS title,
  CASE o_orderkey % 13
    WHEN 0 THEN NULL WHEN 1 THEN 'Remote, US' WHEN 2 THEN 'Hybrid - New York, US'
    WHEN 3 THEN 'San Francisco, United States' WHEN 4 THEN 'Remote (US)' WHEN 5 THEN 'London,'
    WHEN 6 THEN 'Remote' WHEN 7 THEN 'Remote – Hybrid: Berlin, Germany' WHEN 8 THEN 'Paris'
    WHEN 9 THEN 'On-site Austin, TX, USA' WHEN 10 THEN '' WHEN 11 THEN 'Zürich, Schweiz'
    ELSE 'remote — Canada' END AS location,
  CASE o_orderkey % 11
    WHEN 0 THEN ''
    WHEN 1 THEN '<p>Build PyTorch and CUDA systems with equity. Compensation: $180k - $250k.</p>'
    WHEN 2 THEN '<div onclick="alert(1)">Train transformers and RLHF systems for natural language tasks.</div>'
    WHEN 3 THEN '<p>Pay $180,000 - $250,000 for JAX and Triton work on robotics perception.</p>'
    WHEN 4 THEN '<script>var x = "<p>";</script><p>Rust&nbsp;and CUDA kernels &amp; MoE, $180-250k</p>'
    WHEN 5 THEN '<style>p{margin:0}</style><p>érust développeur, prompté, OCR</p>'
    WHEN 6 THEN 'On-call SRE, observability, $90 to 120k, no equities'
    WHEN 7 THEN '<ul><li>LoRA</li><li>DPO</li><li>flash attention</li></ul> mixture of experts, GPU serving'
    WHEN 8 THEN '&lt;p&gt;Hello &amp; &quot;friend&quot;&lt;/p&gt; &amp;lt;'
    WHEN 9 THEN '<p>Order ' || CAST(o_orderkey AS STRING) || ' needs someone to own distributed systems, inference and serving for a large fleet of accelerators across many regions.</p>'
    ELSE 'Motion planning for autonomous vehicle fleets; $200k–$300k plus Equity' END AS description,
  'https://customer.example.com/jobs/' || CAST(o_orderkey AS STRING) AS apply_url,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST({MS} / 1000 AS BIGINT)
       WHEN o_orderkey % 3 = 1 THEN CAST({MS} + 700000000000 AS BIGINT) ELSE NULL END AS posted_num,
  CASE WHEN o_orderkey % 3 = 2 THEN CASE o_orderkey % 7
    WHEN 0 THEN '2026-04-01T00:00:00.000Z' WHEN 1 THEN '2026-04-10' WHEN 2 THEN 'Posted Today'
    WHEN 3 THEN 'Posted Yesterday' WHEN 4 THEN 'Posted 2 Days Ago' WHEN 5 THEN 'Posted 30+ Days Ago'
    ELSE 'soon' END ELSE NULL END AS posted_str
FROM orders""",
    "paid_v": r"""
SELECT 'pay_' || CAST(o_orderkey AS STRING) AS id,
  CASE WHEN o_orderkey % 13 = 0 THEN 'lst_' || CAST(10000000 + o_orderkey AS STRING)
       ELSE 'greenhouse:customer:' || CAST(4253300000 + o_orderkey AS STRING) END AS listing_id,
  'cs_' || CAST(o_orderkey AS STRING) AS stripe_session_id, 'evt_' || CAST(o_orderkey AS STRING) AS stripe_event_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'founding' ELSE 'standard' END AS tier,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN 19900 ELSE 29900 END AS BIGINT) AS amount_cents, 'usd' AS currency,
  'buyer' || CAST(o_custkey AS STRING) || '@example.com' AS customer_email, CAST({MS} AS BIGINT) AS paid_at
FROM orders WHERE o_orderkey % 25 = 0""",
}
_TABLES = {"companies_v": ("customer", "nation"), "listings_v": ("orders",), "raw_jobs_v": ("orders",), "paid_v": ("orders",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by its name, over the Parquet tables in sf_dir."""
    prepare(spark)
    text = VIEWS[name].replace("{MS}", SPARK_MS)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]}
    # A backslash-free text: only the names of tables are filled in.
    text = text.replace("{", "{{").replace("}", "}}")
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    parts = [f"{v} AS ({VIEWS[v].replace('{MS}', DUCKDB_MS)})" for v in used]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*parts, body[5:]])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
