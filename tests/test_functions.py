"""Column functions against golden rows."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobloom.functions import detect, docs, html, text, times
from jobloom.sources.views import NOW_MS


def run(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


LOCATIONS = {
    None: (None, "Unknown", 0, "onsite"),
    "Remote, US": (None, "US", 1, "remote"),
    "Hybrid - New York, US": ("New York", "US", 1, "hybrid"),
    "San Francisco, United States": ("San Francisco", "United States", 0, "onsite"),
    "Remote (US)": (None, "(US)", 1, "remote"),
    "London,": ("London,", "Unknown", 0, "onsite"),
    "Remote": (None, "Unknown", 1, "remote"),
    "Remote – Hybrid: Berlin, Germany": ("Berlin", "Germany", 1, "hybrid"),
    "Paris": ("Paris", "Unknown", 0, "onsite"),
    "On-site Austin, TX, USA": ("Austin", "USA", 0, "onsite"),
    "": (None, "Unknown", 0, "onsite"),
    "Zürich, Schweiz": ("Zürich", "Schweiz", 0, "onsite"),
    "remote — Canada": (None, "Canada", 1, "remote"),
    "remotely, EU": ("remotely", "EU", 0, "onsite"),
}


def test_locations(spark):
    assert [tuple(r) for r in run(spark, LOCATIONS, text.parse_location)] == list(LOCATIONS.values())


def test_compensation(spark):
    said = {
        "Compensation: $180k - $250k. equity": (180000, 250000, "USD", 1), "$180,000 - $250,000": (None, None, None, None),
        "$180-250k": (180, 250000, "USD", None), "$90 to 120k, no equities": (90, 120000, "USD", None), "$200k–$300k plus Equity": (200000, 300000, "USD", 1),
    }
    assert [tuple(r) for r in run(spark, said, text.parse_compensation)] == list(said.values())


def test_stack_and_specialty(spark):
    said = ["Rust and CUDA kernels & MoE", "érust développeur, prompté, OCR", "rusty torch", "On-call SRE, observability", "x transformers robot"]
    assert run(spark, said, text.parse_ai_stack) == ['["cuda","rust","cuda kernels","moe"]', '["rust"]', "[]", "[]", '["transformers"]']
    assert run(spark, said, text.parse_specialty) == ["infra", "vision", None, "ops", "robotics"]


def test_slugs(spark):
    assert run(spark, ["  Robotics -- Lead  ", "C++ & CUDA", "Ingénieur", "", "\n-a-\n"], text.slugify) == ["robotics-lead", "c-cuda", "ing-nieur", "", "a"]
    assert run(spark, ["a:b:123456789", "lst_123456", ""], text.id_suffix) == ["12345678", "lst_1234", ""]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x3010, exclude_categories=["Cs"], exclude_characters="\x00"), max_size=12), min_size=1, max_size=20))
def test_trim_is_that_of_ecmascript(spark, values):
    space = "\t\n\x0b\x0c\r " + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
    assert run(spark, values, text.js_trim) == [v.strip(space) for v in values]


def test_html_text(spark):
    pages = ['<p onclick="x()">a&nbsp;&amp;<b>b</b></p><script>1 < 2</script>', "<STYLE>p{}</style>x  \n y", None]
    assert run(spark, pages, text.strip_tags) == ["a & b", "x y", ""]
    assert run(spark, pages, text.sanitize_html) == ["<p>a&nbsp;&amp;<b>b</b></p>", "x  \n y", None]
    assert run(spark, ["&amp;lt; &quot;&APOS;"], text.decode_entities) == ["&lt; \"'"]
    assert run(spark, ["&#x41;&lt;", "none"], html.html_decode_col) == ["A<", "none"]
    assert run(spark, ["a\r\nb\n\n\n <c> \n\n"], text.description_to_html) == ["<p>a<br>b</p><p>&lt;c&gt;</p>"]
    assert run(spark, ["", "\n \n"], text.description_to_html) == ["<p></p>", "<p></p>"]


def test_numeric_entities_decode_first(spark):
    assert run(spark, ["&#38;lt;", "&#x1F600;"], html.html_decode_col)[0] == "<"


def test_titles(spark):
    assert run(spark, ["Apply Now", "See all 12 positions", "ML Engineer", "We're hiring!"], text.is_blacklisted_title) == [True, True, False, True]
    assert run(spark, ["Data Engineer Remote", "ML Lead  view details here", "Chef Paris, FR"], text.strip_generic_trail)[:2] == ["Data Engineer", "ML Lead"]


def test_dates(spark):
    assert run(spark, ["2026-04-10", "2026-04-01T00:00:00.000Z", "2026-04-01T02:00:00+02:00", "Posted Today", "soon", None, "12:30"], times.parse_iso) == [
        1775779200000, 1775001600000, 1775001600000, None, None, None, None,
    ]
    said = {"Posted Today": 0, "posted yesterday": 1, "Posted 30+ Days Ago": 30, "2 days ago": 2, "1 day ago": 1, "ago": None, "": None}
    want = [None if d is None else NOW_MS - d * 86_400_000 for d in said.values()]
    assert run(spark, said, lambda c: times.parse_iso(times.parse_posted_on(c, NOW_MS))) == want


DETECTED = {
    "https://boards.greenhouse.io/bravo/jobs/1": ("greenhouse", "bravo"), "https://boards.greenhouse.io": ("greenhouse", "boards"),
    "bravo.greenhouse.io": ("greenhouse", "bravo"), "https://jobs.lever.co/bravo/123?x=1": ("lever", "bravo"),
    "https://jobs.ashbyhq.com/Acme%20Inc": ("ashby", "Acme Inc"), "https://jobs.ashbyhq.com/a+b": ("ashby", "a+b"),
    "https://careers.smartrecruiters.com/Acme": ("smartrecruiters", "Acme"), "https://apply.workable.com/bravo/": ("workable", "bravo"),
    "text www.workable.com": ("workable", "www"), "https://bravo.wd5.myworkdayjobs.com/en-US/Site/job/1": ("workday", "bravo:wd5:Site"),
    "https://delta-labs.notion.site/delta-jobs-1": ("notion", "delta-labs:delta-jobs-1"), "https://delta-labs.notion.site/winter-guide": None,
    "https://www.notion.so/bravo/Careers-51f0d2ab7c3e4f88a6b9043d2c1e7f60": ("notion", "bravo:51f0d2ab7c3e4f88a6b9043d2c1e7f60"),
    "https://www.workatastartup.com/companies/bravo": ("waas", "bravo"), "https://x.com/companies/bravo/jobs/founder": ("waas", "bravo"),
    "https://x.com/companies/bravo/jobs/senior": None, "https://example.com/careers": None, "": None, None: None,
    '<a href="https://jobs.lever.co/bravo">': ("lever", "bravo"), 'workatastartup.com "slug": "bravo-2"': ("waas", "bravo-2"), '"slug": "bravo-2"': None,
}


def test_detection(spark):
    assert [r and tuple(r) for r in run(spark, DETECTED, detect.detect)] == list(DETECTED.values())


def test_detection_with_body(spark):
    rows = spark.createDataFrame([(1, "https://a.com", "see jobs.lever.co/bravo"), (2, "https://a.com", " "), (3, "https://a.com", "hello"), (4, "", "hello"), (5, "https://a.com", None)], "i int, u string, b string")
    got = {r.i: r.d and tuple(r.d) for r in rows.select("i", detect.detect_with_body(F.col("u"), F.col("b")).alias("d")).collect()}
    assert got == {1: ("lever", "bravo"), 2: None, 3: ("custom", "https://a.com"), 4: None, 5: None}


def test_page_ids(spark):
    bare, dashed = "2176507c0b0a4d5ca58d2e8e1c0a82c0", "2176507c-0b0a-4d5c-a58d-2e8e1c0a82c0"
    assert run(spark, [f"Careers-{bare}", f"bravo:{dashed}", bare.upper(), "none", f"bravo:Jobs-{bare}"], text.page_id_of_slug) == [dashed, dashed, dashed, None, dashed]
    assert run(spark, [f"bravo:{bare}", "bravo:jobs", "Jobs"], text.page_url) == [f"https://www.notion.so/bravo/{bare}", "https://bravo.notion.site/jobs", "https://www.notion.so/Jobs"]


def test_stack_lists(spark):
    assert run(spark, ['["a", 1, "", null, "b"]', "not json", '{"a": 1}', None, "[]"], docs.parse_ai_stack) == [["a", "b"], [], [], [], []]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n", min_size=1, max_size=30), min_size=1, max_size=8))
def test_chunks_round_trip(spark, values):
    assert run(spark, values, lambda c: docs.decode_chunks(docs.encode_chunks(c, 7))) == values


def test_chunks_with_a_gap(spark):
    rows = spark.createDataFrame([({"d0": "a", "draft_chunks": "2"},), ({"d0": "a"},), ({"d0": "a", "draft_chunks": "1"},), (None,)], "m map<string,string>")
    assert [r.t for r in rows.select(docs.decode_chunks(F.col("m")).alias("t")).collect()] == [None, None, "a", None]


def test_draft_errors(spark):
    good = ('{"company_name":"A","company_website":"https://a.com","title":"T","apply_url":"https://a.com/x","description_html":"<p>","location_city":"",'
            '"location_country":"US","location_is_remote":1,"location_policy":"remote","comp_min":1,"comp_max":null,"ai_specialty":null,"ai_stack":["x"],"customer_email":"a@b.c"}')  # fmt: skip
    cases = {good: None, "[]": "decoded draft is not an object", "x": "decoded draft is not an object", good.replace('"remote",', '"moon",'): "draft.location_policy invalid",
             good.replace('"location_is_remote":1', '"location_is_remote":true'): "draft.location_is_remote must be 0 or 1",
             good.replace('["x"]', '["x",1]'): "draft.ai_stack must be a string[]", good.replace('"title":"T"', '"title":""'): "draft.title must be a non-empty string",
             good.replace('"comp_min":1', '"comp_min":"1"'): "draft.comp_min must be a finite number or null",
             good.replace('"ai_specialty":null', '"ai_specialty":"x"'): "draft.ai_specialty invalid"}
    assert run(spark, cases, docs.draft_error) == list(cases.values())
    assert run(spark, [good], docs.parse_draft)[0].location_city is None


def test_forms(spark):
    assert run(spark, [" 12k", "-5", "10000001", "", None, "007"], text.optional_amount) == [12, None, None, None, None, 7]
    assert run(spark, ["a, B\nc,," + "x" * 41, ",".join("k" * i for i in range(1, 40))], text.parse_stack)[0] == ["a", "b", "c"]
    assert len(run(spark, [",".join(f"k{i}" for i in range(40))], text.parse_stack)[0]) == 24
    assert run(spark, ["https://a.com", "http://a", "ftp://a.com", "a.com", "https://"], docs.is_web_url) == [True, True, False, False, False]
    assert run(spark, ["HTTPS://A.com:80/x", "Not a URL"], docs.website_of_draft) == ["https://a.com", "not a url"]


def test_no_pattern_of_a_board_fits_without_its_host():
    import re

    for pattern in (m.pattern for m in detect.MATCHERS):
        plain = re.sub(r"\\(?=[./-])", "", pattern)
        assert any(h in plain for h in detect.HOSTS), pattern
    for embedded in (detect.EMBED_JOB_PATH, detect.EMBED_JOB_URL):
        assert "/companies/" in embedded
