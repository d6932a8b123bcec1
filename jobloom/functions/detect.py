"""Which job board a URL or a page names: one column expression made from a table of ordered matchers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import DOT, WS, js_trim, let

# Words that mark a page as a careers page, and the patterns of the boards, in the order in which they are
# tried. {slug} groups are numbered; the slug joins them with colons. `\\s` inside a class of the first two patterns is
# the backslash and the letter s, as in the rules that they must agree with.
CAREERS_TOKEN = r"(?i)(?:^|[^a-z0-9])(careers?|jobs?|hiring|hire|roles?|positions?|openings?|we[-_]?are[-_]?hiring)(?:[^a-z0-9]|\z)"
EMBED_JOB_PATH = r"""(?i)/companies/([a-z0-9-]+)/jobs/[^"'\\s<]+"""
EMBED_JOB_URL = r"""(?i)https?://(?:www\.)?workatastartup\.com/companies/([a-z0-9-]+)/jobs/[^"'\\s<]+"""
EMBED_SLUG = rf"""(?i)(?:&quot;|")slug(?:&quot;|")[{WS}]*:[{WS}]*(?:&quot;|")([a-z0-9-]+)(?:&quot;|")"""
EMBED_SIGNALS = ("workatastartup.com", "bookface-images.s3.us-west-2.amazonaws.com", "bookface-images.s3.amazonaws.com")
PAGE_ID = "[a-f0-9]{32}|[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
URL_PATTERNS = (
    ("waas", r"(?:www\.)?workatastartup\.com/companies/([a-z0-9-]+)"),
    ("greenhouse", r"boards\.greenhouse\.io/([a-z0-9-]+)"),
    ("greenhouse", r"job-boards\.greenhouse\.io/([a-z0-9-]+)"),
    ("greenhouse", r"([a-z0-9-]+)\.greenhouse\.io"),
    ("lever", r"jobs\.lever\.co/([a-z0-9-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([^/?#]+)"),
    ("smartrecruiters", r"jobs\.smartrecruiters\.com/([a-z0-9-]+)"),
    ("smartrecruiters", r"careers\.smartrecruiters\.com/([a-z0-9-]+)"),
    ("workable", r"apply\.workable\.com/([a-z0-9-]+)"),
    ("workable", r"([a-z0-9-]+)\.workable\.com"),
    ("workday", r"([a-z0-9-]+)\.(wd[0-9]+)\.myworkdayjobs\.com/(?:[a-z]{2}-[A-Z]{2}/)?([^/?#]+)"),
    ("notion", r"([a-z0-9-]+)\.notion\.site/([^/?#]+)"),
    ("notion", rf"(?:www\.)?notion\.so/([^/?#]+)/(?:[^/?#]+-)?({PAGE_ID})"),
)
BODY_PATTERNS = (
    ("waas", EMBED_JOB_URL),
    ("greenhouse", r"(?i)boards\.greenhouse\.io/([a-z0-9-]+)"),
    ("greenhouse", r"(?i)job-boards\.greenhouse\.io/([a-z0-9-]+)"),
    ("greenhouse", r"(?i)https?://([a-z0-9-]+)\.greenhouse\.io(?![A-Za-z0-9_])"),
    ("lever", r"(?i)jobs\.lever\.co/([a-z0-9-]+)"),
    ("ashby", rf"""(?i)jobs\.ashbyhq\.com/([^"'{WS}<]+)"""),
    ("smartrecruiters", r"(?i)jobs\.smartrecruiters\.com/([a-z0-9-]+)"),
    ("smartrecruiters", r"(?i)careers\.smartrecruiters\.com/([a-z0-9-]+)"),
    ("workable", r"(?i)apply\.workable\.com/([a-z0-9-]+)"),
    ("workable", r"(?i)([a-z0-9-]+)\.workable\.com(?![A-Za-z0-9_])"),
    ("workday", rf"""(?i)([a-z0-9-]+)\.(wd[0-9]+)\.myworkdayjobs\.com/(?:[a-z]{{2}}-[A-Z]{{2}}/)?([^/?#"{WS}<]+)"""),
    ("notion", rf"""(?i)([a-z0-9-]+)\.notion\.site/([^/?#"'{WS}<]+)"""),
    ("notion", rf"""(?i)notion\.so/([^/?#"'{WS}<]+)/(?:[^/?#"'{WS}<]+-)?({PAGE_ID})"""),
    ("waas", EMBED_JOB_PATH),
)


# What a text holds that any matcher of a board can fit.
HOSTS = ("workatastartup.com", "greenhouse.io", "jobs.lever.co", "jobs.ashbyhq.com", "smartrecruiters.com", "workable.com", "myworkdayjobs.com", "notion.site", "notion.so", "/companies/")
ANY_HOST = "(?i)" + "|".join(h.replace(".", r"\.") for h in (*HOSTS, *EMBED_SIGNALS))


@dataclass(frozen=True)
class Matcher:
    provider: str
    pattern: str
    groups: int
    guarded: bool  # the slug or the text must hold a careers word
    plain_first: bool  # the first group is taken as it is, not percent-decoded


def _matchers() -> list[Matcher]:
    out = []
    for anchored, table in ((True, URL_PATTERNS), (False, BODY_PATTERNS)):
        for provider, pattern in table:
            own = rf"(?i)^(?:https?://)?{pattern}(?:[/?#]{DOT}*)?\z" if anchored else pattern
            groups = {"workday": 3, "notion": 2}.get(provider, 1)
            site = "notion\\.site" in pattern
            out.append(Matcher(provider, own, groups, site, site))
    return out


MATCHERS = _matchers()


def has_careers_token(value: Column) -> Column:
    return value.rlike(CAREERS_TOKEN)


def percent_decoded(value: Column) -> Column:
    """Percent escapes decoded; a malformed one leaves the text as it is. A plus stays a plus."""
    decoded = lambda v: F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v)
    return let(value, lambda v: F.when(F.instr(v, "%") == 0, v).otherwise(decoded(v)))


def _result(provider: Column, slug: Column) -> Column:
    return F.struct(provider.alias("provider"), slug.alias("slug"))


def _slug(text: Column, m: Matcher) -> Column:
    parts = [F.regexp_extract(text, m.pattern, i + 1) for i in range(m.groups)]
    decoded = [p if m.plain_first and i == 0 else percent_decoded(p) for i, p in enumerate(parts)]
    return decoded[0] if len(decoded) == 1 else F.concat_ws(":", *decoded)


def detect_embed(text: Column) -> Column:
    """struct<provider, slug> of an embedded board, or null."""
    board = lambda pattern: _result(F.lit("waas"), percent_decoded(F.regexp_extract(text, pattern, 1)))
    signal = F.lit(False)
    for s in EMBED_SIGNALS:
        signal = signal | text.contains(s)
    return (
        F.when(text.rlike(EMBED_JOB_PATH), board(EMBED_JOB_PATH))
        .when(text.rlike(EMBED_JOB_URL), board(EMBED_JOB_URL))
        .when(signal & text.rlike(EMBED_SLUG), board(EMBED_SLUG))
    )


def detect(value: Column) -> Column:
    """struct<provider, slug> of the first matcher that fits a URL or a page's text, or null."""

    def first(text: Column) -> Column:
        found = None
        for m in MATCHERS:
            fits = text.rlike(m.pattern)
            if m.guarded:
                fits = fits & (has_careers_token(_slug(text, m)) | has_careers_token(text))
            says = _result(F.lit(m.provider), _slug(text, m))
            found = F.when(fits, says) if found is None else found.when(fits, says)
        # Most URLs and pages name no board: one look for the boards' hosts spares them all patterns.
        return F.when(text.rlike(ANY_HOST), F.coalesce(detect_embed(text), found))

    return let(js_trim(value), first)


def detect_with_body(url: Column, body: Column) -> Column:
    """By the URL, else by its fetched body; a page that names no board, and is not blank, is a custom one."""
    blank = js_trim(F.coalesce(body, F.lit(""))) == ""
    return F.when(
        js_trim(F.coalesce(url, F.lit(""))) != "",
        F.coalesce(detect(url), F.when(~blank, F.coalesce(detect(body), _result(F.lit("custom"), url)))),
    )


def embed_company_url(slug: Column) -> Column:
    return F.concat(F.lit("https://www.workatastartup.com/companies/"), slug)
