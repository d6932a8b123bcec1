"""Native column expressions over text: slugs, HTML clean-up, and what a posting's text says.

Patterns follow ECMAScript: `\\s` and trim() mean its white space, `\\b` is ASCII, `$` is the end of the text alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ECMAScript white space, for the inside of a Java character class.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Any sign but the ends of lines.
DOT = r"[^\n\r\x{2028}\x{2029}]"
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Tokens of the stack, in the order in which they are listed.
STACK_TOKENS = (
    "pytorch", "tensorflow", "jax", "triton", "cuda", "vllm", "tgi", "tensorrt", "xla", "mojo", "rust", "cuda kernels",
    "rlhf", "dpo", "lora", "flash attention", "mixture of experts", "moe", "transformers",
)
# Specialties and their words; the first that matches wins.
SPECIALTY_WORDS = (
    ("robotics", "robotics|robot|autonomous vehicle|motion planning|manipulation"),
    ("vision", "computer vision|vision model|image segmentation|ocr"),
    ("nlp", "nlp|natural language|llm|language model|transformers|prompt"),
    ("infra", "inference|serving|distributed systems|gpu|compiler|cuda|training infrastructure"),
    ("ops", "mlops|platform reliability|sre|on-call|incident response|observability"),
)
# Titles that are never jobs.
TITLE_BLACKLIST = (
    "privacy policy", "terms", "contact", "about", "team", "blog", "pricing", "home", "login", "signin", "sign in",
    "signup", "sign up", "support", "help", "cookies", "careers", "apply", "apply now", "view details", "view all",
    "open roles", "open positions", "see all positions", "job description", "we re hiring", "folders and files",
    "footer", "learn more", "submit", "submit application",
)
# Tags that mark a company, compared without case, blanks and hyphens.
AI_TAGS = (
    "ai", "ml", "llm", "llms", "generative-ai", "ai-assistant", "ai-agents", "robotics", "computer-vision", "nlp",
    "mlops", "ai-infrastructure", "foundation-models", "ai-coding", "autonomous-vehicles", "voice-ai",
    "artificial intelligence", "machine learning", "generative ai",
)


def chain(value: Column, *steps: tuple[str, str]) -> Column:
    """Regular replacements one after the other."""
    return reduce(lambda c, s: F.regexp_replace(c, F.lit(s[0]), F.lit(s[1])), steps, value)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row: a lambda's variable stands for it, so Catalyst doesn't copy it into every use."""
    return F.element_at(F.transform(F.array(value), then), 1)


def literal(value: Column, *steps: tuple[str, str]) -> Column:
    """Literal replacements one after the other."""
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, value)


def where_it_holds(value: Column, sign: str, *steps: tuple[str, str]) -> Column:
    """Regular replacements that need a sign, tried only where the value holds it."""
    return let(value, lambda v: F.when(v.contains(sign), chain(v, *steps)).otherwise(v))


def has_word(value: Column, words: str) -> Column:
    return value.rlike(f"(?i){START}(?:{words}){END}")


def truthy(value: Column) -> Column:
    """The value, or null where ECMAScript takes it for false: null or empty."""
    return F.nullif(value, F.lit(""))


def js_trim(value: Column) -> Column:
    return F.regexp_replace(value, rf"^[{WS}]+|[{WS}]+\z", "")


def squeeze(value: Column) -> Column:
    """Runs of white space as one blank, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), rf"[{WS}]+", " "))


# --- slugs and paths


def slugify(value: Column) -> Column:
    return chain(F.lower(value), ("[^a-z0-9]+", "-"), (r"^-+|-+\z", ""))


def id_suffix(value: Column) -> Column:
    return F.substring(F.substring_index(value, ":", -1), 1, 8)


def role_slug(title: Column, listing_id: Column) -> Column:
    return F.concat(slugify(title), F.lit("-"), id_suffix(listing_id))


def job_path(company_slug: Column, title: Column, listing_id: Column) -> Column:
    return F.concat(F.lit("/jobs/"), company_slug, F.lit("/"), role_slug(title, listing_id))


def company_path(slug: Column) -> Column:
    return F.concat(F.lit("/companies/"), slug)


def normalized_batch(value: Column) -> Column:
    return F.regexp_replace(F.lower(js_trim(F.coalesce(value, F.lit("")))), "[^a-z0-9]+", "-")


# --- display


def format_comp(low: Column, high: Column, currency: Column) -> Column:
    prefix = F.when(currency.isNull() | (currency == "USD"), "$").otherwise(F.concat(currency, F.lit(" ")))
    amount = lambda x: F.concat(prefix, F.format_number(x, 0))
    return (
        F.when(low.isNull() & high.isNull(), "Comp undisclosed")
        .when(high.isNull(), F.concat(amount(low), F.lit("+")))
        .when(low.isNull(), F.concat(F.lit("Up to "), amount(high)))
        .otherwise(F.concat(amount(low), F.lit("-"), amount(high)))
    )


def format_location(city: Column, country: Column, is_remote: Column, policy: Column) -> Column:
    return (
        F.when(is_remote != 0, "Remote")
        .when(truthy(city).isNotNull(), F.concat(city, F.lit(", "), country))
        .otherwise(F.coalesce(truthy(country), policy))
    )


# --- HTML


def _without_blocks(html: Column, by: str) -> Column:
    return where_it_holds(html, "</", (r"(?i)<script\b[^>]*>[\s\S]*?</script>", by), (r"(?i)<style\b[^>]*>[\s\S]*?</style>", by))


HANDLERS = rf"""(?i)[{WS}]on[a-z]+[{WS}]*=[{WS}]*("{DOT}*?"|'{DOT}*?'|[^{WS}>]+)"""
ENTITIES = (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"))


def sanitize_html(html: Column) -> Column:
    """Without scripts, styles and inline handlers. No protection against hostile HTML."""
    return where_it_holds(_without_blocks(html, ""), "=", (HANDLERS, ""))


def strip_tags(html: Column) -> Column:
    bare = where_it_holds(_without_blocks(html, " "), "<", ("<[^>]+>", " "))
    return squeeze(where_it_holds(bare, "&", *ENTITIES))


def cleaned(rows: DataFrame, html: str, said: str) -> DataFrame:
    """rows with sanitize_html of the column html in its place, and strip_tags of that as the column `said`.

    Each step is a column of its own: Catalyst computes it once and compiles it, where `let` would interpret it.
    """
    held = lambda name, sign, *steps: F.when(F.col(name).contains(sign), chain(F.col(name), *steps)).otherwise(F.col(name))
    blocks = lambda by: ((r"(?i)<script\b[^>]*>[\s\S]*?</script>", by), (r"(?i)<style\b[^>]*>[\s\S]*?</style>", by))
    rows = rows.withColumn(html, held(html, "</", *blocks(""))).withColumn(html, held(html, "=", (HANDLERS, "")))
    rows = rows.withColumn(said, held(html, "</", *blocks(" "))).withColumn(said, held(said, "<", ("<[^>]+>", " ")))
    return rows.withColumn(said, held(said, "&", *ENTITIES)).withColumn(said, squeeze(F.col(said)))


def decode_entities(value: Column) -> Column:
    """Named entities; the ampersand last, so nothing is decoded twice."""
    return chain(
        value, ("(?i)&nbsp;", " "), ("(?i)&quot;", '"'), ("&#39;", "'"), ("(?i)&apos;", "'"), ("(?i)&lt;", "<"),
        ("(?i)&gt;", ">"), ("(?i)&amp;", "&"),
    )


def escape_html(value: Column) -> Column:
    return literal(value, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def decode_attribute(value: Column) -> Column:
    """Entities of an embedded JSON attribute; the ampersand before the brackets."""
    return literal(value, ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def description_to_html(plain: Column) -> Column:
    """Paragraphs at blank lines, escaped; line ends within them as breaks."""
    parts = F.transform(F.split(F.replace(plain, F.lit("\r\n"), F.lit("\n")), r"\n{2,}"), js_trim)
    parts = F.filter(parts, lambda p: p != "")
    shown = F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(escape_html(p), F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    return F.when(F.size(parts) == 0, "<p></p>").otherwise(F.array_join(shown, ""))


# --- forms


def optional_text(value: Column, most: int) -> Column:
    return truthy(F.substring(js_trim(value), 1, most))


def optional_amount(value: Column) -> Column:
    """The leading integer of a form field within 0 and 10,000,000, else null."""
    n = F.regexp_extract(value, rf"^[{WS}]*(\+?[0-9]+)", 1).try_cast("bigint")
    return F.when(n.between(0, 10_000_000), n)


def parse_stack(raw: Column) -> Column:
    parts = F.transform(F.split(raw, r"[,\n]"), lambda s: F.lower(js_trim(s)))
    return F.slice(F.filter(parts, lambda s: (F.length(s) > 0) & (F.length(s) <= 40)), 1, 24)


# --- what a posting says


def parse_location(value: Column) -> Column:
    """struct<city, country, is_remote, policy>."""
    trimmed = lambda v: let(v, lambda v: F.when(v.rlike(rf"^[{WS}:-]|[{WS}:-]\z"), js_trim(F.regexp_replace(v, rf"^[{WS}:-]+|[{WS}:-]+\z", ""))).otherwise(v))

    def placed(rest: Column, hybrid: Column, remote: Column) -> Column:
        def read(parts: Column) -> Column:
            away = hybrid | remote
            n, known = F.size(parts), truthy(value).isNotNull() & (rest != "")
            city = F.when(known, F.when(n >= 2, F.get(parts, F.lit(0))).when(away & (n == 1), F.lit(None)).otherwise(rest))
            country = F.when(known & (n >= 2), F.element_at(parts, -1)).when(known & away & (n == 1), F.get(parts, F.lit(0)))
            return F.struct(
                city.alias("city"), F.coalesce(country, F.lit("Unknown")).alias("country"), F.when(away, 1).otherwise(0).alias("is_remote"),
                F.when(hybrid, "hybrid").when(remote, "remote").otherwise("onsite").alias("policy"),
            )

        return let(F.filter(F.transform(F.split(rest, ","), js_trim), lambda p: p != ""), read)

    def flagged(text: Column) -> Column:
        modes = f"(?i){START}(?:remote|hybrid|on[- ]?site){END}"
        says = lambda low, word: low.contains(word) & has_word(low, word)
        flags = let(F.lower(text), lambda low: F.struct(says(low, "hybrid").alias("hybrid"), says(low, "remote").alias("remote"), (low.contains("remote") | low.contains("hybrid") | low.contains("site")).alias("any")))
        bare = lambda f: F.when(f["any"], F.regexp_replace(text, modes, "")).otherwise(text)
        return let(flags, lambda f: let(trimmed(bare(f)), lambda rest: placed(rest, f["hybrid"], f["remote"])))

    return let(js_trim(F.regexp_replace(value, "[–—]", "-")), flagged)


def parse_compensation(text: Column) -> Column:
    """struct<low, high, currency, equity> of the first pay range in a text."""
    pattern = rf"(?i)\$(\d+)(k)?[{WS}]?(?:-|to|–)[{WS}]?\$?(\d+)(k)?"

    def read(said: Column) -> Column:
        part = lambda i: F.regexp_extract(said, pattern, i)
        amount = lambda i: F.when(said != "", part(i).try_cast("bigint") * F.when(part(i + 1) != "", 1000).otherwise(1))
        return F.struct(amount(1).alias("low"), amount(3).alias("high"), F.when(said != "", "USD").alias("currency"), F.when(has_word(text, "equity"), 1).alias("equity"))

    return let(F.when(text.contains("$"), F.regexp_extract(text, pattern, 0)), read)


#: All words of the stack and of the specialties; where one starts with another the longer is tried first.
_WORDS = sorted({*STACK_TOKENS, *(w for _, words in SPECIALTY_WORDS for w in words.split("|"))}, key=lambda w: (-len(w), w))


def known_words(text: Column) -> Column:
    """The known words that a text says, in lower case, as an array: one pass over the text.

    A word inside a longer one is there, too. Of known words that overlap the first is found alone; such words belong to one
    specialty, and none of them is a token of the stack.
    """
    found = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){START}({'|'.join(_WORDS)}){END}")), lambda w: F.lower(w))
    inside = [(w, v) for w in _WORDS for v in _WORDS if v != w and f" {v} " in f" {w} "]
    return reduce(lambda words, p: let(words, _adding(*p)), inside, found)


def _adding(word: str, more: str) -> Callable[[Column], Column]:
    return lambda words: F.when(F.array_contains(words, word), F.concat(words, F.array(F.lit(more)))).otherwise(words)


def stack_of(words: Column) -> Column:
    """The stack's tokens among known_words, as a JSON array, in the table's order."""
    return F.to_json(F.filter(F.array(*[F.lit(t) for t in STACK_TOKENS]), lambda t: F.array_contains(words, t)))


def specialty_of(words: Column) -> Column:
    out = None
    for name, own in SPECIALTY_WORDS:
        fits = F.arrays_overlap(words, F.array(*[F.lit(w) for w in own.split("|")]))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def parse_ai_stack(text: Column) -> Column:
    """The stack's tokens in a text, as a JSON array, in the table's order."""
    return let(known_words(text), stack_of)


def parse_specialty(text: Column) -> Column:
    return let(known_words(text), specialty_of)


def has_ai_tag(tags: Column) -> Column:
    wanted = sorted({t.replace(" ", "").replace("-", "") for t in AI_TAGS})
    return F.exists(tags, lambda t: F.regexp_replace(F.lower(t), rf"[{WS}-]", "").isin(*wanted))


def strip_generic_trail(value: Column) -> Column:
    """A heading without a trailing call to action, work place, or `City, ST`."""
    # What is cut from a heading's end, in this order.
    steps = (
        (rf"(?i)(view[{WS}]*details|read[{WS}]*more|learn[{WS}]*more){DOT}*\z", ""),
        (rf"(?i)[{WS}]*(remote|anywhere|hybrid|on[- ]?site)[{WS}]*\z", ""),
        (rf"(?i)[{WS}]*([A-Z][a-z]+(?:[{WS}]+[A-Z][a-z]+)*,[{WS}]*[A-Z]{{2,}})[{WS}]*\z", ""),
    )
    return squeeze(chain(value, *steps))


def is_blacklisted_title(title: Column) -> Column:
    words = js_trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))
    bare = squeeze(F.regexp_replace(words, rf"{START}[0-9]+{END}", ""))
    return words.isin(*TITLE_BLACKLIST) | bare.isin(*TITLE_BLACKLIST)


def job_id_of_url(url: Column) -> Column:
    return F.substring(F.sha1(F.encode(url, "utf-8")), 1, 8)


# --- identifiers of page blocks


def normalize_page_id(raw: Column) -> Column:
    """A 32-digit hexadecimal id in its dashed form, in lower case; null otherwise."""
    text = F.lower(js_trim(raw))
    dashed = F.regexp_replace(text, r"^([a-f0-9]{8})([a-f0-9]{4})([a-f0-9]{4})([a-f0-9]{4})([a-f0-9]{12})\z", "$1-$2-$3-$4-$5")
    return F.when(dashed.rlike(r"^[a-f0-9]{8}(-[a-f0-9]{4}){3}-[a-f0-9]{12}\z"), dashed)


def page_id_of_slug(slug: Column) -> Column:
    tail = F.when(F.instr(slug, ":") > 0, normalize_page_id(F.substring(slug, F.instr(slug, ":") + 1, F.length(slug))))
    inner = truthy(F.regexp_extract(slug, r"(?i)([a-f0-9]{32})(?:[/?#-]|\z)", 1))
    return F.coalesce(tail, normalize_page_id(inner), normalize_page_id(slug))


def page_id_of_html(html: Column) -> Column:
    return normalize_page_id(truthy(F.regexp_extract(html, rf'(?i)"pageId"[{WS}]*:[{WS}]*"([a-f0-9-]{{32,36}})"', 1)))


def page_url(slug: Column) -> Column:
    space = F.substring_index(slug, ":", 1)
    path = F.substring(slug, F.instr(slug, ":") + 1, F.length(slug))
    return (
        F.when(F.instr(slug, ":") == 0, F.concat(F.lit("https://www.notion.so/"), slug))
        .when(page_id_of_slug(path).isNotNull(), F.concat(F.lit("https://www.notion.so/"), space, F.lit("/"), path))
        .otherwise(F.concat(F.lit("https://"), space, F.lit(".notion.site/"), path))
    )


def short_id(block_id: Column) -> Column:
    return F.substring(F.replace(block_id, F.lit("-"), F.lit("")), 1, 8)
