"""URL filter: rules for hosts and paths, and a character language-model ratio for all other URLs. Native operations only.

A URL that a rule judges is an example for one of two language models, of accepted and of rejected URLs: character models
of variable order (3 characters of context, backing off down to none) with Witten-Bell smoothing. The score of a URL is
its log-likelihood difference, accepted less rejected, per character. The threshold lies where the scores of the
examples of either class, taken as normal, are equally far off in standard deviations. Other URLs are allowed at the
threshold or above.

Counts are made over all URLs and reduced before they are shuffled. The model is a table of every group of four
characters and its own difference; it grows with the input and stays distributed. URLs are scored by an equi-join of
their groups with it. Groups that make up over 1 / HOT of all occurrences, fewer than HOT, are joined by broadcast where
the URLs are read, so no key of the shuffled join has more rows than that.

Defined cases: a null url, or one without "://", has empty host and path, fits no rule and is scored as it is; an empty
one scores 0; without examples of both classes the threshold is 0; of fitting rules the longest wins, then the one first
in order of its text; repeated rows are judged one by one and counted each.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import discard, materialize, pick, table

NAME = "op4_url_filter"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
HOT = 4096
SYMBOLS = 256.0  # of the model without context
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path of a url; both empty where it is null or has no '://'."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = None
    for rule, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, slash, below = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + below)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: a lambda's variable stands for it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def grams(url: Column) -> Column:
    """For each character of a url the group of four that it ends, blanks before the start."""
    chars = F.filter(F.split(F.concat(F.lit("   "), F.coalesce(url, F.lit(""))), ""), lambda c: c != "")

    def groups(chars: Column) -> Column:
        at = F.when(F.size(chars) > 3, F.sequence(F.lit(1), F.size(chars) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(*[F.element_at(chars, i + k) for k in range(4)]))

    return let(chars, groups)


def _levels(counted: DataFrame) -> DataFrame:
    """gram, n and the log-likelihood difference of every counted group of four (gram, n, allow, block)."""
    total = counted.agg(*[F.sum(c).alias(c) for c in ("allow", "block")]).first()
    lower = None
    for size in range(1, 5):
        own = counted.groupBy(F.substring("gram", 5 - size, size).alias("gram")).agg(*[F.sum(c).alias(c) for c in ("n", "allow", "block")])
        context = F.substring("gram", 1, size - 1)
        kinds = [F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("allow", "block")]
        if size == 1:
            seen = own.agg(*kinds).first()
            p = {c: _smoothed(F.col(c), F.lit(total[c] or 0), F.lit(seen[f"{c}_kinds"]), F.lit(1 / SYMBOLS)) for c in ("allow", "block")}
        else:
            before = own.groupBy(context.alias("context")).agg(*kinds, *[F.sum(c).alias(f"{c}_all") for c in ("allow", "block")])
            own = own.withColumn("context", context).join(before, "context").withColumn("less", F.substring("gram", 2, size - 1))
            own = own.join(lower.select(F.col("gram").alias("less"), "p_allow", "p_block"), "less")
            p = {c: _smoothed(F.col(c), F.col(f"{c}_all"), F.col(f"{c}_kinds"), F.col(f"p_{c}")) for c in ("allow", "block")}
        lower = own.select("gram", "n", p["allow"].alias("p_allow"), p["block"].alias("p_block"))
    return lower.select("gram", "n", (F.log("p_allow") - F.log("p_block")).alias("llr"))


def _smoothed(n: Column, of: Column, kinds: Column, less: Column) -> Column:
    """Witten-Bell: the count, and as much weight as there are kinds of followers for the shorter context."""
    return F.when(of + kinds > 0, (n + kinds * less) / (of + kinds)).otherwise(less)


def train(judged: DataFrame) -> DataFrame:
    """The model (gram, n, llr) from rows (url, says): says is allow, block, or null for URLs without a rule, which train neither."""
    spark = judged.sparkSession
    each = judged.select("says", F.explode(grams(F.col("url"))).alias("gram"))
    counted = each.groupBy("gram").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("says").eqNullSafe(c)).alias(c) for c in ("allow", "block")]
    )
    counted = materialize(counted, "url-grams")
    model = materialize(_levels(counted), "url-model")
    discard(counted)
    return model


def score(rows: DataFrame, model: DataFrame, hot: int = HOT) -> DataFrame:
    """row and score, the mean of the model over the characters, of each of rows (row, url) whose url isn't empty."""
    total = model.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * hot > total
    few = F.broadcast(model.filter(often).select("gram", "llr"))
    each = rows.select("row", F.explode(grams(F.col("url"))).alias("gram"))
    rare = each.join(few, "gram", "left_anti").join(model.filter(~often).select("gram", "llr"), "gram")
    # Decimals add up to the same in any order, so equal URLs have equal scores.
    parts = [
        df.groupBy("row").agg(F.sum(F.col("llr").cast("decimal(28,18)")).alias("llr"), F.count("*").alias("n"))
        for df in (each.join(few, "gram"), rare.select("row", "llr"))
    ]
    summed = parts[0].unionByName(parts[1]).groupBy("row").agg(F.sum("llr").alias("llr"), F.sum("n").alias("n"))
    return summed.select("row", (F.col("llr").cast("double") / F.col("n")).alias("score"))


def _mean_and_spread(n: int, total: Decimal, squares: Decimal) -> tuple[float, float]:
    """Mean and standard deviation from a count, the sum and the sum of squares."""
    with localcontext() as c:
        c.prec = 60
        mean = total / n
        return float(mean), float(max(squares / n - mean * mean, Decimal(0)).sqrt())


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of each row of pages (page_id, url)."""
    spark = pages.sparkSession
    rows = pick(pages, ["page_id", "url"])
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says, "row": F.monotonically_increasing_id()})
    rows = materialize(rows, "urls")  # the row numbers are fixed from here on
    model = train(rows)
    scored = rows.drop("url").join(score(rows, model), "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    scored = materialize(scored.drop("row"), "url-scores")
    discard(rows, model)
    # Decimals again: sums of doubles would depend on the order of tasks, and the threshold with them.
    exact = F.col("score").cast("decimal(20,18)")
    sums = scored.filter("says IS NOT NULL").groupBy("says").agg(F.count("*").alias("n"), F.sum(exact).alias("s"), F.sum((exact * exact).cast("decimal(26,24)")).alias("q"))
    stats = {r.says: _mean_and_spread(r.n, r.s, r.q) for r in sums.collect()}
    threshold = 0.0
    if len(stats) == 2:
        (mean, sd), (other, other_sd) = stats["allow"], stats["block"]
        spread = sd + other_sd
        threshold = (mean * other_sd + other * sd) / spread if spread > 0 else (mean + other) / 2
    verdict = F.coalesce("says", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("score")


SQL = r"""
WITH a AS (
  SELECT page_id, coalesce(url, '') AS url,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT row_number() OVER () AS r, page_id, url,
             translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (
  SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c),
e AS (SELECT *, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS says FROM d),
g AS (SELECT r, says, substr('   ' || url, i, 4) AS gram FROM (SELECT *, unnest(generate_series(1, length(url))) AS i FROM e)),
k4 AS (SELECT gram, count(*) AS n, count(*) FILTER (says = 'allow') AS ca, count(*) FILTER (says = 'block') AS cb FROM g GROUP BY gram),
k3 AS (SELECT substr(gram, 2, 3) AS gram, sum(ca) AS ca, sum(cb) AS cb FROM k4 GROUP BY 1),
k2 AS (SELECT substr(gram, 3, 2) AS gram, sum(ca) AS ca, sum(cb) AS cb FROM k4 GROUP BY 1),
k1 AS (SELECT substr(gram, 4, 1) AS gram, sum(ca) AS ca, sum(cb) AS cb FROM k4 GROUP BY 1),
x0 AS (SELECT sum(ca) AS na, sum(cb) AS nb, count(*) FILTER (ca > 0) AS ta, count(*) FILTER (cb > 0) AS tb FROM k1),
x1 AS (SELECT substr(gram, 1, 1) AS x, sum(ca) AS na, sum(cb) AS nb, count(*) FILTER (ca > 0) AS ta, count(*) FILTER (cb > 0) AS tb FROM k2 GROUP BY 1),
x2 AS (SELECT substr(gram, 1, 2) AS x, sum(ca) AS na, sum(cb) AS nb, count(*) FILTER (ca > 0) AS ta, count(*) FILTER (cb > 0) AS tb FROM k3 GROUP BY 1),
x3 AS (SELECT substr(gram, 1, 3) AS x, sum(ca) AS na, sum(cb) AS nb, count(*) FILTER (ca > 0) AS ta, count(*) FILTER (cb > 0) AS tb FROM k4 GROUP BY 1),
p1 AS (SELECT gram, CASE WHEN na + ta > 0 THEN CAST(ca + ta / 256.0 AS DOUBLE) / (na + ta) ELSE 1 / 256.0 END AS pa,
              CASE WHEN nb + tb > 0 THEN CAST(cb + tb / 256.0 AS DOUBLE) / (nb + tb) ELSE 1 / 256.0 END AS pb FROM k1, x0),
p2 AS (SELECT k.gram, CASE WHEN na + ta > 0 THEN (ca + ta * pa) / (na + ta) ELSE pa END AS pa,
              CASE WHEN nb + tb > 0 THEN (cb + tb * pb) / (nb + tb) ELSE pb END AS pb
       FROM k2 k JOIN x1 ON x = substr(k.gram, 1, 1) JOIN p1 p ON p.gram = substr(k.gram, 2, 1)),
p3 AS (SELECT k.gram, CASE WHEN na + ta > 0 THEN (ca + ta * pa) / (na + ta) ELSE pa END AS pa,
              CASE WHEN nb + tb > 0 THEN (cb + tb * pb) / (nb + tb) ELSE pb END AS pb
       FROM k3 k JOIN x2 ON x = substr(k.gram, 1, 2) JOIN p2 p ON p.gram = substr(k.gram, 2, 2)),
p4 AS (SELECT k.gram, k.n, CASE WHEN na + ta > 0 THEN (ca + ta * pa) / (na + ta) ELSE pa END AS pa,
              CASE WHEN nb + tb > 0 THEN (cb + tb * pb) / (nb + tb) ELSE pb END AS pb
       FROM k4 k JOIN x3 ON x = substr(k.gram, 1, 3) JOIN p3 p ON p.gram = substr(k.gram, 2, 3)),
sc AS (SELECT r, CAST(sum(CAST(ln(pa) - ln(pb) AS DECIMAL(28, 18))) AS DOUBLE) / count(*) AS score FROM g JOIN p4 USING (gram) GROUP BY r),
s AS (SELECT e.*, coalesce(score, 0.0) AS score FROM e LEFT JOIN sc ON e.r = sc.r),
t AS (SELECT avg(score) FILTER (says = 'allow') AS ma, stddev_pop(score) FILTER (says = 'allow') AS sa,
             avg(score) FILTER (says = 'block') AS mb, stddev_pop(score) FILTER (says = 'block') AS sb FROM s),
th AS (SELECT CASE WHEN ma IS NULL OR mb IS NULL THEN 0.0 WHEN sa + sb > 0 THEN (ma * sb + mb * sa) / (sa + sb) ELSE (ma + mb) / 2 END AS t FROM t)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict FROM s, th
"""
