"""Mixing of sources to target weights, native: blocks of fixed length, drawn by shard, joined by index.

The words of each source, its documents one after the other, are packed into blocks of `LENGTH` words; only a source's last
block may be shorter. Sources have weights and share as many words as all have together; a target stops at `PASSES` times
its source, and what is left over goes to the others by weight, again until none is above. A target is a number of blocks,
and all of these are slots of output shards of `SHARD` slots.

For each shard the source counts are drawn: the whole part of each expected count as it is, and the remaining slots, fewer
than there are sources, by a multinomial draw with the fractions as weights. So a source's total differs from its target by
a few blocks whatever the number of shards. Counts of earlier shards give each slot its number k in its source. Pass
k div n over a source's n blocks takes them in a pseudorandom order of its own (swap-or-not rounds, a permutation of any n that
needs no table), and block index and slot meet in an equi-join whose keys are all different, so a hot source is spread like
any other. No pass takes a block twice and no slot beyond the last pass is filled, so no document exceeds `PASSES` times
its size.

Draws and orders come from hashes and whole-number arithmetic of ranks alone: reruns agree, on any cluster. Each source needs one row for each
shard, a draw one row; documents, blocks and slots are spread evenly, ranks and sums across them come from ranges.

Defined cases: a null text, and one of white space, has size 0 and is in no block; sources are ordered by code point, a null
source is one, the last; a source without words has target 0; a source of less than a block takes all of it or nothing;
repeated rows, and null ids, are documents each, and of rows equal in id, size and text it makes no difference which comes
first; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobloom.llm.common import discard, materialize, pick, table
from jobloom.operators.ranks import ranked, running

NAME = "op12_mixing"
LENGTH, SHARD, PASSES = 64, 65536, 3
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 12
_PRIME = 2147483647
#: Blocks that one array lists: a document of any length is unfolded in such steps.
_STEP = 4096


def _mixed(x: Column, salt: int) -> Column:
    """A number below _PRIME from x >= 0: two linear steps, the low bits folded in between."""
    y = (x % _PRIME * 1103515245 + 12345 + salt * 7919) % _PRIME
    return (y * 48271 + F.shiftright(y, 13)) % _PRIME


def round_keys(n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """What the rounds of a pseudorandom order of 0 to n - 1 need: computed once an order, not once a place."""

    def of(r: Column) -> Column:
        key = seed % _PRIME * 64 + r
        pair = (_mixed(key, 1) * _PRIME + _mixed(key, 2)) % F.greatest(n, F.lit(1).cast("bigint"))
        return F.struct(pair.alias("pair"), (_mixed(key, 3) + 1).alias("by"), _mixed(key, 4).alias("plus"))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(rounds - 1).cast("bigint")), of)


def shuffled(x: Column, n: Column, keys: Column) -> Column:
    """The place of x in a pseudorandom order of 0 to n - 1 (swap-or-not: each round pairs places and swaps some pairs)."""

    def turn(x: Column, key: Column) -> Column:
        other = F.pmod(key["pair"] - x, n)
        swapped = (F.greatest(x, other) % _PRIME * key["by"] + key["plus"]) % _PRIME
        return F.when(swapped.bitwiseAND(512) != 0, other).otherwise(x)

    return F.aggregate(keys, x, turn)


def _drawn(*of: Column) -> Column:
    """A number of 60 bits from whole numbers."""
    return F.conv(F.substring(F.md5(F.concat_ws(",", *[c.cast("string") for c in of]).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _steps(first: Column, last: Column, name: str, rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """rows once for each whole number from first to last (none if last is less), in arrays of _STEP at most, dealt to so many tasks."""
    outer = F.when(first <= last, F.sequence(F.floor(first / _STEP), F.floor(last / _STEP)))
    rows = rows.withColumns({"_first": first, "_last": last}).withColumn("_step", F.explode(outer))
    rows = rows.repartition(tasks) if tasks else rows
    inner = F.sequence(F.greatest("_first", F.col("_step") * _STEP), F.least("_last", F.col("_step") * _STEP + _STEP - 1))
    return rows.withColumn(name, F.explode(inner)).drop("_first", "_last", "_step")


def _tasks(spark: SparkSession, rows: int) -> int:
    """Tasks to deal unfolded rows to: a million rows each at most, fewer while the cluster has idle cores."""
    return max(1, -(-rows // 1_000_000), min(2 * spark.sparkContext.defaultParallelism, rows // _STEP))


def targets(sources: DataFrame, passes: int = PASSES) -> DataFrame:
    """sources (size, weight) with target: shares of the sum of sizes by weight, none above `passes` times its size."""
    of = sources.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    share, before = of["size"] / of["weight"] if of["weight"] else 0.0, None
    full = lambda share: F.col("size") * passes <= F.lit(share) * F.col("weight")
    while share != before:
        left = sources.agg(F.sum(F.when(full(share), F.col("size") * passes)).alias("size"), F.sum(F.when(~full(share), F.col("weight"))).alias("weight")).first()
        before, share = share, (of["size"] - (left["size"] or 0)) / left["weight"] if left["weight"] else share
    return sources.withColumn("target", F.when(full(share), (F.col("size") * passes).cast("double")).otherwise(F.lit(share) * F.col("weight")))


def _quotas(sources: DataFrame, length: int) -> DataFrame:
    """sources (size, target) with their number of blocks and quota, the blocks that come nearest to the target."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    rest = F.least(F.floor((F.col("target") - whole * F.col("size")) / length + 0.5), F.col("blocks"))
    return sources.withColumn("blocks", F.ceil(F.col("size") / length)).withColumn("quota", (whole * F.col("blocks") + rest).cast("bigint"))


def _counts(sources: DataFrame, slots: int, shard: int, seed: int) -> DataFrame:
    """(tree, shard, n): how many slots of each shard each source (tree, quota) gets."""
    spark = sources.sparkSession
    whole, last = slots // shard, slots % shard
    kinds = [(0, shard, 0, whole)] * bool(whole) + [(1, last, whole, whole + 1)] * bool(last)  # kind, its slots, from and to which shard
    each = F.inline(F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(("kind", "wide", "lo", "hi"), k)]) for k in kinds]))
    expected = sources.select("tree", "quota", each)
    # Whole-number division: doubles would round products above 2 ** 53.
    expected = expected.select("tree", "kind", "lo", "hi", F.expr(f"wide * quota div {slots} AS n"), F.expr(f"wide * quota % {slots} AS part"))
    expected = running(expected, "part", [F.col("tree")], ["kind"])
    expected = materialize(expected, "mix-expected")
    rest = {r.kind: r for r in expected.groupBy("kind").agg(F.sum("part").alias("part"), F.count("*").alias("n")).collect()}
    fixed = _steps(F.col("lo"), F.col("hi") - 1, "shard", expected, _tasks(spark, (whole + 1) * sum(r.n for r in rest.values()))).select("tree", "shard", "n")
    found = [fixed]
    for kind, _, lo, hi in kinds:
        total = rest[kind].part
        if not total:
            continue
        # A draw finds the source whose share of the fractions it hits by the cell of their range that both lie in.
        cell = -(-total // (2 * rest[kind].n))
        draws = _steps(F.lit(0).cast("bigint"), F.lit(total // slots - 1).cast("bigint"), "draw", spark.range(lo, hi).withColumnRenamed("id", "shard"))
        draws = draws.withColumn("at", _drawn(F.lit(seed), F.col("shard"), F.col("draw")) % total).withColumn("cell", F.expr(f"at div {cell}"))
        parts = expected.filter((F.col("kind") == kind) & (F.col("part") > 0)).select("tree", "part", "start")
        parts = _steps(F.expr(f"start div {cell}"), F.expr(f"(start + part - 1) div {cell}"), "cell", parts)
        hit = draws.join(parts, "cell").filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("part")))
        found.append(hit.select("tree", "shard", F.lit(1).cast("bigint").alias("n")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("tree", "shard").agg(F.sum("n").alias("n"))


@dataclass
class Mix:
    """documents: row, doc_id, tree (its source's rank), size, start. sources: tree, source, size, weight, target, blocks, quota.
    slots: shard, slot, tree, epoch, block. spans: shard, slot, row, doc_id, place (in the block), first (word), words."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    spans: DataFrame


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, length: int = LENGTH, shard: int = SHARD, passes: int = PASSES, seed: int = 0) -> Mix:
    """Mixes docs (doc_id, source, text)."""
    rows = pick(docs, ["doc_id", "source", "text"])
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = materialize(rows.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("hash")), "mix-sizes")
    sources = ranked(sized.groupBy("source").agg(F.sum("size").alias("size")), [F.col("source").asc_nulls_last()], name="tree")
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("tree") % len(weights) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", weight), "mix-sources")
    sources = materialize(_quotas(targets(sources, passes), length), "mix-targets")
    named = sources.select("tree", F.col("source").alias("_source"))
    placed = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "tree", "size", "hash")
    placed = running(placed, "size", [F.col("doc_id"), F.col("size"), F.col("hash")], ["tree"])
    placed = materialize(placed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "tree", "size", "start"), "mix-documents")
    slots = sources.agg(F.sum("quota")).first()[0] or 0
    if slots:
        counts = _counts(sources.select("tree", "quota"), slots, shard, seed)
        earlier = lambda by, order: W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        before = lambda by, order: F.coalesce(F.sum("n").over(earlier(by, order)), F.lit(0))
        counts = counts.withColumn("before", before("tree", "shard")).withColumn("left", before("shard", "tree"))
    else:
        counts = sized.sparkSession.createDataFrame([], "tree long, shard long, n long, before long, left long")
    wide = F.least(F.lit(shard).cast("bigint"), slots - F.col("shard") * shard)
    seeds = lambda e: F.lit(seed) * 7 + (F.col("tree") * passes + e) * 2 + 1
    epochs = F.sequence(F.lit(0).cast("bigint"), F.lit(passes - 1).cast("bigint"))
    orders = sources.select("tree", "blocks", F.transform(epochs, lambda e: round_keys(F.col("blocks"), seeds(e))).alias("orders"))
    counts = counts.withColumn("wide", wide).withColumn("order", round_keys(F.col("wide"), F.lit(seed) * 7 + F.col("shard") * 2))
    filled = _steps(F.lit(0).cast("bigint"), F.col("n") - 1, "i", counts.join(orders, "tree"), _tasks(docs.sparkSession, slots))
    filled = filled.withColumn("k", F.col("before") + F.col("i")).filter(F.col("k") < passes * F.col("blocks"))
    filled = filled.withColumn("epoch", F.expr("k div blocks"))
    filled = filled.select(
        "shard", shuffled(F.col("left") + F.col("i"), F.col("wide"), F.col("order")).alias("slot"), "tree", "epoch",
        shuffled(F.expr("k % blocks"), F.col("blocks"), F.get("orders", F.col("epoch").cast("int"))).alias("block"),
    )
    filled = materialize(filled, "mix-slots")
    first, end = F.expr(f"start div {length}"), F.expr(f"(start + size - 1) div {length}")
    pieces = _steps(first, end, "block", placed.filter("size > 0"))
    low = F.greatest(F.col("start"), F.col("block") * length)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * length)
    pieces = pieces.select("tree", "block", "row", "doc_id", (low - F.col("block") * length).alias("place"), (low - F.col("start")).alias("first"), (high - low).alias("words"))
    spans = filled.join(pieces, ["tree", "block"]).select("shard", "slot", "row", "doc_id", "place", "first", "words")
    discard(sized)
    return Mix(placed, sources, filled, spans)


def texts(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """shard, slot, text: the words of each filled slot, joined by blanks, from docs (doc_id, text) whose ids are all different."""
    own = docs.select("doc_id", F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("_words"))
    pieces = spans.join(own, "doc_id").select("shard", "slot", "place", F.slice("_words", (F.col("first") + 1).cast("int"), F.col("words").cast("int")).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "part")))  # of `length` words at most
    return pieces.groupBy("shard", "slot").agg(F.array_join(F.flatten(F.transform(ordered, lambda p: p["part"])), " ").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mix(table(spark, sf_dir, "documents"))
    taken = made.spans.groupBy("row").agg(F.sum("words").alias("taken"))
    own = made.sources.select("tree", F.col("size").alias("source_size"), "target")
    rows = made.documents.join(taken, "row", "left").join(own, "tree")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def _sql(length: int = LENGTH, shard: int = SHARD, passes: int = PASSES, turns: int = 24) -> str:
    mixed = lambda x, salt: f"(({x}) % 2147483647 * 1103515245 + 12345 + {salt * 7919}) % 2147483647"
    key = lambda salt: f"(({mixed('s % 2147483647 * 64 + r', salt)}) * 48271 + (({mixed('s % 2147483647 * 64 + r', salt)}) >> 13)) % 2147483647"
    other = f"(((({key(1)}) * 2147483647 + {key(2)}) % n - x) + n) % n"
    swap = f"((greatest(x, {other}) % 2147483647 * (({key(3)}) + 1) + {key(4)}) % 2147483647) >> 9"
    shares = ["l0 AS (SELECT CAST(sum(size) AS DOUBLE) / sum(weight) AS lam FROM s1)"]
    for k in range(turns):  # a turn more changes nothing once none is above
        shares.append(f"l{k + 1} AS (SELECT coalesce(CAST(sum(size) - coalesce(sum(size * {passes}) FILTER (size * {passes} <= lam * weight), 0) AS DOUBLE)"
                      f" / sum(weight) FILTER (size * {passes} > lam * weight), any_value(lam)) AS lam FROM s1, l{k})")  # fmt: skip
    shares = ",\n".join(shares)
    return rf"""
WITH RECURSIVE d0 AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS tree FROM d0 GROUP BY source),
s1 AS (SELECT *, CAST([5, 2, 1][tree % 3 + 1] AS BIGINT) AS weight FROM s0),
{shares},
s2 AS (SELECT *, CASE WHEN size * {passes} <= lam * weight THEN CAST(size * {passes} AS DOUBLE) ELSE lam * weight END AS target,
              CAST(ceil(size / {length}) AS BIGINT) AS blocks FROM s1, l{turns}),
s3 AS (SELECT *, CASE WHEN size > 0 THEN CAST(floor(target / size) AS BIGINT) ELSE 0 END AS whole FROM s2),
s4 AS (SELECT *, whole * blocks + least(CAST(floor((target - whole * size) / {length} + 0.5) AS BIGINT), blocks) AS quota FROM s3),
t AS (SELECT CAST(sum(quota) AS BIGINT) AS slots FROM s4),
kinds AS (SELECT 0 AS kind, {shard} AS wide, 0 AS lo, slots // {shard} AS hi, slots FROM t WHERE slots >= {shard}
          UNION ALL SELECT 1, slots % {shard}, slots // {shard}, slots // {shard} + 1, slots FROM t WHERE slots % {shard} > 0),
e0 AS (SELECT tree, kind, lo, hi, slots, wide * quota // slots AS n, wide * quota % slots AS part FROM s4, kinds),
e1 AS (SELECT *, coalesce(sum(part) OVER (PARTITION BY kind ORDER BY tree ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
              sum(part) OVER (PARTITION BY kind) AS total FROM e0),
dr0 AS (SELECT kind, total, unnest(range(lo, hi)) AS shard, total // slots AS times FROM (SELECT DISTINCT kind, lo, hi, total, slots FROM e1)),
dr1 AS (SELECT kind, total, shard, unnest(range(CAST(times AS BIGINT))) AS draw FROM dr0),
dr AS (SELECT kind, shard, CAST('0x' || substr(md5('0,' || shard || ',' || draw), 1, 15) AS BIGINT) % total AS v FROM dr1),
c0 AS (SELECT tree, unnest(range(lo, hi)) AS shard, n FROM e1
       UNION ALL SELECT tree, shard, 1 FROM dr JOIN e1 ON e1.kind = dr.kind AND v >= start AND v < start + part),
c1 AS (SELECT tree, shard, CAST(sum(n) AS BIGINT) AS n FROM c0 GROUP BY ALL),
c2 AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY tree ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM c1),
k0 AS (SELECT tree, before, unnest(range(n)) AS i FROM c2),
k1 AS (SELECT tree, (before + i) // blocks AS epoch, (before + i) % blocks AS x, blocks AS n FROM k0 JOIN s4 USING (tree) WHERE before + i < {passes} * blocks),
k2 AS (SELECT tree, n, (tree * {passes} + epoch) * 2 + 1 AS s, x, 0 AS r FROM k1
       UNION ALL SELECT tree, n, s, CASE WHEN ({swap}) % 2 = 1 THEN {other} ELSE x END, r + 1 FROM k2 WHERE r < {ROUNDS}),
b0 AS (SELECT tree, x AS block, count(*) AS times FROM k2 WHERE r = {ROUNDS} GROUP BY ALL),
d1 AS (SELECT d0.*, tree, s4.size AS source_size, target, row_number() OVER () AS r,
              coalesce(sum(d0.size) OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d0.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
       FROM d0 JOIN s4 ON s4.source IS NOT DISTINCT FROM d0.source),
d2 AS (SELECT r, tree, start, size, unnest(range(CAST(start // {length} AS BIGINT), CAST((start + size - 1) // {length} AS BIGINT) + 1)) AS block FROM d1 WHERE size > 0),
d3 AS (SELECT r, sum(times * (least(start + size, (block + 1) * {length}) - greatest(start, block * {length}))) AS taken FROM d2 JOIN b0 USING (tree, block) GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM d1 LEFT JOIN d3 USING (r)"""


SQL = _sql()
