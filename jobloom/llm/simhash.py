"""SimHash near-duplicate detection by multi-index hashing, and connected components.

A fingerprint sums the bits of the XXH64 of every word shingle. Two fingerprints link at `RADIUS` = 2 or fewer differing
bits. Each fingerprint is entered in two tables, one for each half (segment) of 32 bits, under the value of that half. Two
fingerprints within 2 bits differ by at most 1 in the first half or not at all in the second, so each looks up the ball of
radius 1 around its first half and its second half as it is; of two that differ in a bit the one where it is set finds
the other, so the members of the ball where a bit is added aren't needed. What an entry's fingerprints and those that
look it up have in common is one half only: the distance over all 64 bits decides.

An entry that more than `BUCKET` different fingerprints share, or that members of such an entry look up, isn't paired but
cut again, by the halves of the bits that are not yet compared and within the distance that is left: entries of 48, then of
56 common bits. So an entry has at most `BUCKET` fingerprints and 33 times as many that look it up or, at 56 bits, at most
256 and 57 times as many, whatever the data; no link is lost and none is left out. Links and components stay distributed.
Copies have one fingerprint and are grouped before anything else.

Defined cases: null and empty texts, and texts of white space, have fingerprint 0 and link like any other; fewer words
than a shingle make one shingle of them all; repeated rows share their component; a null doc_id never names a component
unless no other id is in it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import LOWER_TABLE, discard, extended, materialize, pick, raw, sealed, table, unsealed

NAME = "op3_simhash"
SQL = None
SHINGLE = 3
SEED = 42
RADIUS = 2
#: Different fingerprints that an entry may have before it is cut again, and how often: 32, 48, 56 common bits.
BUCKET = 64
LEVELS = 3
ROWS = 200_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text in UTF-8."""
    w = text.translate(LOWER_TABLE).split() if text else []
    if not w:
        return 0
    size, digest = min(shingle, len(w)), xxhash.xxh64_intdigest
    n = len(w) - size + 1
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 16384):  # a long text takes no more memory than this
        some = [digest(b" ".join(w[k : k + size]), SEED) for k in range(i, min(n, i + 16384))]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and fp (the fingerprint's 64 bits as a signed long) of each row of docs (text and keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in raw(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.array(found.view(np.int64))], [*keys, "fp"])

    docs = pick(docs, list(dict.fromkeys([*keys, "text"])))
    return docs.mapInArrow(run, extended(docs, [*keys], "fp long"))


def _halves(mask: int) -> list[tuple[int, range]]:
    """The two masks that add half of the bits that mask lacks, and the bits that each adds. Those bits stand together."""
    lacking = [bit for bit in range(64) if not mask >> bit & 1]
    low, high = lacking[: len(lacking) // 2], lacking[len(lacking) // 2 :]
    return [(mask | sum(1 << bit for bit in half), range(half[0], half[-1] + 1)) for half in (high, low)]


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _by_mask(of: dict[int, Column]) -> Column:
    """of[the row's mask]."""
    out = None
    for mask, column in of.items():
        is_it = F.col("mask") == _signed(mask)
        out = F.when(is_it, column) if out is None else out.when(is_it, column)
    return out


def _longs(numbers: Iterable[int]) -> Column:
    return F.array(*[F.lit(_signed(n)).cast("long") for n in numbers])


def _entries(owners: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, mask, value): the entries of fingerprints (fp, mask) in the tables of the next level."""
    below = F.explode(_by_mask({m: _longs(half for half, _ in _halves(m)) for m in masks}))
    return owners.select("fp", below.alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def _lookups(asks: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, x, spare, mask, value): what asks (fp, x, spare, mask) look up in the tables of the next level.

    x is the fingerprint with the bits cleared that its partner lacks, spare how many more differing bits may be met.
    """

    def members(mask: int) -> Column:
        (first, bits), (second, _) = _halves(mask)
        same = F.array(*[F.struct(F.col("x"), F.col("spare"), F.lit(_signed(m)).cast("long").alias("mask")) for m in (first, second)])
        is_set = F.filter(_longs(1 << bit for bit in bits), lambda bit: F.col("x").bitwiseAND(bit) != 0)
        ball = F.transform(is_set, lambda bit: F.struct(F.col("x").bitwiseXOR(bit).alias("x"), F.lit(1).alias("spare"), F.lit(_signed(first)).cast("long").alias("mask")))
        return F.when(F.col("spare") == RADIUS, F.concat(same, ball)).otherwise(same)

    found = asks.select("fp", F.inline(_by_mask({m: members(m) for m in masks})))
    return found.withColumn("value", F.col("x").bitwiseAND(F.col("mask")))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """All links (a, b), a > b, between different fingerprints (column fp, distinct) of at most 2 differing bits.

    A link may be there more than once.
    """
    spark = fps.sparkSession
    top = F.lit(0).cast("long").alias("mask")
    asks, owners = fps.select("fp", F.col("fp").alias("x"), F.lit(RADIUS).alias("spare"), top), fps.select("fp", top)
    masks, found = [0], []
    for _ in range(LEVELS):
        asks, owners = _lookups(asks, masks), _entries(owners, masks)
        masks = [half for m in masks for half, _ in _halves(m)]
        last = any(bin(m).count("1") == 56 for m in masks)
        full = None
        if not last:
            shared = owners.groupBy("mask", "value").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).drop("n")
            # Members of a full entry look up those that lack one of its bits: these are cut again, too.
            lacking = F.filter(_longs(1 << bit for bit in range(64)), lambda bit: F.col("value").bitwiseAND(bit) != 0)
            near = F.concat(F.array("value"), F.transform(lacking, lambda bit: F.col("value").bitwiseXOR(bit)))
            full = materialize(shared.select("mask", F.explode(near).alias("value")).distinct(), "full-entries")
            if full.isEmpty():
                full = None
        here = (asks, owners) if full is None else (asks.join(full, ["mask", "value"], "left_anti"), owners.join(full, ["mask", "value"], "left_anti"))
        pairs = here[0].join(here[1].withColumnRenamed("fp", "other"), ["mask", "value"])
        once = (F.col("x") != F.col("fp")) | (F.col("other") < F.col("fp"))
        found.append(pairs.filter(once & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS)))
        if full is None:
            break
        asks, owners = asks.join(full, ["mask", "value"], "left_semi"), owners.join(full, ["mask", "value"], "left_semi")
    pairs = [df.select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")) for df in found]
    return reduce(DataFrame.union, pairs)


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of edges (a, b), a > b: root is the smallest node that is reachable.

    Large-star and small-star rounds until nothing changes; each round is written to the shared folder, in a file for
    every ROWS links or less: most rounds are small, and a file costs a task and a process of its own on a local disk.
    """

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    def written(df: DataFrame, rows: int) -> DataFrame:
        return materialize(df.coalesce(max(1, -(-rows // ROWS))), "links")

    edges = materialize(edges.select("a", "b").distinct(), "links")
    before = state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = edges.join(least, "b").select("a", F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, 2 * before[0])
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).distinct()
        old, edges = edges, written(small, 2 * before[0])
        discard(old, large)
        now = state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    if before[0]:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def placed(own: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint of own (doc_id, fp): root is the smallest fingerprint that is reachable."""
    spark = own.sparkSession
    fps = materialize(own.select("fp").distinct(), "distinct-fingerprints")
    # Each fingerprint makes about 20 rows: the small table is dealt out first, so that they don't come from a few tasks.
    roots = components(links(fps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return materialize(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "placed")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of all that are reachable) for each row of docs (doc_id, text)."""
    own = materialize(fingerprints(docs), "fingerprints")
    where = placed(own)
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = first.join(where, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(where.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs of each component, with all its columns: of the smallest doc_id, and of one of its repeated rows."""
    spark = docs.sparkSession
    own = fingerprints(sealed(docs), keys=("rest", "text", "doc_id")).withColumn("row", F.monotonically_increasing_id())
    own = materialize(own, "fingerprinted")  # the row numbers are fixed from here on
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = own.groupBy("fp").agg(F.min(order).alias("first"))
    first = first.join(placed(own), "fp").groupBy("root").agg(F.min("first").alias("first"))
    return unsealed(own.join(first.select(F.col("first.row").alias("row")), "row", "left_semi"), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
