"""Mixing: targets, draws, orders and blocks over small tables, held against a plain version."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobloom.llm import mixing
from tests.llm.test_queries import SCHEMAS, folder  # noqa: F401


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(sizes, weights=(5, 2, 1), passes=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, total, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        share = (total - sum(out.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if share * weight[s] >= passes * sizes[s]}
        if not above:
            return out | {s: share * weight[s] for s in open_}
        out |= {s: passes * sizes[s] for s in above}
        open_ -= above
    return out


def corpus(seed, sources, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(sources)
        text = rng.choice(["  ", "\t", " "]).join(f"{source}{i}w{k}" for k in range(rng.choice([0, 1, 3, 7, 40, 300])))
        rows.append((i, rng.choice([None, ""]) if not text else text, "en", source, 0, 1.0, "x"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    sources = ["a", "b", None, "é", "𝒳", "zz", "none"]
    rows = corpus(seed, sources, 150) + [(500, "only words here", "en", "tiny", 0, 0.0, ""), (501, " ", "en", "blank", 0, 0.0, ""), (None, "x y", "en", "a", 0, 0.0, "")]
    docs = spark.createDataFrame(rows, SCHEMAS["documents"])
    made = mixing.mix(docs, length=4, shard=128)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = plain_targets(sizes)
    own = {r["source"]: r for r in made.sources.collect()}
    assert {s: r["size"] for s, r in own.items()} == dict(sizes)
    assert all(own[s]["target"] == pytest.approx(want[s]) for s in want)
    slots = made.slots.collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots)  # no slot is filled twice
    assert len({(r.tree, r.epoch, r.block) for r in slots}) == len(slots)  # no pass takes a block twice
    assert all(0 <= r.block < -(-sizes[next(s for s in own if own[s].tree == r.tree)] // 4) and 0 <= r.epoch < 3 for r in slots)
    per_shard = Counter(r.shard for r in slots)
    assert max(per_shard.values()) <= 128 and len(per_shard) > 3
    # Passes are begun one after the other.
    passes = defaultdict(Counter)
    for r in slots:
        passes[r.tree][r.epoch] += 1
    for s, r in own.items():
        assert all(passes[r.tree][e] == r.blocks for e in range(max(passes[r.tree], default=0)))
    taken = Counter()
    spans = made.spans.collect()
    by_id = {r[0]: (words(r[1]), r[3]) for r in rows}
    for r in spans:
        assert 0 < r.words <= 4 and r.first + r.words <= len(by_id[r.doc_id][0])
        taken[by_id[r.doc_id][1]] += r.words
    shards = len(per_shard)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 4 * (2 + 3 * shards**0.5)
    for i, n in Counter(r.doc_id for r in spans).items():
        assert sum(r.words for r in spans if r.doc_id == i) <= 3 * len(by_id[i][0])
    again = mixing.mix(docs.repartition(7), length=4, shard=128)
    assert sorted(again.slots.collect()) == sorted(slots)
    ids = docs.filter("doc_id IS NOT NULL")
    text = {(r.shard, r.slot): r.text.split(" ") for r in mixing.texts(made.spans, ids).collect()}
    for r in spans:
        if r.doc_id is not None:
            got = text[r.shard, r.slot]
            assert all(w in got for w in by_id[r.doc_id][0][r.first : r.first + r.words]) and len(got) <= 4


def test_orders_are_permutations(spark):
    rows = spark.createDataFrame([(n, s) for n in (1, 2, 3, 64, 1000) for s in range(3)], "n long, seed long")
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.withColumn("y", mixing.shuffled(F.col("x"), F.col("n"), mixing.round_keys(F.col("n"), F.col("seed")))).collect()
    orders = defaultdict(dict)
    for r in rows:
        orders[r.n, r.seed][r.x] = r.y
    assert all(sorted(o.values()) == list(range(n)) for (n, _), o in orders.items())
    assert len({tuple(orders[1000, s].values()) for s in range(3)}) == 3
    assert sum(orders[1000, 0][x] == x for x in range(1000)) < 20


def test_query_takes_what_targets_say(spark, folder):  # noqa: F811
    rows = corpus(9, ["a", "b", "c", None], 200)
    got = mixing.query(spark, folder(documents=[*rows, rows[5]])).collect()
    sizes, taken = Counter(), Counter()
    for r in [*rows, rows[5]]:
        sizes[r[3]] += len(words(r[1]))
    want = plain_targets(sizes)
    by_size = {sizes[s]: s for s in sizes}
    assert len(got) == len(rows) + 1
    for r in got:
        s = by_size[r.source_size]
        taken[s] += r.taken
        assert r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 4 * mixing.LENGTH for s in want)


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "a", 0, 0.0, ""), (2, " ", "en", None, 0, 0.0, "")]])
def test_nothing_to_mix(spark, folder, rows):  # noqa: F811
    got = mixing.query(spark, folder(documents=rows)).collect()
    assert sorted(map(tuple, got)) == [(r[0], 0, 0, 0.0, 0) for r in rows]
