"""Ranks and running sums over ranges against plain ones; feeds in pages and slugs of a hot root that rest on them."""

import random

from pyspark.sql import functions as F

from jobloom.operators import fulfil, ranks, search
from jobloom.schemas import COMPANIES, LISTINGS
from jobloom.sources.views import NOW_MS, view
from tests.test_tables import company, listing


def test_ranks_and_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 0, 1, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    got = {r.o: r.place for r in ranks.ranked(df, [F.col("o").desc()], ["g"], partitions=7).collect()}
    for g in ("a", "b", None):
        own = sorted((o for x, o, _ in rows if x == g), reverse=True)
        assert [got[o] for o in own] == list(range(len(own)))
    assert sorted(r.place for r in ranks.ranked(df, [F.col("o")]).collect()) == list(range(400))
    sums = {r.o: r.start for r in ranks.running(df, "v", [F.col("o")], ["g"], partitions=6).collect()}
    for g in ("a", "b", None):
        before = 0
        for _, o, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            assert sums[o] == before
            before += v or 0
    assert ranks.ranked(df.limit(0), [F.col("o")]).count() == 0


def test_a_hot_group_is_spread(spark):
    df = spark.range(20_000).withColumn("g", F.lit("all"))
    tasks = ranks.ranked(df, [F.col("id")], ["g"], partitions=8).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1


def test_all_pages_at_once(spark, small):
    rows, companies = view(spark, small, "listings_v"), view(spark, small, "companies_v")
    feed = search.all_active(rows, companies, NOW_MS).select("id", "posted_at").filter("id LIKE '%1'").cache()
    paged = search.feed_pages(feed, 4).collect()
    for page in range(1, 4):
        want = {r.id for r in feed.orderBy(F.col("posted_at").desc(), "id").offset(4 * page - 4).limit(4).collect()}
        assert {r.id for r in paged if r.page == page} == want
    assert len(paged) == feed.count()


def test_slugs_of_one_root(spark):
    wanted = spark.createDataFrame([(f"c{i}", "company", i * 7 % 101) for i in range(101)], "id string, root string, at int")
    taken = spark.createDataFrame([(f"company{x}",) for x in ("", "-3", "-4", "-50", "-x")], "slug string")
    plain, spread = ({r.id: r.slug for r in fulfil.unique_slugs(wanted, taken, n).collect()} for n in (1000, 10))
    free = [n for n in range(2, 200) if n not in (3, 4, 50)]
    order = sorted(range(101), key=lambda i: i * 7 % 101)
    assert plain == spread == {f"c{i}": f"company-{n}" for i, n in zip(order, free)}


def test_views_are_those_of_the_store(spark, tmp_path):
    from jobloom.sources.store import TableStore

    store = TableStore(spark, f"file://{tmp_path}/db")
    store.write("companies", spark.createDataFrame([company("c1")], COMPANIES))
    store.write("listings", spark.createDataFrame([listing("a"), listing("b", status="expired")], LISTINGS))
    assert store.read("listings").filter("status = 'active'").count() == 1
