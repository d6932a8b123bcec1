"""The store as a data source, and the text rules as SQL functions."""

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from jobloom.schemas import COMPANIES, LISTINGS
from jobloom.sources import table_source
from jobloom.sources.store import TableStore
from jobloom.sources.views import NOW_MS
from tests.test_tables import company, listing


@pytest.fixture
def store(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/db", bucket_rows=50)
    store.write("companies", spark.createDataFrame([company("c1"), company("c2")], COMPANIES))
    rows = [listing(f"l{i}", status="active" if i % 2 else "expired", expires_at=NOW_MS + i, comp_min=i) for i in range(200)]
    store.write("listings", spark.createDataFrame(rows, LISTINGS))
    return store


def test_a_search_opens_only_folders_that_may_match(spark, store):
    table_source.views(spark, store.root)
    entries = store.manifest("listings", store.current("listings"))["entries"]
    ask = lambda where: spark.sql(f"SELECT id, comp_min FROM listings WHERE {where}")
    opened = lambda df: df.rdd.getNumPartitions()
    assert opened(spark.table("listings")) == len(entries) == 8
    active = ask("status = 'active'")
    assert opened(active) == 4 and sorted(active.collect()) == sorted(store.read("listings").filter("status = 'active'").select("id", "comp_min").collect())
    late = ask(f"status IN ('active', 'filled') AND expires_at > {NOW_MS + 196}")
    assert opened(late) == sum(e["status"] == "active" and e["high"] > NOW_MS + 196 for e in entries) < 4 and {r.id for r in late.collect()} == {"l197", "l199"}
    none = ask(f"expires_at > {NOW_MS + 1000}")
    assert none.collect() == []
    assert spark.sql("SELECT name, count(l.id) AS n FROM companies c LEFT JOIN listings l ON l.company_id = c.id GROUP BY name ORDER BY name").collect() == [("c1", 200), ("c2", 0)]


def test_a_commit_can_be_named(spark, store):
    store.write("companies", spark.createDataFrame([company("c1")], COMPANIES), check=False)
    read = lambda **own: spark.read.format("jobloom").options(path=store.root, table="companies", **own).load()
    assert read().count() == 1 and read(commit="0").count() == 2 and read(commit="0").schema == COMPANIES
    assert spark.read.format("jobloom").options(path=store.root, table="paid_listings").load().count() == 0


def test_bounds():
    entry = {"status": "active", "low": 10, "high": 20}
    fits = lambda kind, name, value: table_source.may_fit(entry, kind((name,), value))
    assert [fits(k, "expires_at", v) for k, v in ((D.GreaterThan, 20), (D.GreaterThanOrEqual, 20), (D.LessThan, 10), (D.LessThanOrEqual, 10), (D.EqualTo, 21), (D.EqualTo, 15))] == [False, True, False, True, False, True]
    assert fits(D.EqualTo, "status", "active") and not fits(D.EqualTo, "status", "x") and fits(D.EqualTo, "title", "x")
    assert table_source.may_fit({"status": None, "low": None, "high": None}, D.GreaterThan(("expires_at",), 5))


def test_functions_say_what_the_rules_say(spark):
    assert len(table_source.register(spark)) == len(table_source.FUNCTIONS)
    texts = [None, "", " A  b ", "Ünï & <b>\"x\"'", "C++ \\ & it's 100%", "careers 12,5", "&lt;p&gt;&amp;nbsp;"]
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "s string, n bigint")
    for name, (types, rule) in table_source.FUNCTIONS.items():
        own = ["s" if k == "string" else f"CAST(n * 1000 AS {k})" for k in types.split(", ")]
        want = rows.select(rule(*[F.expr(a) for a in own]).alias("x")).collect()
        assert rows.selectExpr(f"jobloom_{name}({', '.join(own)}) AS x").collect() == want, name
