"""The queries against their oracles, and the pipeline against its stages' brute-force rules."""

import duckdb
import pytest

import corpus_pipeline
from jobloom.llm import decontaminate, registry, simhash

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = registry.queries()[name](spark, small)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def test_ten_operators_and_the_pipeline():
    names = registry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, at, small)
        assert after.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in after.collect()}
        at = spark.createDataFrame(after.collect(), docs.schema)
    good, single, clean = kept.values()
    # One of each group of near copies stays, the one with the smallest id.
    from tests.llm.test_operators import brute_components, brute_fingerprint, brute_overlap

    prints = {i: brute_fingerprint(t) for i, t in good.items()}
    roots = brute_components(list(prints.values()))
    least = {}
    for i, f in prints.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert set(single) == set(least.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    over = {i: brute_overlap(t, items) for i, t in single.items()}
    assert set(clean) == {i for i, (n, hit, _) in over.items() if not (hit and 20 * hit >= n)}
    packed = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in packed.collect()} == set(clean)
    assert simhash.SHINGLE == 3 and decontaminate.WIDTH == 13


def test_pipeline_on_no_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
