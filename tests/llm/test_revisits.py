"""Revisits name the response's record; versioned share-alike licenses in any spelling; the threshold in any order of tasks."""

import pytest
from pyspark.sql import functions as F

from jobloom.llm import license, url_filter, warc


def test_revisits_refer_to_the_records_of_responses(spark, tmp_path):
    body = "<p>" + "same words " * 200 + "</p>"
    rows = [(1, "http://a/1", body), (2, "http://a/2", body), (9, "http://a/9\r\n", body), (3, "http://a/3", "short"), (4, "http://a/4", "short"), (5, "http://a/5", body + "x"), (None, "http://a/n", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    found = {}
    for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(f"file://{tmp_path}/w").collect():
        for data in warc.records(bytes(f.content)):
            headers, _ = warc.parsed(data)
            found[headers.get("X-Page-ID")] = headers
    assert {k: h["WARC-Type"] for k, h in found.items()} == {"1": "revisit", "2": "revisit", None: "revisit", "9": "response", "3": "response", "4": "response", "5": "response"}
    for k in ("1", "2", None):
        assert found[k]["WARC-Refers-To"] == found["9"]["WARC-Record-ID"] and found[k]["WARC-Refers-To-Target-URI"] == "http://a/9" == found["9"]["WARC-Target-URI"]


@pytest.mark.parametrize("text, label", [
    ("Creative Commons Attribution Share Alike 4.0", "cc-by-sa-4.0"), ("creative commons attribution-sharealike 3.0 unported", "cc-by-sa-3.0"), ("Creative Commons Attribution ShareAlike", "cc-by-sa"),
])
def test_share_alike(spark, text, label):
    docs = spark.createDataFrame([(1, f"This text is {text} and so on")], "doc_id long, text string")
    assert label in {d.label for d in license.scan(docs).first().detections}


def test_the_threshold_does_not_depend_on_the_order_of_tasks(spark):
    rows = [(i, f"http://{'example.net/en' if i % 2 else 'b.net'}/p{i * i % 97}/{'abc' * (i % 5)}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    one, two = (url_filter.judge(pages.repartition(n, F.col("url")).sortWithinPartitions("url")) for n in (1, 7))
    assert sorted(one.collect()) == sorted(two.collect())
