"""The Merkle manifest against a plain tree over small tables: heights, ties, nulls, single rows and tampering."""

import hashlib
import re
import zlib

import pytest
from pyspark import RDD

from jobloom.llm import manifest
from tests.llm.test_queries import folder  # noqa: F401


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def level_up(nodes):
    return [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]


def plain_proof(nodes, at):
    proof = []
    while len(nodes) > 1:
        first = at - at % 8
        proof += [n for k, n in enumerate(nodes[first : first + 8], first) if k != at]
        nodes, at = level_up(nodes), at // 8
    return proof, nodes[0]


def plain_fold(leaf, nodes, at):
    while len(nodes) > 1:
        nodes = [leaf if k == at else n for k, n in enumerate(nodes)]
        leaf, nodes, at = level_up(nodes)[at // 8], level_up(nodes), at // 8
    return leaf


def plain(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""

    def leaf(doc_id, text, lang, source, n_chars):
        parts = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
        return sha("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row, leaf(*row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    tops = [plain_proof([n for _, n in groups[g]], 0)[1] for g in order]
    root, out = plain_proof(tops, 0)[1], []
    for t, g in enumerate(order):
        nodes = [n for _, n in groups[g]]
        for at, (row, own) in enumerate(groups[g]):
            proof = plain_proof(nodes, at)[0] + plain_proof(tops, t)[0]
            now = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                now = leaf(row[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[1]), *row[2:])
            folded = plain_fold(plain_fold(now, nodes, at), tops, t)
            out.append((row[0], own, tops[t], root, sha("".join(proof)), folded, folded == root))
    return sorted(out, key=str)


def documents(sizes):
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 7
            rows.append((i % 1009, [f"Text {i}", f"lower {i}", None, "", "ÄÖ A"][i % 5], lang, None if i % 11 == 0 else f"s{i % 3}", None if i % 13 == 0 else i))
    return rows


@pytest.mark.parametrize("sizes", [
    {"en": 1}, {"en": 8}, {"en": 9, None: 1, "é": 2}, {"en": 140, "de": 64, "fr": 65, None: 3, "": 1},
    {f"l{k}": k % 4 + 1 for k in range(75)},
], ids=["one", "run", "nulls", "heights", "many trees"])
def test_manifest(spark, folder, sizes):  # noqa: F811
    rows = documents(sizes)
    rows += [rows[0], (None, "No Id", "en", None, None), (rows[-1][0], "Same ID", rows[-1][2], "x", 1)]
    table = [(*row, 1.0, "clash") for row in rows]
    got = manifest.query(spark, folder(documents=table)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    assert any(not r.verified for r in got) or len(rows) < 9


def test_empty_manifest(spark, folder):  # noqa: F811
    assert manifest.query(spark, folder()).collect() == []


def test_missing_children_are_an_error(spark):
    steps = manifest._Steps(spark, 8)
    lost = spark.sparkContext.parallelize([((0, 0), (3, 0, b"a")), ((0, 0), (3, 2, b"c"))])
    with pytest.raises(Exception, match="missing"):
        steps.gathered(lost, 1).collect()


@pytest.fixture
def many_partitions(monkeypatch):
    """Pairs are dealt to 64 partitions at least, most of them empty."""
    deal = RDD.partitionBy
    monkeypatch.setattr(RDD, "partitionBy", lambda self, n, *more: deal(self, max(64, n or 0), *more))


def put_together_by_spark(rdd):
    """Whether partitions of the last stage are put together before Python opens them."""
    stage = rdd.toDebugString().decode().partition("+-")[0]
    kinds = re.findall(r"(\w+RDD)\[", stage)
    return "PythonRDD" in kinds and "PythonRDD" not in kinds[kinds.index("CoalescedRDD") :]


def test_python_opens_no_more_partitions_than_tasks(spark, many_partitions):
    steps = manifest._Steps(spark, 8)
    messages = spark.sparkContext.parallelize([((t, 0), (2, k, bytes([t, k]))) for t in range(20) for k in range(2)], 3)
    level = steps.gathered(messages, 2)
    assert sorted(level.collect()) == [((t, 0), (2, [bytes([t, 0]), bytes([t, 1])])) for t in range(20)]
    paths = spark.sparkContext.parallelize([((t, 0), bytes([t])) for t in range(20)], 3)
    below = steps.downward([level], paths.map(lambda p: (p[0][0], (0, p[1]))), 40, 20)
    assert sorted(below.collect()) == [((t, 0), (2, [bytes([t, 0]), bytes([t, 1])], bytes([t]))) for t in range(20)]
    assert level.getNumPartitions() == 2 and put_together_by_spark(level)
    assert below.getNumPartitions() == 1 and put_together_by_spark(below)


def test_manifest_over_many_partitions(spark, folder, many_partitions):  # noqa: F811
    rows = documents({"en": 80, "de": 9, None: 1})
    got = manifest.query(spark, folder(documents=[(*row, 1.0, "clash") for row in rows])).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


@pytest.mark.parametrize("level, paths", [([0, 1], [0]), ([0], [0, 1]), ([0, 0], []), ([], [0, 0])])
def test_a_vertex_has_one_path(spark, level, paths):
    steps = manifest._Steps(spark, 8)
    level = spark.sparkContext.parallelize([((0, p), (8, [b"a"])) for p in level], 1)
    paths = spark.sparkContext.parallelize([((0, p), b"") for p in paths], 1)
    with pytest.raises(Exception, match="counterpart|twice"):
        steps.answered(level, paths, 1).collect()


def test_tasks_of_many_small_trees(spark):
    steps, most = manifest._Steps(spark, 8), manifest.VERTICES
    assert steps.tasks(10**7, 10**7, 0) >= 10**7 / most  # trees of one leaf: a vertex each
    assert steps.tasks(9 * 10**6, 10**6, 1) >= 10**6 / most  # of nine: two parents each, then one
    assert steps.tasks(10**9, 4, 0) == -(-(10**9 // 8 + 4) // most)
    assert steps.tasks(10**9, 10**8, 8) == 1
