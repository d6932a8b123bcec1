"""Merkle manifest of a dataset by Pregel-style supersteps over RDDs: tree hashes, a proof for each row, and its check.

Each row is a leaf. Leaves of a group stand in order of their id; every `ARITY` consecutive nodes have a parent, until one
is left: the group's subroot. The subroots, in order of their groups, are the leaves of one more tree, whose root names the
whole dataset. Hashes are SHA-256; an inner node hashes its children's digests as lowercase hex.

A vertex is (tree, number in its level). In an upward superstep each node sends its digest to its parent; a parent whose
children have all reported hashes them, and forwards its own digest in the next. A node alone in its level has no parent
and stops: trees of any height climb together. In the reverse supersteps, from the root down, a parent sends each child the
path that it got itself, with the child's siblings put before it, until the leaves' parents hold it; each leaf is folded
there, as it is now, with its path, and compared with the root.

A vertex has at most `ARITY` messages; those that follow each other are combined before the shuffle. Leaves are numbered by
distributed ranks, so siblings mostly do, and only their parent's list moves. A task holds its vertices, about `VERTICES` at
most, in memory. Each level is written to the shared folder, so a lost executor costs a part of one superstep; their number
is the tree's height. The driver learns how many rows the largest group has, how many groups there are, and the root.

Defined cases: nulls are hashed as `-`; a null group is a group, the first; rows of equal id are ordered by leaf, and a null
id comes first and isn't tampered with; repeated rows are leaves each; extra columns are not read; an empty table has no
rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.llm.common import delete_folder, discard, fresh_dir, materialize, pick, table
from jobloom.operators.ranks import ranked

NAME = "op11_manifest"
ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Vertices that a task of a superstep holds, about; fewer, down to FEW, while the cluster has idle cores.
VERTICES, FEW = 50_000, 2_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(columns: Iterable[Column]) -> Column:
    """SHA-256, 32 bytes, of the columns: each `-` if null, else its length in UTF-8 bytes, a colon and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def joined_digest(digests: Iterable[bytes]) -> bytes:
    """SHA-256 of digests as hex text, one after the other."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def cut(path: bytes) -> list[bytes]:
    return [path[i : i + 32] for i in range(0, len(path), 32)]


def fold(digest: bytes, place: int, size: int, siblings: Iterator[bytes], arity: int = ARITY) -> bytes:
    """The digest of the tree's top from that of node `place` of a level of `size` nodes and all siblings on the way up."""
    while size > 1:
        first = place - place % arity
        run = [digest if k == place else next(siblings) for k in range(first, min(first + arity, size))]
        digest, place, size = joined_digest(run), place // arity, -(-size // arity)
    return digest


class _Steps:
    """Supersteps whose results are written to the shared folder and read again."""

    def __init__(self, spark: SparkSession, arity: int):
        self.spark, self.arity, self.folders = spark, arity, []

    def written(self, rdd: RDD, label: str) -> RDD:
        self.folders.append(fresh_dir(self.spark, label))
        rdd.saveAsPickleFile(self.folders[-1])
        return self.spark.sparkContext.pickleFile(self.folders[-1])

    def discard(self) -> None:
        for folder in self.folders:
            delete_folder(self.spark, folder)
        self.folders.clear()

    def tasks(self, leaves: int, trees: int, level: int) -> int:
        """Tasks for a level of parents over so many leaves in all; in each tree that is high enough one may have a single child."""
        vertices = leaves // self.arity ** (level + 1) + min(trees, leaves // self.arity**level)
        return max(1, -(-vertices // VERTICES), min(-(-vertices // FEW), 2 * self.spark.sparkContext.defaultParallelism))

    def dealt(self, pairs: RDD, tasks: int) -> RDD:
        """pairs with those of a vertex in one task.

        Where a session deals to more partitions than asked for, they are put together before Python opens them: one that it
        opens costs tens of milliseconds, with or without rows, and those of one task follow each other.
        """
        return pairs.partitionBy(tasks).coalesce(tasks)

    def gathered(self, messages: RDD, tasks: int) -> RDD:
        """(parent, (size of the children's level, children in order)) of messages (parent, (size, place in the run, payload))."""
        arity = self.arity

        def combined(part):
            for vertex, run in groupby(part, itemgetter(0)):
                yield vertex, [message for _, message in run]

        def completed(part):
            vertices = {}
            for vertex, more in part:
                vertices.setdefault(vertex, []).extend(more)
            while vertices:
                (tree, place), found = vertices.popitem()
                size = found[0][0]
                children = sorted((k, payload) for _, k, payload in found)
                if [k for k, _ in children] != list(range(min(arity, size - arity * place))):
                    raise ValueError(f"children of vertex {place} of tree {tree} are missing")
                yield (tree, place), (size, [payload for _, payload in children])

        return self.dealt(messages.mapPartitions(combined), tasks).mapPartitions(completed)

    def answered(self, level: RDD, messages: RDD, tasks: int) -> RDD:
        """(vertex, (size, children, path)) of a level (vertex, (size, children)) and each vertex's message, its path."""

        def met(part):
            waiting = {}
            for vertex, (own, value) in part:
                if vertex not in waiting:
                    waiting[vertex] = own, value
                    continue
                was_own, other = waiting.pop(vertex)
                if was_own == own:
                    raise ValueError(f"vertex {vertex[1]} of tree {vertex[0]} was met twice")
                (size, children), path = (value, other) if own else (other, value)
                yield vertex, (size, children, path)
            if waiting:
                raise ValueError(f"{len(waiting)} vertices or paths have no counterpart")

        both = level.map(lambda v: (v[0], (True, v[1]))).union(messages.map(lambda m: (m[0], (False, m[1]))))
        return self.dealt(both, tasks).mapPartitions(met)

    def upward(self, leaves: RDD, total: int, trees: int, largest: int, digest_of) -> tuple[list[RDD], RDD]:
        """Levels of parents (vertex, (size, children)), lowest first, and (tree, (level that has its top, digest of the top)).

        leaves: `total` (tree, place, size of the tree, payload), digest_of the digest of a payload. Parents of parents have digests.
        """
        arity = self.arity
        level = self.gathered(leaves.map(lambda leaf: ((leaf[0], leaf[1] // arity), (leaf[2], leaf[1] % arity, leaf[3]))), self.tasks(total, trees, 0))
        levels, tops = [self.written(level, "merkle-level")], []

        def reported(vertex, read):
            (tree, place), (size, children) = vertex
            digests = [read(c) for c in children]
            return tree, place, -(-size // arity), digests[0] if size == 1 else joined_digest(digests)

        read = digest_of
        while True:
            largest = -(-largest // arity)
            up = levels[-1].map(lambda vertex, read=read: reported(vertex, read))
            tops.append(up.filter(lambda v: v[2] == 1).map(lambda v, height=len(levels) - 1: (v[0], (height, v[3]))))
            if largest <= 1:
                return levels, self.spark.sparkContext.union(tops)
            sent = up.filter(lambda v: v[2] > 1).map(lambda v: ((v[0], v[1] // arity), (v[2], v[1] % arity, v[3])))
            levels.append(self.written(self.gathered(sent, self.tasks(total, trees, len(levels))), "merkle-level"))
            read = bytes

    def downward(self, levels: list[RDD], tops: RDD, total: int, trees: int) -> RDD:
        """(vertex, (size, children, path)) of the lowest level: the siblings on the way up from there, then those above the tree.

        tops: (tree, (level that has its top, path above the tree)).
        """
        arity, below, sent = self.arity, None, None
        for k in range(len(levels) - 1, -1, -1):
            message = tops.filter(lambda t, k=k: t[1][0] == k).map(lambda t: ((t[0], 0), t[1][1]))
            message = message if sent is None else message.union(sent)
            below = self.answered(levels[k], message, self.tasks(total, trees, k))
            if k:

                def to_children(vertex):
                    (tree, place), (_, children, path) = vertex
                    for j in range(len(children)):
                        yield (tree, place * arity + j), b"".join(children[:j] + children[j + 1 :]) + path

                sent = self.written(below, "merkle-paths").flatMap(to_children)
        return below


def leaves(docs: DataFrame, changed: dict[str, Column], when: Column) -> DataFrame:
    """doc_id, lang, leaf and, where `when` holds, the leaf with some columns changed, of docs (FIELDS)."""
    rows = pick(docs, list(FIELDS))
    other = leaf_digest([changed.get(f, F.col(f)) for f in FIELDS])
    return rows.select("doc_id", "lang", leaf_digest(map(F.col, FIELDS)).alias("leaf"), F.when(when, other).alias("now"))


def verify(rows: DataFrame, arity: int = ARITY) -> DataFrame:
    """Manifest and check of rows (doc_id, lang, leaf, now): a tree for each lang, and one tree over them.

    now: the leaf as found today, null where it is the same. Returns doc_id, leaf, subroot, root, proof_sha256, folded_root
    and verified for each row, digests as lowercase hex.
    """
    spark = rows.sparkSession
    hashed = materialize(rows, "merkle-hashes")  # a range partition reads its input twice
    placed = materialize(ranked(hashed, [F.col("doc_id"), F.col("leaf"), F.col("now")], ["lang"]), "merkle-leaves")
    groups = placed.groupBy("lang").agg(F.count("*").alias("size"))
    groups = materialize(ranked(groups, [F.col("lang")], name="tree"), "merkle-groups")
    bounds = groups.agg(F.count("*").alias("n"), F.max("size").alias("largest"), F.sum("size").alias("all")).first()
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").fields])
    if not bounds.n:
        return spark.createDataFrame([], schema)
    numbered = placed.join(groups.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    steps = _Steps(spark, arity)
    own = numbered.select("tree", "place", "size", "doc_id", "leaf", "now").rdd.map(
        lambda r: (r[0], r[1], r[2], (r[3], bytes(r[4]), None if r[5] is None else bytes(r[5])))
    )
    levels, subroots = steps.upward(own, bounds["all"], bounds.n, bounds.largest, lambda payload: payload[1])
    n = bounds.n
    above, tops = steps.upward(subroots.map(lambda s: (0, s[0], n, s[1])), n, 1, n, lambda payload: payload[1])
    height, root = tops.first()[1]
    start = spark.sparkContext.parallelize([(0, (height, b""))], 1)

    def to_tops(vertex):
        (_, place), (_, children, path) = vertex
        for j, (height, own) in enumerate(children):
            # A tree's path starts with its subroot: the leaves report that, too.
            yield place * arity + j, (height, own + b"".join(c[1] for i, c in enumerate(children) if i != j) + path)

    entering = steps.written(steps.downward(above, start, n, 1).flatMap(to_tops), "merkle-tops")
    found = steps.downward(levels, entering, bounds["all"], n)

    def checked(vertex):
        (tree, place), (size, children, path) = vertex
        up = size
        passed = 0  # bytes of siblings between the leaves' parent and the subroot
        at = place
        while (up := -(-up // arity)) > 1:
            passed += 32 * (min(arity, up - at // arity * arity) - 1)
            at //= arity
        inner, subroot, outer = path[:passed], path[passed : passed + 32], path[passed + 32 :]
        for j, (doc_id, leaf, now) in enumerate(children):
            proof = [c[1] for k, c in enumerate(children) if k != j] + cut(inner) + cut(outer)
            siblings = iter(proof)
            folded = fold(leaf if now is None else now, place * arity + j, size, siblings, arity)
            folded = fold(folded, tree, n, siblings, arity)
            yield doc_id, leaf.hex(), subroot.hex(), root.hex(), joined_digest(proof).hex(), folded.hex(), folded == root

    result = materialize(spark.createDataFrame(found.flatMap(checked), schema, verifySchema=False), "merkle-checked")
    steps.discard()
    discard(hashed, placed, groups)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return verify(leaves(table(spark, sf_dir, "documents"), {"text": F.translate("text", _UPPER, _LOWER)}, tampered))


def _climb(name: str, nodes: str, rows: str, levels: int) -> str:
    """SQL of one forest: nodes (tree, p, n, h) and rows (tree, p, f, proof, ...) climb by levels; {name}_top, {name}_rows."""
    out = [f"{name}_n0 AS ({nodes})", f"{name}_r0 AS ({rows})"]
    for k in range(levels):
        out += [
            f"{name}_l{k} AS (SELECT tree, p // 8 AS q, any_value(n) AS n, list(h ORDER BY p) AS l FROM {name}_n{k} WHERE n > 1 GROUP BY ALL)",
            f"{name}_n{k + 1} AS (SELECT tree, q AS p, (n + 7) // 8 AS n, sha256(array_to_string(l, '')) AS h FROM {name}_l{k})",
            f"{name}_s{k} AS (SELECT r.*, q, array_to_string(l[1 : r.p % 8], '') AS a, array_to_string(l[r.p % 8 + 2 :], '') AS b "
            f"FROM {name}_r{k} r LEFT JOIN {name}_l{k} l ON l.tree = r.tree AND l.q = r.p // 8)",
            f"{name}_r{k + 1} AS (SELECT * EXCLUDE (q, a, b) REPLACE (coalesce(q, p) AS p, CASE WHEN q IS NULL THEN f ELSE sha256(a || f || b) END AS f, "
            f"CASE WHEN q IS NULL THEN proof ELSE proof || a || b END AS proof) FROM {name}_s{k})",
        ]
    tops = " UNION ALL ".join(f"SELECT tree, h FROM {name}_n{k} WHERE n = 1" for k in range(levels + 1))
    return ",\n".join([*out, f"{name}_top AS ({tops})", f"{name}_rows AS (SELECT * FROM {name}_r{levels})"])


def _sql(levels: int = 8) -> str:
    """The manifest of up to 8 ** levels rows of a lang."""
    leaf = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {{{c}}}, '-')" for c in FIELDS)
    plain = leaf.format(**{c: f"CAST({c} AS VARCHAR)" for c in FIELDS})
    lower = leaf.format(**{c: f"CAST({c} AS VARCHAR)" for c in FIELDS} | {"text": f"translate(text, '{_UPPER}', '{_LOWER}')"})
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH c0 AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {step})) AS t),
c1 AS (SELECT DISTINCT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))),
         lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc FROM documents, c0 WHERE doc_id IS NOT NULL),
d AS (SELECT doc_id, lang, sha256({plain}) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256({lower}) END AS now
      FROM documents LEFT JOIN c1 USING (doc_id)),
e AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS p FROM d),
{_climb("a", "SELECT tree, p, n, leaf AS h FROM e", "SELECT tree, p, tree AS own, doc_id, leaf, coalesce(now, leaf) AS f, '' AS proof FROM e", levels)},
{_climb("b", "SELECT 0 AS tree, tree AS p, (SELECT count(*) FROM a_top) AS n, h FROM a_top", "SELECT 0 AS tree, own AS p, own, doc_id, leaf, f, proof FROM a_rows", levels)}
SELECT doc_id, leaf, a_top.h AS subroot, b_top.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b_top.h AS verified
FROM b_rows, b_top, a_top WHERE a_top.tree = own"""


SQL = _sql()
