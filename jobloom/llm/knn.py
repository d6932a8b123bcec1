"""Exact top-k search by inner product with a KD-tree for each shard.

The index holds a file for each shard of up to `SHARD` vectors: the vectors in tree order, their ids, and for each node of
a balanced KD-tree (median splits of the widest side) its tight bounding box and smallest id. A query walks a tree
best-first: the box bounds the inner product of whatever lies in it, the node with the highest bound comes next, and the
walk ends when no bound reaches the kth best score, which is carried from shard to shard.

Shards and blocks of queries, of at most `QUERY_BYTES` each, are files in the shared folder, written once. A task holds
one block and reads the shards of its dimension one at a time, carrying the kth scores on; where there are fewer blocks
than the cluster has cores, a block's shards are dealt to several tasks. So the index is read once for each block, from
files, and nothing of it, nor of the queries, is shuffled: only each query's k best rows of each task are. A task that is
tried again reads the same files. The driver knows the blocks' and shards' names, a line for each.

Components are floor(256 * x); sums that a double can't hold exactly are made with Python's integers, and a score
beyond a long is cut to the range of a long before it is compared. Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows with a null vec_id; no queries give no rows; vectors of another length are no candidates of a query; a query's
own row is that with its vec_id (queries without one take no part; repeated rows of a query are each answered; repeated candidates each count); equal scores
go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.llm.common import fresh_dir, materialize, pick, read_file, table, write_file

NAME = "op10_topk"
K = 5
EVERY = 50
SHARD = 8192
LEAF = 256
QUERY_BYTES = 64 << 20
EXACT = float(2**53)


def quantized(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of the vectors that take part, and floor(256 * x) of them."""
    at, out = [], []
    for i, v in enumerate(vectors):
        v = v.values
        if v is None or not len(v) or v.null_count:
            continue
        x = np.floor(256.0 * v.to_numpy(zero_copy_only=False).astype(np.float64))
        if np.isfinite(x).all():
            at.append(i)
            out.append(x)
    return np.array(at, np.int64), out


def _long(n: int) -> int:
    return max(-(2**63), min(2**63 - 1, n))


class Tree:
    """A KD-tree over vectors (n, d): node i has the children 2i + 1 and 2i + 2; leaves are the last level."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, spans: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray):
        self.vectors, self.ids, self.spans, self.low, self.high, self.least = vectors, ids, spans, low, high, least
        self.leaves = (len(spans) + 1) // 2 - 1  # nodes from here on are leaves
        self.largest = float(np.abs(vectors).max()) if len(vectors) else 0.0

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
        order, spans = np.arange(len(ids)), [(0, len(ids))]
        level = spans
        while max(b - a for a, b in level) > leaf:
            halves = []
            for a, b in level:
                own, mid = order[a:b], (b - a) // 2
                if b - a > 1:
                    some = vectors[own]
                    side = int((some.max(axis=0) - some.min(axis=0)).argmax())
                    order[a:b] = own[np.argpartition(some[:, side], mid)]
                halves += [(a, a + mid), (a + mid, b)]
            spans = spans + halves
            level = halves
        vectors, ids = vectors[order], ids[order]
        shape = (len(spans), vectors.shape[1])
        low, high, least = np.zeros(shape), np.zeros(shape), np.zeros(len(spans), np.int64)
        for i, (a, b) in enumerate(spans):
            if a < b:
                low[i], high[i], least[i] = vectors[a:b].min(axis=0), vectors[a:b].max(axis=0), ids[a:b].min()
        return cls(vectors, ids, np.array(spans, np.int64), low, high, least)

    def search(self, queries: np.ndarray, own: np.ndarray, best: list[list[tuple]], k: int) -> None:
        """Improves best[q], each a sorted list of at most k (-score, id), by what the tree holds; own: ids to leave out."""
        exact = self.largest * float(np.abs(queries).max(initial=0.0)) * queries.shape[1] < EXACT
        if exact:
            bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        spans, least, leaves = self.spans.tolist(), self.least.tolist(), self.leaves
        for q in range(len(queries)):
            if exact:
                bound, query = bounds[q].tolist(), queries[q]
            else:
                query = np.array([int(x) for x in queries[q]], object)
                bound = [_long(sum(max(x * int(lo), x * int(hi)) for x, lo, hi in zip(query, low, high))) for low, high in zip(self.low, self.high)]
            top, heap = best[q], [(-bound[0], 0)]
            while heap:
                reach, node = heapq.heappop(heap)
                a, b = spans[node]
                if a == b or len(top) == k and (reach, least[node]) > top[-1]:
                    if a < b and reach > top[-1][0]:
                        break
                    continue
                if node < leaves:
                    for child in (2 * node + 1, 2 * node + 2):
                        heapq.heappush(heap, (-bound[child], child))
                    continue
                ids = self.ids[a:b]
                if exact:
                    scores = self.vectors[a:b] @ query
                else:
                    scores = np.array([_long(sum(x * int(y) for x, y in zip(query, v))) for v in self.vectors[a:b]], object)
                ok = ids != own[q]
                if len(top) == k:
                    ok &= (scores >= -top[-1][0]).astype(bool)
                found = np.flatnonzero(ok)
                if len(found):
                    more = [(-s, i) for s, i in zip(scores[found].tolist(), ids[found].tolist())]
                    top[:] = heapq.nsmallest(k, top + more)


_FILES = "dim int, path string"


def _saved(tree: Tree) -> bytes:
    kind = "<f8" if tree.largest >= 2**31 else "<i4"
    out = io.BytesIO()
    np.savez(out, vectors=tree.vectors.astype(kind), ids=tree.ids, spans=tree.spans, low=tree.low.astype(kind), high=tree.high.astype(kind), least=tree.least)
    return out.getvalue()


def _tree(data: bytes) -> Tree:
    own = np.load(io.BytesIO(data))
    return Tree(*(own[n].astype(np.float64) if n in ("vectors", "low", "high") else own[n] for n in ("vectors", "ids", "spans", "low", "high", "least")))


def _in_files(rows: DataFrame, folder: str, label: str, full: Callable[[int, int], bool], saved: Callable[[np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """The vectors of rows that take part, by dimension, in files of a folder: dim and path of each.

    full(count, dim): whether a file of so many vectors is to be closed. A file's name is that of its task and place, so a
    task that is tried again writes the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        number, part = count(), TaskContext.get().partitionId()

        def made(dim: int) -> pa.RecordBatch:
            own = held.pop(dim)
            path = f"{folder}/{label}-{part:06d}-{next(number):06d}.npz"
            write_file(path, saved(np.stack([v for _, v in own]), np.array([i for i, _ in own], np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([path])], ["dim", "path"])

        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            for i, v in zip(*quantized(batch.column("embedding"))):
                if ids[i] is not None:
                    own = held.setdefault(len(v), [])
                    own.append((ids[i], v))
                    if full(len(own), len(v)):
                        yield made(len(v))
        for dim in list(held):
            yield made(dim)

    return materialize(rows.mapInArrow(run, _FILES), label)


def build_index(rows: DataFrame, folder: str, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """dim and path of the shards of rows (vec_id, embedding): every vector that takes part is in one shard."""
    rows = pick(rows, ["vec_id", "embedding"])
    rows = rows.coalesce(max(1, rows.count() // shard))  # small input files don't make small shards
    return _in_files(rows, folder, "kd-index", lambda n, _: n == shard, lambda vectors, ids: _saved(Tree.build(vectors, ids, leaf)))


def _blocks(queries: DataFrame, folder: str, most: int) -> DataFrame:
    """dim and path of blocks of queries (vec_id, embedding) of one dimension each; at most `most` bytes of vectors."""

    def saved(vectors: np.ndarray, ids: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=vectors, ids=ids)
        return out.getvalue()

    queries = pick(queries, ["vec_id", "embedding"]).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    numbers = queries.agg(F.sum(F.size("embedding").cast("long")).alias("n")).first().n or 0
    return _in_files(queries.repartition(max(1, -(-8 * numbers // most))), folder, "kd-queries", lambda n, dim: 8 * (n + 1) * dim > most, saved)


def _searched(index: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(block, place, query_id, vec_id, score): the k best of each query among the shards of each task."""
    spark = index.sparkSession
    names = ["block", "place", "query_id", "vec_id", "score"]
    schema = ", ".join(f"{n} long" for n in names)
    shards: dict[int, list[str]] = {}
    for r in index.orderBy("path").toLocalIterator():
        shards.setdefault(r.dim, []).append(r.path)
    asked = [(r.dim, r.path) for r in blocks.orderBy("path").collect() if r.dim in shards]
    if not asked:
        return spark.createDataFrame([], schema)
    # A block's shards go to several tasks only while there are idle cores for them.
    wide = max(1, -(-4 * spark.sparkContext.defaultParallelism // len(asked)))
    cells = []
    for number, (dim, path) in enumerate(asked):
        groups = min(wide, len(shards[dim]))
        cells += [(number, path, shards[dim][g::groups]) for g in range(groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = np.load(io.BytesIO(read_file(row["path"])))
                own, vectors = block["ids"], block["vectors"]
                best: list[list[tuple]] = [[] for _ in own]
                for path in row["shards"]:
                    _tree(read_file(path)).search(vectors, own, best, k)
                for a in range(0, len(own), 10_000):
                    out = [(row["block"], j, own[j], i, _long(int(-s))) for j in range(a, min(a + 10_000, len(own))) for s, i in best[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5)], names)

    dealt = spark.createDataFrame(cells, "block long, path string, shards array<string>").repartition(len(cells))
    return dealt.mapInArrow(run, schema)


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, leaf: int = LEAF, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows (vec_id, embedding) for each query but its own, all if fewer."""
    folder = fresh_dir(rows.sparkSession, "kd")
    found = _searched(build_index(rows, folder, shard, leaf), _blocks(queries, folder, query_bytes), k)
    order = Window.partitionBy("block", "place").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
             vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
