"""Sum-of-squares bin packing of documents into sequences of fixed capacity.

Each piece goes where the sum, over gaps, of the squared number of open bins with that gap becomes smallest, among equal
places into the fullest bin; a bin is opened only where no open one has room. The pieces of an input partition are encoded and packed where they are, largest first, so no
text and no token is shuffled. Pieces in all bins that a partition doesn't fill are dealt evenly into groups of up to
`GROUP` pieces, so that each group has its share of every partition, and packed anew; only their numbers move. What these
groups leave with a gap of more than `SLACK` of the capacity is packed again until one group holds all that are left.
A task keeps a few integers for each piece and packs after `HELD` pieces at the latest, so its memory is bounded however
large a partition is.

Defined cases: a null text is the empty text; a document without tokens still has its end id and is packed; only
documents longer than the capacity are cut, and only their last piece is shorter; repeated rows are packed each on
its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import extended, materialize, pick, table
from jobloom.llm.tokenize import encoder, gathered, vocabulary

NAME = "op9_packing"
SQL = None
CAPACITY = 2048
END = 0
SLACK = 1 / 8
HELD = 500_000
GROUP = 200_000


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length (0 < length <= capacity), and the number of bins: sum-of-squares packing.

    n[g] open bins have gap g. A piece of length s into a bin of gap g changes the sum of squares by
    2 * (n[g - s] - n[g]) + 2; closed bins (gap 0) don't count.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    never = np.iinfo(np.int64).max
    for i in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        s = int(lengths[i])
        here = n[s:capacity]
        change = np.where(here > 0, 2 * (n[: capacity - s] - here) + 2, never)
        if len(here) and here[0]:
            change[0] = 1 - 2 * here[0]  # the bin closes: only its own gap's count falls
        g = int(change.argmin()) + s if len(here) else capacity  # of equal changes the smallest gap
        if g == capacity or change[g - s] == never:
            g, b, made = capacity, made, made + 1
        else:
            b = open_bins[g].pop()
            n[g] -= 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            open_bins[g - s].append(b)
            n[g - s] += 1
    return bins, offsets, made


_TYPES = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, used long"
_NAMES = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", "used"]


def _packed_by_partition(docs: DataFrame, path: str, end: int, capacity: int, held: int) -> DataFrame:
    """The pieces of docs (doc_id, text), packed within their input partition. used: tokens in the piece's sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        ids: list[pa.Array] = []
        rows: list[np.ndarray] = []
        count, base = 0, TaskContext.get().partitionId() << 40

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, rows, count, base
            r = np.concatenate(rows)
            bins, offsets, made = pack(r[:, 3], capacity)
            used = np.bincount(bins, weights=r[:, 3], minlength=made).astype(np.int64)[bins]
            own = pa.chunked_array(ids).combine_chunks()
            columns = [pa.array(r[:, 1].astype(np.int32)), *(pa.array(r[:, k]) for k in (2, 3, 4))]
            columns += [pa.array(base + bins), pa.array(offsets), pa.array(used)]
            at = r[:, 0]
            for k in range(0, len(r), 10_000):
                yield pa.RecordBatch.from_arrays([own.take(pa.array(at[k : k + 10_000])), *(c.slice(k, 10_000) for c in columns)], ["doc_id", *_NAMES])
            ids, rows, count, base = [], [], 0, base + made

        for batch in gathered(batches):
            row = sum(map(len, ids))
            ids.append(batch.column("doc_id"))
            for block in model.blocks(batch.column("text"), end):
                data, at = memoryview(block.values.to_numpy().astype("<u4", copy=False)).cast("B"), block.offsets.to_numpy().tolist()
                found = []
                for j, (a, b) in enumerate(zip(at, at[1:]), row):
                    for p, c in enumerate(range(a, b, capacity)):
                        d = min(b, c + capacity)
                        found.append((j, p, c - a, d - c, zlib.crc32(data[4 * c : 4 * d])))
                rows.append(np.array(found, np.int64).reshape(-1, 5))
                count += len(found)
                row += len(block)
            if count >= held:
                yield from flush()
        if count:
            yield from flush()

    return docs.mapInArrow(run, extended(docs, ["doc_id"], _TYPES))


def _packed_again(pieces: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """Pieces that are packed already, dealt into groups and packed anew within each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            rows = pa.Table.from_batches(parts)
            lengths = rows.column("length").to_numpy()
            bins, offsets, made = pack(lengths, capacity)
            used = np.bincount(bins, weights=lengths, minlength=made).astype(np.int64)[bins]
            new = -((level << 56) + (TaskContext.get().partitionId() << 32) + bins + 1)  # below 0: none is taken yet
            own = [rows.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield from pa.table([*own, pa.array(new), pa.array(offsets), pa.array(used)], ["doc_id", *_NAMES]).to_batches()

    return pieces.repartition(groups).mapInArrow(run, pieces.schema)


def pack_documents(docs: DataFrame, path: str, end: int = END, capacity: int = CAPACITY, held: int = HELD, group: int = GROUP) -> DataFrame:
    """Packs every row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    pieces = materialize(_packed_by_partition(pick(docs, ["doc_id", "text"]), path, end, capacity, held), "packed")
    done, level, before = [], 1, None
    while True:
        # A partition may hold lengths of one kind only, a group doesn't.
        loose = F.col("used") < (capacity if level == 1 else capacity - capacity * SLACK)
        rest = pieces.filter(loose)
        n = rest.count()
        if n in (0, before):
            done.append(pieces)
            break
        done.append(pieces.filter(~loose))
        groups = -(-n // group)
        pieces = materialize(_packed_again(rest, groups, capacity, level), "packed-again")
        if groups == 1:
            done.append(pieces)
            break
        level, before = level + 1, n
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.drop("used")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
