"""Benchmark decontamination by Wu-Manber search for runs of words.

A pattern is a run of `width` consecutive words of a benchmark item, or the whole item where it is shorter. Patterns of
one length share a shift table over blocks of two words: a block that no pattern holds lets the search skip the whole
pattern length but one, one that patterns hold skips as far as the nearest. Where the shift is 0 the block ends some
pattern; its bucket, divided by the pattern's first word, gives the candidates, which are compared word by word. The
tables are flat arrays over the numbers of the items' words: about 30 bytes for each byte of item text, built once a worker.

The search only maps over the documents: no document is shuffled. The patterns are sent to the executors in blocks of
at most `block_bytes` of item text each; a benchmark of more than that takes one pass for each block, and the passes'
hits are joined by row, so nothing that grows is broadcast and nothing is left out.

Defined cases: a null or empty text has no words and is never contaminated; an item without words matches nothing; a
null item_id counts as the empty string; repeated rows are judged one by one; items with equal ids count once.
"""

from __future__ import annotations

import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import extended, materialize, pick, raw, sealed, table, unsealed, words

NAME = "op2_decontaminate"
WIDTH = 13
BLOCK_BYTES = 4 << 20


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each row of columns, of 64 bits."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class _Length:
    """The patterns of one length: where each different one starts in the items' words, the shift table, and the buckets."""

    def __init__(self, numbers: np.ndarray, starts: np.ndarray, owners: np.ndarray, since: np.ndarray, m: int):
        """since: how many words of its item stand before each pattern."""
        self.m, self.size = m, min(2, m)
        at = lambda k: numbers[starts + k]
        key = _hash([at(k) for k in range(m)])
        order = np.argsort(key, kind="stable")
        starts, owners, since, key = starts[order], owners[order], since[order], key[order]
        same = np.zeros(len(starts), bool)
        same[1:] = key[1:] == key[:-1]
        for k in range(m):  # equal numbers prove nothing: the words are compared
            words_k = at(k)
            same[1:] &= words_k[1:] == words_k[:-1]
        first = np.flatnonzero(~same)
        self.pattern, self.owner = array("i", starts[first].tolist()), owners
        self.owned = array("i", [*first.tolist(), len(starts)])
        starts = starts[first]
        # Blocks that share a place take the lower shift: the more places, the rarer.
        self.mask = (1 << max(8, int(16 * len(starts)).bit_length())) - 1
        self.few = (1 << max(8, int(2 * len(starts)).bit_length())) - 1
        shift = np.full(self.mask + 1, m - self.size + 1, np.uint8 if m < 255 else np.uint16)
        for end in range(self.size, m + 1):
            np.minimum.at(shift, self._slots(at(end - 2) if self.size == 2 else None, at(end - 1)), m - end)
        self.shift = array("B" if m < 255 else "H", shift.tobytes())
        slots = (self._slots(at(m - 2) if self.size == 2 else None, at(m - 1)) * FIRST + at(0)) & self.few
        order = np.argsort(slots, kind="stable")
        self.bucket = array("i", np.concatenate([[0], np.cumsum(np.bincount(slots, minlength=self.few + 1))]).astype(np.int32).tobytes())
        self.candidates = array("i", order.astype(np.int32).tobytes())

    def _slots(self, before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        return (last.astype(np.int64) + (0 if before is None else before.astype(np.int64) * BEFORE)) & self.mask


#: Multipliers of the tables' hash of a block of two words, and of a block and its pattern's first word.
BEFORE, FIRST = 0x9E3779B1, 0x85EBCA6B


class WuManber:
    """Finds every occurrence of the items' windows in a list of words."""

    def __init__(self, items: Iterable[tuple[str, bytes | None]], width: int = WIDTH):
        self.number: dict[bytes, int] = {}
        self.names: list[str] = []
        numbers, windows = array("i"), defaultdict(list)
        for item, text in items:
            w = words(text)
            if w:
                m = min(width, len(w))
                windows[m].append((len(numbers), len(w) - m + 1, len(self.names)))
                numbers.extend([self.number.setdefault(x, len(self.number)) for x in w])
                self.names.append(item)
        self.words = np.frombuffer(numbers, np.int32).tolist() if numbers else []
        own = np.array(numbers, np.int32)
        self.lengths = []
        for m, spans in sorted(windows.items()):
            counts = [n for _, n, _ in spans]
            since = np.concatenate([np.arange(n) for n in counts])
            starts = np.repeat([a for a, _, _ in spans], counts) + since
            self.lengths.append(_Length(own, starts, np.repeat([i for _, _, i in spans], counts).astype(np.int32), since, m))

    def search(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, end) of words inside an occurrence, and the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        get, own, n = self.number.get, self.words, len(w)
        for t in self.lengths:
            m, mask, few, shift, two, end = t.m, t.mask, t.few, t.shift, t.size == 2, t.m
            while end <= n:
                slot = get(w[end - 1])
                if slot is None:  # no pattern holds this word
                    end += m
                    continue
                if two:
                    before = get(w[end - 2])
                    if before is None:
                        end += m - 1
                        continue
                    slot += before * BEFORE
                slot &= mask
                step = shift[slot]
                if step:
                    end += step
                    continue
                start = end - m
                first = get(w[start])
                if first is not None:
                    at = (slot * FIRST + first) & few
                    for k in range(t.bucket[at], t.bucket[at + 1]):
                        c = t.candidates[k]
                        p = t.pattern[c]
                        if own[p] == first and own[p : p + m] == [get(x) for x in w[start:end]]:
                            found.update(t.owner[t.owned[c] : t.owned[c + 1]].tolist())
                            if spans and spans[-1][0] <= start <= spans[-1][1]:
                                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
                            else:
                                spans.append((start, end))
                            break  # equal patterns are one
                end += 1
        return merged(spans), {self.names[i] for i in found}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_HITS = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


_built: dict[str, WuManber] = {}


def _machine(key: str, sent: Broadcast, width: int) -> WuManber:
    """The tables of a block of items, built once in each worker; only the last ones are kept."""
    if key not in _built:
        _built.clear()
        _built[key] = WuManber(sent.value, width)
    return _built[key]


def _search(docs: DataFrame, keys: list[str], sent: Broadcast, width: int) -> DataFrame:
    """One pass over docs (keys and text) for the windows of one block of items, as it was sent out."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(key, sent, width)
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in raw(batch.column("text")):
                w = words(text)
                hit, found = machine.search(w)
                n_words.append(len(w))
                spans.append([{"start": a, "end": b} for a, b in hit])
                items.append(sorted(found))
            own = [batch.column(k) for k in keys]
            own += [pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(own, [*keys, "n_words", "spans", "items"])

    return docs.mapInArrow(run, extended(docs, keys, _HITS))


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The items (item_id, text), a bounded block at a time; an item over the bound is a block of its own."""
    block: list[tuple[str, bytes | None]] = []
    size = 0
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    for row in rows.toLocalIterator():
        text = bytes(row.text) if row.text is not None else None
        if block and size + len(text or b"") > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text or b"")
    yield block


def joined(spans: Column) -> Column:
    """merged() of an array of spans."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        meets = (F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), none, step)


def find_overlaps(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, keys: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """For each row of docs (text and keys): keys, n_words, spans of hit words (merged, [start, end)), items (sorted ids)."""
    send = docs.sparkSession.sparkContext.broadcast
    docs = pick(docs, list(dict.fromkeys([*keys, "text"])))
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    if total <= block_bytes:
        return _search(docs, [*keys], send(next(_blocks(items, block_bytes))), width)
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    passes = []
    for block in _blocks(items, block_bytes):
        sent = send(block)
        passes.append(materialize(_search(docs, ["row"], sent, width).filter(F.size("items") > 0), "decontaminate-hits"))
        sent.destroy()  # a block is on the executors during its own pass only
    hits = passes[0]
    for p in passes[1:]:
        hits = hits.union(p)
    hits = hits.groupBy("row").agg(
        joined(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    counted = _search(docs, ["row", *keys], send([]), width).drop("spans", "items")
    return counted.join(hits, "row", "left").select(
        *keys, "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def judge(overlaps: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: at least a twentieth of the words, and one at all, lie inside occurrences."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    return overlaps.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    found = judge(find_overlaps(sealed(docs), items, keys=("rest", "text")))
    return unsealed(found.filter(~F.col("contaminated")), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM win),
pos AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d CROSS JOIN ms WHERE len(w) >= m)),
occ AS (SELECT r, pos.m, i, item_id FROM pos JOIN win ON pos.m = win.m AND pos.s = win.s),
hit AS (SELECT r, count(DISTINCT p) AS n_hit
        FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
