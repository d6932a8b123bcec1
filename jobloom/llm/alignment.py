"""Alignment of two tokenizers over a corpus by segment deduplication: which ids of one stand for which ids of the other.

A text, with a blank before it, is cut before each run of white space that begins with a blank and follows another
character. Neither vocabulary can merge across such a place: no token of either holds a blank behind a character that
isn't white space (checked when the vocabularies are read), and the first model's rule for words never joins them. So a
text's tokens are those of its segments one after the other, and both tokenizers have a border at each cut. Every
different segment of the corpus is encoded and aligned once, wherever it occurs.

Texts lie in blocks of about `BLOCK` bytes. Each block numbers its different segments, and a text becomes the list of its
segments' numbers. The segments are sorted, each is encoded for all blocks that have it, and the results go back to the
blocks, where documents are composed from them. A block counts for how many of its documents each pair of ids is linked;
the sums over the corpus go back to the blocks in the same way. What moves are a block's different segments and pairs, and
texts as numbers. A frequent segment has a row for each block, no more, and is streamed.

Groups: offsets in bytes where tokens of both end cut the tokens into groups. Links: all pairs of an occurrence of each
within a group.

Defined cases: null and empty texts have no tokens; nor has a text whose tokens' bytes don't give the text again, such as
one with U+2581, which the second model reads as a blank, or with bytes that are no UTF-8; strings of special tokens are
ordinary text; repeated rows are documents each; extra columns are not read. A text of any length is one row of one block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import discard, extended, materialize, pick, table
from jobloom.llm.tokenize import BYTE_LEVEL, vocabulary

NAME = "op13_alignment"
SQL = None
BLOCK = 32 << 20
#: Segments that are encoded at once.
SEGMENTS = 20_000
_MARK = "▁"
#: White space of any of the two; Python's \s holds all of it.
_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CUT = re.compile(r"(?<=\S)(?= )")
#: Texts in which a blank follows white space, or comes first.
_ODD = rf"^ |[{_SPACE}] "


class Pair:
    """Two tokenizers: a, byte-level, of a tokenizers file; b, with byte fallback, of a sentencepiece model."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        with open(a, encoding="utf-8") as f:
            own = json.load(f)
        step = own["pre_tokenizer"]
        if own["normalizer"] is not None or step["type"] != "ByteLevel" or step["add_prefix_space"] or not step["use_regex"]:
            raise ValueError(f"{a} isn't byte-level with the usual rule for words")
        byte = {chr(shown): b for b, shown in BYTE_LEVEL.items()}
        self.bytes_a = {i: bytes(byte[c] for c in token) for token, i in own["model"]["vocab"].items()}
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()) if not self.b.is_control(i) and not self.b.is_unknown(i)]
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in pieces}
        for name, tokens in ((a, self.bytes_a), (b, self.bytes_b)):
            for token in tokens.values():
                if _CUT.search(token.decode("utf-8", "replace")):
                    raise ValueError(f"a token of {name} reaches over a blank: {token!r}")
        self.blank = self.b.piece_to_id(_MARK)
        if self.bytes_b.get(self.blank) != b" " or self.b.encode("x y") != self.b.encode("x") + self.b.encode("y"):
            raise ValueError(f"{b} doesn't put a blank before a text")

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of blank + segment by either. The second model adds the blank; to an empty text it adds nothing."""
        first = self.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)
        return [e.ids for e in first], [ids if s else [self.blank] for s, ids in zip(segments, self.b.encode(segments, num_threads=1))]

    def groups(self, segment: str, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """The groups of a segment's ids; None if the tokens of one don't give the segment."""
        whole = b" " + segment.encode()
        try:
            parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        except KeyError:  # an id that stands for no bytes
            return None
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            return None
        out, i, j, end_a, end_b, from_a, from_b = [], 0, 0, 0, 0, 0, 0
        while i < len(a):
            end_a += len(parts_a[i])
            i += 1
            while end_b < end_a:
                end_b += len(parts_b[j])
                j += 1
            if end_a == end_b:
                out.append((a[from_a:i], b[from_b:j]))
                from_a, from_b = i, j
        return out


@lru_cache(maxsize=1)
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


def segments(texts: pa.Array) -> pa.ListArray:
    """The segments of each text (string, no null) in order, each without the blank it begins with."""
    odd = pc.match_substring_regex(texts, _ODD)
    by_blank = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    by_rule = pa.array([[s[1:] for s in _CUT.split(" " + t)] for t in texts.filter(odd).to_pylist()], by_blank.type)
    odd = odd.to_numpy(zero_copy_only=False)
    order = np.empty(len(texts), np.int64)
    order[~odd], order[odd] = np.arange(len(by_blank)), len(by_blank) + np.arange(len(by_rule))
    return pa.concat_arrays([by_blank, by_rule]).take(pa.array(order))


def _readable(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts as strings, empty where null or no UTF-8, and which of them have tokens if their segments have."""
    raw = texts.cast(pa.large_binary())
    try:
        read = raw.cast(pa.large_string())
    except pa.ArrowInvalid:

        def decoded(t):
            try:
                return t.decode() if t is not None else None
            except UnicodeDecodeError:
                return None

        read = pa.array(map(decoded, raw.to_pylist()), pa.large_string())
    read = pc.fill_null(read, "")
    return read, pc.greater(pc.binary_length(read), 0).to_numpy(zero_copy_only=False)


def planes(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 32 as their lowest bytes, then the next ones, and so on: small where most are small."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """block, doc_id and body, the numbers of its segments (null: no tokens), of each document, and number and segment of each
    different segment of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        ids, lists, full, held = [], [], [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            coded = pa.concat_arrays([x.values for x in lists]).dictionary_encode()
            # Frequent segments get small numbers.
            counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            own = rank[coded.indices.to_numpy()]
            at = np.concatenate([[0], *(np.diff(x.offsets.to_numpy()) for x in lists)]).cumsum()
            bodies = [planes(own[a:b]) if ok else None for a, b, ok in zip(at, at[1:], np.concatenate(full))]
            block, all_ids, segments_ = base + made, pa.concat_arrays(ids), coded.dictionary.take(pa.array(order)).cast(pa.string())
            for k in range(0, len(bodies), 1000):
                part = pa.array(bodies[k : k + 1000], pa.binary())
                n = len(part)
                yield pa.RecordBatch.from_arrays([all_ids[k : k + n], pa.array(np.full(n, block)), part, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names)
            for k in range(0, len(segments_), 50_000):
                part = segments_[k : k + 50_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, all_ids.type), pa.array(np.full(n, block)), pa.nulls(n, pa.binary()), pa.array(np.arange(k, k + n, dtype=np.int32)), part], names)

        names = ["doc_id", "block", "body", "number", "segment"]
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                read, ok = _readable(part.column("text"))
                ids.append(part.column("doc_id"))
                lists.append(segments(pc.if_else(pa.array(ok), read, "")))
                full.append(ok)
                held += part.nbytes
                if held >= size:
                    yield from closed()
                    made, held = made + 1, 0
                    ids, lists, full = [], [], []
        if ids:
            yield from closed()

    return docs.mapInArrow(run, extended(docs, ["doc_id"], "block long, body binary, number int, segment string"))


_ALIGNED = "block long, number int, segment string, first boolean, groups string"


def _aligned(found: DataFrame, a: str, b: str) -> DataFrame:
    """found (segment, block, number), sorted by segment, with each segment's alignment: encoded once, wherever it occurs.

    groups: the segment's groups as text; null where its tokens don't give the segment. Only the first row has the segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(a, b)
        ended, last = None, None  # the segment that the last batch ended with, and its groups
        for whole in batches:
            for k in range(0, whole.num_rows, SEGMENTS):
                batch = whole.slice(k, SEGMENTS)
                coded = batch.column("segment").dictionary_encode()
                new, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                known = int(new[0] == ended)
                ids_a, ids_b = own.encode(new[known:])
                done = [last] * known + [_written(own.groups(*x)) for x in zip(new[known:], ids_a, ids_b)]
                first = np.diff(at, prepend=-1) > 0
                first[0] &= not known
                ended, last = new[-1], done[-1]
                named = pc.if_else(pa.array(first), batch.column("segment"), pa.scalar(None, pa.string()))
                columns = [batch.column("block"), batch.column("number"), named, pa.array(first), pa.array(done, pa.string()).take(coded.indices)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "number", "segment", "first", "groups"])

    return found.mapInArrow(run, _ALIGNED)


def _written(groups: list[tuple[list[int], list[int]]] | None) -> str | None:
    return None if groups is None else ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)


def linked(groups: str) -> tuple[int, int, int, list[int], list[int]]:
    """Of groups as text: ids of either and groups, and id_a << 32 | id_b of each pair that is linked, and how often."""
    n_a = n_b = 0
    own = groups.split(";")
    links: dict[int, int] = {}
    for group in own:
        left, _, right = group.partition("|")
        if "," not in group:
            key = int(left) << 32 | int(right)
            links[key] = links.get(key, 0) + 1
            n_a, n_b = n_a + 1, n_b + 1
            continue
        ids, others = left.split(","), list(map(int, right.split(",")))
        n_a, n_b = n_a + len(ids), n_b + len(others)
        for i in ids:
            i = int(i) << 32
            for j in others:
                links[i | j] = links.get(i | j, 0) + 1
    return n_a, n_b, len(own), list(links), list(links.values())


#: What a document is composed to. pairs and times: the steps between the block's numbers of its linked pairs, and how often they are.
_COMPOSED = "block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
#: A pair of a block: the ids, and how many of its documents have it linked.
_PAIRS = "is_pair boolean, id_a long, id_b long, number int, documents long"


def _composed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents of blocks (block, doc_id, text) from the alignments of their segments, and the blocks' pairs."""
    schema = extended(docs, ["doc_id"], f"{_COMPOSED}, {_PAIRS}")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = pc.sort_indices(right, [("number", "ascending")])
        strings = _chunk(right, "groups").take(order).to_pylist()
        del right, order
        invalid = np.array([t is None for t in strings], bool)
        of, all_times, sums_of, sizes = (array("q") for _ in range(4))  # plain numbers: a block has some 100,000 segments
        for t in strings:
            n_a, n_b, n_groups, own, times = (0, 0, 0, (), ()) if t is None else linked(t)
            of.extend(own)
            all_times.extend(times)
            sums_of.extend((n_a, n_b, n_groups))
            sizes.append(len(own))
        sizes, each_times = np.frombuffer(sizes, np.int64), np.frombuffer(all_times, np.int64)
        sums_of = np.frombuffer(sums_of, np.int64).reshape(-1, 3)
        pairs, places = np.unique(np.frombuffer(of, np.int64), return_inverse=True)
        places = places.astype(np.int32)
        starts = np.cumsum(sizes) - sizes
        held = np.zeros(len(pairs), np.int64)
        made, none = [], (0, 0, 0, 0, "", b"", b"")
        for body in left.column("body"):
            body = body.as_py()
            own = numbers(body) if body is not None else None
            if own is None or invalid[own].any():
                made.append(none)
                continue
            each, times = np.unique(own, return_counts=True)
            n = sizes[each]
            rows = np.repeat(starts[each] - np.cumsum(n) + n, n) + np.arange(n.sum())
            has, inverse = np.unique(places[rows], return_inverse=True)
            links = np.bincount(inverse, weights=each_times[rows] * np.repeat(times, n)).astype(np.int64)
            held[has] += 1
            sums = (sums_of[each] * times[:, None]).sum(axis=0).tolist()
            digest = hashlib.sha256()
            for i in range(0, len(own), 65536):
                digest.update((";" * (i > 0) + ";".join(map(strings.__getitem__, own[i : i + 65536].tolist()))).encode())
            made.append((*sums, int(links.sum()), digest.hexdigest(), planes(np.diff(has, prepend=0)), planes(links)))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
        names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        own = {n: pa.array(c, t) for n, c, t in zip(names, zip(*made), kinds)}
        rows = pa.table({"doc_id": left.column("doc_id"), "block": left.column("block"), "is_pair": np.zeros(len(left), bool), **own})
        used = np.flatnonzero(held)
        more = {"block": np.full(len(used), left.column("block")[0].as_py()), "is_pair": np.ones(len(used), bool), "id_a": pairs[used] >> 32}
        more |= {"id_b": pairs[used] & 0xFFFFFFFF, "number": used.astype(np.int32), "documents": held[used]}
        return pa.concat_tables([rows, pa.table(more)], promote_options="default").select(schema.names)

    return docs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema)


def _chunk(rows: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    column = rows.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _counted(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents (_COMPOSED) with n_best and count_sum, from the counts of their block's pairs (block, number, documents, best)."""
    schema = extended(docs, ["doc_id", "n_a", "n_b", "n_groups", "n_links"], "n_best long, count_sum long, groups_sha256 string")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        number = right.column("number").to_numpy()
        size = int(number.max()) + 1 if len(number) else 0
        documents, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        documents[number], best[number] = right.column("documents").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        found = []
        for has, times in zip(left.column("pairs"), left.column("times")):
            has, times = numbers(has.as_py()).cumsum(), numbers(times.as_py())
            found.append((int(times @ best[has]), int(times @ documents[has])))
        sums = np.array(found, np.int64).reshape(-1, 2)
        own = [left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*own, pa.array(sums[:, 0]), pa.array(sums[:, 1]), left.column("groups_sha256")], [f.name for f in schema.fields])

    return docs.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, schema)


class Alignment:
    """documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. pairs: id_a, id_b, documents (that hold
    the pair linked) and best, whether no other id_b of the id_a has more. segments: each different one, and its groups."""

    def __init__(self, documents: DataFrame, pairs: DataFrame, segments: DataFrame):
        self.documents, self.pairs, self.segments = documents, pairs, segments


@contextmanager
def files_of_shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within it a job's shuffle files are deleted when the job ends: each of them is read by one job only."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def align(docs: DataFrame, a: str, b: str, block: int = BLOCK) -> Alignment:
    """Aligns the tokens of docs (doc_id, text) by the vocabulary files a (tokenizers) and b (sentencepiece)."""
    spark = docs.sparkSession
    with files_of_shuffles_end(spark):
        rows = materialize(_blocks(pick(docs, ["doc_id", "text"]), block), "align-blocks", "zstd")
        found = rows.filter("segment IS NOT NULL").select("block", "number", "segment")
        found = found.repartition("segment").sortWithinPartitions("segment", "block")
        found = materialize(_aligned(found, a, b), "align-segments", "zstd")
        made = _composed(rows.filter("segment IS NULL").select("block", "doc_id", "body"), found.select("block", "number", "groups"))
        made = materialize(made, "align-documents", "zstd")
        discard(rows)
        own = made.filter("is_pair").select("block", "id_a", "id_b", "number", "documents")
        counts = own.groupBy("id_a", "id_b").agg(F.sum("documents").alias("documents"))
        most = counts.groupBy("id_a").agg(F.max("documents").alias("most"))
        counts = counts.join(most, "id_a").select("id_a", "id_b", "documents", (F.col("documents") == F.col("most")).alias("best"))
        counts = materialize(counts, "align-pairs")
        back = own.drop("documents").join(counts, ["id_a", "id_b"]).select("block", "number", "documents", "best")
        back = materialize(back, "align-counts", "zstd")
        documents = made.filter("NOT is_pair").select("doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
        documents = materialize(_counted(documents, back), "align-result", "zstd")
        discard(made, back)
    return Alignment(documents, counts, found.filter("first").select("segment", "groups"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).documents
