"""Token-ID files: documents encoded, ordered by doc_id, and written as blocks of a static range ANS (see rans).

Documents are dealt by ranges of (doc_id, hash of the text), so that many rows of one id are spread too, and encoded in
order into chunks of whole documents (about `CHUNK` ids, kept compressed in the shared folder); the counts of all ids make
the one frequency table; then each chunk becomes a block of a file; the files are read again. The driver keeps the table (a count for each id of the vocabulary) and the number of ids of each
range, no more. Files are written whole under a name that follows from the first chunk, so a task that runs again
replaces them by equal ones.

Folder: `frequencies.rnt` (unsigned 64-bit counts) and files `part-<range>-<chunk>.rns`. A file: magic "RNSF"; sections;
offsets of the sections (unsigned 64-bit), their number, CRC-32 of the offsets, magic "RNSE". A section: 64-bit place of
its first id among all ids, number of documents, CRC-32 of the rest; doc_ids (signed 64-bit), a byte for each (0: null),
lengths (unsigned 32-bit), the block. All little-endian.

Defined cases: a null text is empty; an empty document is its end id; a null doc_id comes first; rows of equal doc_id
follow the hash of their text; an empty table makes a table file and no others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import rans
from jobloom.llm.common import discard, fresh_dir, materialize, pick, table, write_file
from jobloom.llm.tokenize import encoder, gathered, vocabulary

NAME = "op6_token_files"
SQL = None
END = 2
CHUNK = 1 << 20
FILE_CHUNKS = 16
_SECTION = struct.Struct("<QII")
_FOOT = struct.Struct("<II4s")


def tokenized(docs: DataFrame, path: str, end: int = END, chunk: int = CHUNK) -> DataFrame:
    """Chunks of docs (doc_id, text) in ascending order of (part, chunk): n ids from place `start` of the part on.

    The last row of a part has no ids, but the counts of all ids of the part.
    """
    rows = pick(docs, ["doc_id", "text"]).withColumn("h", F.xxhash64("text"))
    spread = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    names = ["part", "chunk", "start", "n", "doc_ids", "present", "lengths", "ids", "counts"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        kinds = model.model.get_vocab_size()
        small, packer, total = kinds <= 1 << 16, zstandard.ZstdCompressor(level=1), np.zeros(kinds, np.int64)
        part, number, start, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def made() -> pa.RecordBatch:
            nonlocal number, start, size, total
            ids, lengths = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            own = pa.concat_arrays([h[2] for h in held])
            total += np.bincount(ids, minlength=kinds)
            data = packer.compress(ids.astype("<u2" if small else "<u4"))
            known = pc.is_valid(own).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
            columns = [part, number, start, len(ids), pc.fill_null(own, 0).to_numpy().astype("<i8").tobytes(), known]
            columns += [lengths.astype("<u4").tobytes(), data, None]
            number, start, size = number + 1, start + len(ids), 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(columns, types)], names)

        for batch in gathered(batches):
            own, first = batch.column("doc_id").cast(pa.int64()), 0
            for found in model.blocks(batch.column("text"), end):
                ids, at = found.values.to_numpy(), found.offsets.to_numpy()
                done = 0  # texts of the block that are held or given away
                while done < len(found):
                    # a chunk ends with the text that fills it
                    to = min(len(found), int(np.searchsorted(at, at[done] + chunk - size, side="left")))
                    to = max(done + 1, to)
                    held.append((ids[at[done] : at[to]], np.diff(at[done : to + 1]), own[first + done : first + to]))
                    size += int(at[to] - at[done])
                    done = to
                    if size >= chunk:
                        yield made()
                first += len(found)
        if held:
            yield made()
        if number:
            columns = [part, number, start, 0, None, None, None, None, packer.compress(total.astype("<i8").tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(columns, types)], names)

    return spread.mapInArrow(run, "part int, chunk int, start long, n long, doc_ids binary, present binary, lengths binary, ids binary, counts binary")


def _ids(data: bytes, n: int) -> np.ndarray:
    out = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(out, "<u2" if len(out) == 2 * n else "<u4")


def counts(chunks: DataFrame, size: int) -> np.ndarray:
    """How often each id below size occurs in all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column("counts"):
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_py()), "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["id", "n"])

    out = np.zeros(size, np.int64)
    found = chunks.select("counts").filter("counts IS NOT NULL").mapInArrow(run, "id int, n long")
    for row in found.groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


def _section(start: int, doc_ids: bytes, present: bytes, lengths: bytes, block: bytes) -> bytes:
    rest = doc_ids + present + lengths + block
    return _SECTION.pack(start, len(present), zlib.crc32(rest)) + rest


def _file(sections: list[bytes]) -> bytes:
    offsets = np.cumsum([4, *map(len, sections)])[:-1].astype("<u8").tobytes()
    return b"".join([b"RNSF", *sections, offsets, _FOOT.pack(len(sections), zlib.crc32(offsets), b"RNSE")])


def write_token_files(docs: DataFrame, where: str, path: str, end: int = END, chunk: int = CHUNK) -> None:
    """Encodes docs (doc_id, text) and writes the files into the folder where."""
    spark = docs.sparkSession
    size = encoder(path).model.get_vocab_size()
    chunks = materialize(tokenized(docs, path, end, chunk), "tokens", compression="none")  # ids are compressed already
    counted = counts(chunks, size)
    write_file(f"{where}/frequencies.rnt", counted.astype("<u8").tobytes())
    place, base = 0, {}
    for row in sorted(chunks.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        base[row.part], place = place, place + row.n
    sent = spark.sparkContext.broadcast((counted, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, starts = sent.value
        own = rans.Table(freq)
        name, after, sections = None, None, []
        done: tuple[list, list] = ([], [])

        def close() -> None:
            nonlocal name
            if sections:
                data = _file(sections)
                write_file(f"{where}/{name}", data)
                done[0].append(name)
                done[1].append(len(data))
                sections.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                row = {k: batch.column(k)[r].as_py() for k in batch.schema.names if k != "counts"}
                if (row["part"], row["chunk"]) != after or len(sections) == FILE_CHUNKS:
                    close()
                    name = f"part-{row['part']:06d}-{row['chunk']:06d}.rns"
                block = rans.encode(_ids(row["ids"], row["n"]).astype(np.uint32), own)
                sections.append(_section(starts[row["part"]] + row["start"], row["doc_ids"], row["present"], row["lengths"], block))
                after = (row["part"], row["chunk"] + 1)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.int64())], ["name", "bytes"])

    chunks.filter("n > 0").mapInArrow(run, "name string, bytes long").agg(F.sum("bytes")).collect()
    discard(chunks)


def read_sections(data: bytes, freq: rans.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The sections of a file: place of the first id, doc_ids, which are not null, lengths, ids. ValueError if damaged."""
    if len(data) < 4 + _FOOT.size or data[:4] != b"RNSF":
        raise ValueError("not a token file, or cut off")
    n, check, magic = _FOOT.unpack_from(data, len(data) - _FOOT.size)
    index = data[len(data) - _FOOT.size - 8 * n : len(data) - _FOOT.size]
    if magic != b"RNSE" or len(index) != 8 * n or zlib.crc32(index) != check:
        raise ValueError("the index of a token file is damaged")
    ends = [*np.frombuffer(index, "<u8").tolist(), len(data) - _FOOT.size - 8 * n]
    for a, b in zip(ends, ends[1:]):
        start, k, crc = _SECTION.unpack_from(data, a)
        rest = data[a + _SECTION.size : b]
        if zlib.crc32(rest) != crc:
            raise ValueError("a section of a token file is damaged")
        own, ok = np.frombuffer(rest, "<i8", k), np.frombuffer(rest, np.uint8, k, 8 * k)
        lengths = np.frombuffer(rest[9 * k : 13 * k], "<u4")
        ids = rans.decode(rest[13 * k :], freq)
        if lengths.sum() != len(ids):
            raise ValueError("lengths don't add up to the ids of a section")
        yield start, own, ok, lengths, ids


def read_token_files(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (unsigned 32-bit, binary) from the files."""
    return _read(spark, where, True)


def _read(spark: SparkSession, where: str, whole: bool) -> DataFrame:
    found = spark.read.format("binaryFile").load(f"{where}/frequencies.rnt").select("content").first()
    sent = spark.sparkContext.broadcast(np.frombuffer(bytes(found.content), "<u8"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rns").load(where).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = rans.Table(sent.value)
        for batch in batches:
            for r in range(batch.num_rows):
                for start, own, ok, lengths, ids in read_sections(batch.column("content")[r].as_py(), freq):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    data = memoryview(ids.astype("<u4", copy=False).tobytes())
                    parts = [data[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                    last = pa.array([bytes(p) for p in parts], pa.binary()) if whole else pa.array([zlib.crc32(p) for p in parts], pa.int64())
                    columns = [pa.array(own, mask=ok == 0), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), last]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids" if whole else "ids_crc32"])

    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids binary' if whole else 'ids_crc32 long'}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = fresh_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), where, vocabulary("byte_bpe_50k.json"))
    return _read(spark, where, False)
