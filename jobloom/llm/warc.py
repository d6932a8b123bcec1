"""WARC archives compressed with zstandard and a dictionary: writer and reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record then is one frame. The
reader takes the dictionary from that frame, walks over the frames by their block headers, decodes one frame for each
record, and checks the version line, the headers that every record needs, both lengths and both digests; anything wrong
raises ValueError.

Of records with equal payloads (SHA-1 and length) of at least `REVISIT` bytes, the one with the largest page_id is written
as response, the others as revisits of it, without the payload; their lengths and digests are those of the full payload.
Digests are made by Spark; only page_id and digest are grouped. Digests that over 1 / `HOT` of all pages have, fewer than
`HOT`, are broadcast and their pages stay where they are; the others are joined by digest, so no key of that join has more
pages. A task writes its pages in order of all their columns, and closes an archive at `ARCHIVE` bytes; archives are
written whole under a name that follows from the task and its number there. So a task that runs again, or twice at once,
replaces them by equal ones, in whatever order the pages reach it. The dictionary comes from a bounded sample (`SAMPLE`
pages by hash, `PIECE` characters of each): it makes archives smaller and changes no result.

Defined cases: no pages make one archive without records; a null html is empty; a null url is written as an empty target URI; a null page_id counts as smaller than
any other and is written as no id; rows with equal page_id and payload, both the largest, are each written as response.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import fresh_dir, materialize, pick, table, write_file

NAME = "op8_warc"
REVISIT = 1000
HOT = 4096
SAMPLE = 500
PIECE = 8192
DICT_BYTES = 65536
ARCHIVE = 32 << 20
LEVEL = 3
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
_DATE = "1970-01-01T00:00:00Z"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def _b32(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record(page_id: int | None, url: str, body: bytes, size: int, digest: str, refers_to: int | None, refers_url: str = "") -> bytes:
    """A response record, or a revisit, without the body, where refers_to and refers_url, those of the response, are given.

    size and digest (lowercase hex SHA-1) are those of the full payload. Line ends in the url are left out.
    """
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + body if refers_to is None else http
    target = "".join(c for c in url if c not in "\r\n")
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, url)), ("WARC-Date", _DATE), ("WARC-Target-URI", target)]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    headers += [("X-Payload-Length", str(size)), ("WARC-Payload-Digest", _b32(digest))]
    headers.append(("WARC-Block-Digest", _b32(hashlib.sha1(block).hexdigest())))
    if refers_to is not None:
        target = "".join(c for c in refers_url if c not in "\r\n")
        headers += [("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, refers_url)), ("WARC-Refers-To-Target-URI", target)]
        headers += [("WARC-Refers-To-Date", _DATE), ("X-Refers-To-Page-ID", str(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


class Archive:
    """Builds one archive: the dictionary's frame, then a frame for each record."""

    def __init__(self, dictionary: bytes):
        self.data = bytearray(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        own = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True, **own)

    def add(self, data: bytes) -> None:
        self.data += self.packer.compress(data)


def frame_end(data: memoryview, at: int) -> int:
    """Where the zstandard frame that starts at `at` ends, by its header and its blocks' headers."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError(f"no zstandard frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    size = (single, 2, 4, 8)[flags >> 6]
    end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size
    while True:
        if end + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = int.from_bytes(data[end : end + 3], "little")
        kind = head >> 1 & 3
        if kind == 3:
            raise ValueError("a frame has a block of unknown kind")
        end += 3 + (1 if kind == 1 else head >> 3)
        if head & 1:
            break
    end += 4 * (flags >> 2 & 1)
    if end > len(data):
        raise ValueError("a frame is cut off")
    return end


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, decoded one frame at a time with the dictionary of the leading skippable frame."""
    view = memoryview(data)
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        raise ValueError("the archive doesn't start with a dictionary's frame")
    at = 8 + struct.unpack_from("<I", data, 4)[0]
    if at > len(data):
        raise ValueError("the dictionary is cut off")
    dictionary = data[8:at]
    if dictionary[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    own = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    unpacker = zstandard.ZstdDecompressor(**own)
    while at < len(data):
        end = frame_end(view, at)
        try:
            yield unpacker.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise ValueError(f"the frame at byte {at} can't be decoded: {e}") from e
        at = end


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, validated."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("a record has no WARC version or no end of headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name in headers:
            raise ValueError(f"a header is malformed or repeated: {line[:80]}")
        headers[name] = value.strip()
    for name in _NEEDED:
        if name not in headers:
            raise ValueError(f"a record lacks {name}")
    if not headers["Content-Length"].isdecimal() or len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    block = rest[:-4]
    if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != _b32(hashlib.sha1(block).hexdigest()):
        raise ValueError("a block doesn't match its digest")
    return headers, block


def payload(headers: dict[str, str], block: bytes) -> bytes | None:
    """The payload of a response, checked against its digest and length; None for a revisit."""
    if headers["WARC-Type"] == "revisit":
        return None
    body = block.partition(b"\r\n\r\n")[2]
    if len(body) != int(headers.get("X-Payload-Length", len(body))) or headers.get("WARC-Payload-Digest", "") not in ("", _b32(hashlib.sha1(body).hexdigest())):
        raise ValueError("a payload doesn't match its length or digest")
    return body


def _dictionary(pages: DataFrame) -> bytes:
    # The ids alone are ranked, so that tasks send the driver few bytes; then the pages at or below the last are fetched.
    order = F.xxhash64("page_id")
    last = pages.select(order.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h").alias("h")).first().h
    rows = pages.filter(order <= last).select(F.substring("html", 1, PIECE).alias("html")).limit(SAMPLE).collect() if last is not None else []
    texts = sorted(r.html.encode() for r in rows if r.html)
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICT_BYTES:]


def referred(pages: DataFrame, revisit: int = REVISIT, hot: int = HOT) -> DataFrame:
    """pages (page_id, url, html; no nulls but in page_id) with digest, size and, of revisits, refers_to and refers_url in place of the html."""
    known = pages.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    small, known = known.filter(F.col("size") < revisit), known.filter(F.col("size") >= revisit)
    # Of equal page_ids with equal payloads each is a response; a revisit names that with the greatest url.
    last = known.groupBy("digest", "size").agg(F.max(F.struct("page_id", F.col("url").alias("last_url"))).alias("last"), F.count("*").alias("n")).filter("n > 1")
    last = materialize(last.select("digest", "size", "last.*", "n").withColumnRenamed("page_id", "last"), "copies")
    often = F.col("n") * hot > pages.count()
    own = ["digest", "size", "last", "last_url"]
    few = F.broadcast(last.filter(often).select(*own))
    rest = known.join(few, ["digest", "size"], "left_anti").join(last.filter(~often).select(*own), ["digest", "size"], "left")
    rows = known.join(few, ["digest", "size"]).unionByName(rest).unionByName(small, allowMissingColumns=True)
    other = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    refers = [F.when(other, F.col(c)).alias(n) for c, n in (("last", "refers_to"), ("last_url", "refers_url"))]
    return rows.select("page_id", "url", F.when(~other, F.col("html")).alias("html"), "digest", "size", *refers)


def write_archives(pages: DataFrame, where: str, archive: int = ARCHIVE, revisit: int = REVISIT, hot: int = HOT) -> None:
    """Writes pages (page_id, url, html) into the folder where, as archives of about `archive` bytes at most."""
    pages = pick(pages, ["page_id", "url", "html"])
    pages = pages.withColumns({"url": F.coalesce("url", F.lit("")), "html": F.coalesce("html", F.lit(""))})
    dictionary = _dictionary(pages)
    rows = referred(pages, revisit, hot).sortWithinPartitions("digest", "page_id", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, own = TaskContext.get().partitionId(), 0, None
        done: tuple[list, list] = ([], [])

        def close() -> None:
            nonlocal number, own
            name = f"part-{part:06d}-{number:06d}.warc.zst"
            write_file(f"{where}/{name}", bytes(own.data))
            done[0].append(name)
            done[1].append(len(own.data))
            number, own = number + 1, None

        for batch in batches:
            for r in range(batch.num_rows):
                page_id, url, html, digest, size, refers_to, refers_url = (batch.column(k)[r].as_py() for k in range(7))
                own = own or Archive(dictionary)
                own.add(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), size, digest, refers_to, refers_url or ""))
                if len(own.data) >= archive:
                    close()
        if own:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.int64())], ["name", "bytes"])

    if rows.mapInArrow(run, "name string, bytes long").agg(F.count("*").alias("n")).first().n == 0:
        write_file(f"{where}/empty.warc.zst", bytes(Archive(dictionary).data))


def read_archives(spark: SparkSession, where: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives (*.warc.zst) in the folder where, each validated.

    record_type, target_uri, page_id, payload_bytes, payload_digest (lowercase hex), refers_to, and payload (response
    only) if payloads.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(where).select("content")
    names = ["record_type", "target_uri", "page_id", "payload_bytes", "payload_digest", "refers_to", *["payload"] * payloads]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                rows: list[tuple] = []
                held = 0
                for data in records(batch.column("content")[r].as_py()):
                    headers, block = parsed(data)
                    body = payload(headers, block)
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    number = lambda name: int(headers[name]) if name in headers else None  # noqa: B023, E731
                    row = (headers["WARC-Type"], headers.get("WARC-Target-URI"), number("X-Page-ID"), number("X-Payload-Length"), digest, number("X-Refers-To-Page-ID"))
                    rows.append(row + ((body,) if payloads else ()))
                    held += len(data)
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    more = ", payload binary" if payloads else ""
    return files.mapInArrow(run, f"record_type string, target_uri string, page_id long, payload_bytes long, payload_digest string, refers_to long{more}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = fresh_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), where)
    return read_archives(spark, where, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n,
                  sha1(coalesce(html, '')) AS d FROM pages),
l AS (SELECT d, n, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN l ON p.d = l.d AND p.n = l.n
"""
