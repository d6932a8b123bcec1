"""What the operators share: tables, the shared folder, words, and files that tasks write."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.session import prepare
from jobloom.sources.shared import delete_folder, discard, fresh_dir, materialize  # noqa: F401

#: Bytes that are no part of a word of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, made blank, and A-Z in lower case.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: A-Z in lower case, all else as it is.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes | None) -> list[bytes]:
    """Words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` in UTF-8, A-Z in lower case. Null has none."""
    return text.translate(WORD_TABLE).split() if text else []


def pick(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the columns that an operator reads: clashing extra columns can't reach its output."""
    prepare(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names])


def sealed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all columns but text in a struct, rest: whatever their names, none clashes with an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))


def unsealed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the DataFrame that was sealed, in their order."""
    return df.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in columns])


def extended(df: DataFrame, names: list[str], more: str) -> T.StructType:
    """The schema of some columns of df, then more."""
    return T.StructType([*(df.schema[n] for n in names), *T.StructType.fromDDL(more).fields])


def raw(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of an Arrow string column one by one, a few at a time, so that few Python copies exist at once."""
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for i in range(0, len(column), 256):
        yield from column[i : i + 256].to_pylist()


def write_file(uri: str, data: bytes) -> None:
    """Writes one file whole or not at all, by any file system that pyarrow knows (file, hdfs, s3, gs).

    The name is the same when a task is tried again, so a retry or a speculative copy replaces equal bytes.
    """
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        path = unquote(at.path) if at.scheme else uri
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{os.path.dirname(path)}/_{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{os.path.dirname(path)}/_{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as f:
        f.write(data)
    files.move(part, path)




def read_file(uri: str) -> bytes:
    """A file that write_file wrote."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        with open(unquote(at.path) if at.scheme else uri, "rb") as f:
            return f.read()
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_stream(path) as f:
        return f.read()
