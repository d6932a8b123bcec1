"""The store's tables as a Spark data source, so that SQL names them, and the library's text rules as SQL functions.

    register(spark)
    spark.read.format("jobloom").option("path", root).option("table", "listings").load()

The source reads one commit: the newest when the plan is made, or the one given as `commit`. Comparisons of status and
expires_at are held against the manifest, so folders that can't have a row that fits are no partitions of the scan; Spark
applies all filters to what is read. Each folder is a partition, read in Arrow batches by pyarrow's file systems.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.functions import detect, text, times
from jobloom.schemas import TABLES
from jobloom.session import prepare

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
_COMMIT = re.compile(r"c-(\d{12})\.json")


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def _json(uri: str) -> dict[str, Any]:
    files, path = _files(uri)
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


def _entries(root: str, table: str, commit: int | None) -> list[dict[str, Any]]:
    """What the manifest of a commit, else of the newest one that is whole, lists of a table."""
    files, path = _files(f"{root}/_commits")
    found = (_COMMIT.fullmatch(os.path.basename(i.path)) for i in files.get_file_info(fs.FileSelector(path, allow_not_found=True)))
    numbers = sorted((int(m[1]) for m in found if m), reverse=True)
    for n in numbers if commit is None else [commit]:
        try:
            version = _json(f"{root}/_commits/c-{n:012d}.json")["tables"].get(table)
        except ValueError:
            if commit is not None:
                raise
            continue
        return _json(f"{root}/{table}/_manifests/{version}.json")["entries"] if version else []
    return []


def may_fit(entry: dict[str, Any], wanted: D.Filter) -> bool:
    """Whether a folder may hold rows for a filter, by its status and its bounds of expires_at; others say nothing."""
    name = wanted.attribute[0] if hasattr(wanted, "attribute") and len(wanted.attribute) == 1 else None
    if name == "status":
        if isinstance(wanted, D.EqualTo | D.EqualNullSafe):
            return entry["status"] == wanted.value
        if isinstance(wanted, D.In):
            return entry["status"] in wanted.value
        if isinstance(wanted, D.IsNotNull):
            return entry["status"] is not None
    if name == "expires_at" and entry["low"] is not None:
        low, high = entry["low"], entry["high"]
        if isinstance(wanted, D.GreaterThan):
            return high > wanted.value
        if isinstance(wanted, D.GreaterThanOrEqual):
            return high >= wanted.value
        if isinstance(wanted, D.LessThan):
            return low < wanted.value
        if isinstance(wanted, D.LessThanOrEqual):
            return low <= wanted.value
        if isinstance(wanted, D.EqualTo):
            return low <= wanted.value <= high
    return True


class TableSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "jobloom"

    def schema(self) -> T.StructType:
        return TABLES[self.options["table"]]

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return TableReader(self.options, schema)


class TableReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.root, self.table, self.columns = options["path"].rstrip("/"), options["table"], [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.commit = int(options["commit"]) if "commit" in options else None
        self.wanted: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        self.wanted = list(filters)
        return filters  # what is pushed only spares folders

    def partitions(self) -> list[D.InputPartition]:
        entries = _entries(self.root, self.table, self.commit)
        fit = [e for e in entries if all(may_fit(e, w) for w in self.wanted)]
        buckets: dict[tuple[str, str], list[int]] = {}
        for e in fit:
            buckets.setdefault((e["path"], e["status"]), []).extend([e["bucket"]] * ("held" in e))
        return [D.InputPartition((*key, own)) for key, own in buckets.items()] or [D.InputPartition(None)]

    def read(self, partition: D.InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        folder, status, buckets = partition.value  # buckets: those to be read of a folder that several share
        files, path = _files(f"{self.root}/{self.table}/{folder}")
        for info in files.get_file_info(fs.FileSelector(path)):
            if not info.path.endswith(".parquet"):
                continue
            with files.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=8192):
                    if buckets:
                        batch = batch.filter(pc.is_in(batch.column("_bucket"), pa.array(buckets, pa.int32())))
                    own = {n: batch.column(n).cast(_ARROW[kind]) if n in batch.schema.names else pa.array([status if n == "status" else None] * batch.num_rows, _ARROW[kind]) for n, kind in self.columns}
                    yield pa.RecordBatch.from_arrays(list(own.values()), list(own))


#: SQL functions: name -> (types of the arguments, the rule). Rules whose expressions bind variables stay Python's.
FUNCTIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "slugify": ("string", text.slugify), "id_suffix": ("string", text.id_suffix), "role_slug": ("string, string", text.role_slug),
    "job_path": ("string, string, string", text.job_path), "company_path": ("string", text.company_path), "normalized_batch": ("string", text.normalized_batch),
    "format_comp": ("bigint, bigint, string", text.format_comp), "format_location": ("string, string, int, string", text.format_location),
    "decode_entities": ("string", text.decode_entities), "escape_html": ("string", text.escape_html), "decode_attribute": ("string", text.decode_attribute),
    "squeeze": ("string", text.squeeze), "js_trim": ("string", text.js_trim), "optional_amount": ("string", text.optional_amount),
    "has_careers_token": ("string", detect.has_careers_token), "repair_unit": ("bigint", times.repair_unit),
}


def sql_text(spark: SparkSession, rule: Callable[..., Column], types: str) -> tuple[str, str]:
    """A rule as SQL over the arguments a0, a1 and so on, and its type: what the analyzer makes of it, written out."""
    kinds = types.split(", ")
    frame: DataFrame = spark.createDataFrame([], ", ".join(f"a{i} {k}" for i, k in enumerate(kinds)))
    made = frame.select(rule(*[F.col(f"a{i}") for i in range(len(kinds))]).alias("out"))
    return made._jdf.queryExecution().analyzed().projectList().head().child().sql(), made.schema["out"].dataType.simpleString()


def register(spark: SparkSession) -> list[str]:
    """Makes the source `jobloom` and the functions `jobloom_<name>` known to a session; gives the functions' names."""
    prepare(spark)
    spark.dataSource.register(TableSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for name, (types, rule) in FUNCTIONS.items():
        body, kind = sql_text(spark, rule, types)
        arguments = ", ".join(f"a{i} {k}" for i, k in enumerate(types.split(", ")))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION jobloom_{name}({arguments}) RETURNS {kind} RETURN {body}")
    return [f"jobloom_{name}" for name in FUNCTIONS]


def views(spark: SparkSession, root: str, commit: int | None = None, prefix: str = "") -> None:
    """Temporary views of all tables of a store, under their names behind a prefix."""
    register(spark)
    for table in TABLES:
        rows = spark.read.format("jobloom").option("path", root).option("table", table)
        (rows if commit is None else rows.option("commit", str(commit))).load().createOrReplaceTempView(prefix + table)
