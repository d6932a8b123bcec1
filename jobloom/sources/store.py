"""Tables as Parquet under a commit log: readers see whole commits over all tables, and a writer with a stale base fails.

A commit is a small numbered file in `_commits` that names one manifest for each table, and the commit that it was made on.
Data and manifests are written first, under names of their own; then the commit's file is created, which is refused where
its number is taken. So of two writers on one base the second fails, whatever lies between reading and writing, and does
its work again on the new base (`TableStore.transact`); a reader, or a writer that dies, sees all tables of the commit
before or all of the one after.

A table is spread over buckets by the hash of its ids. A manifest lists the bucket folders that make the table up, with
their rows and the least and greatest expiry (listings are parted by status, too). An upsert reads and writes only the
buckets that its ids fall into, rows that are new altogether are added beside the others, and all other folders are taken
over by name. A whole write chooses the number of buckets anew. A manifest grows with the buckets, never with the rows.

Many small buckets would be many small files. So a write with more than LEAST_FOLDERS buckets lays neighbours into one folder,
whose rows then name their bucket (`_bucket`); the manifest still has an entry for each bucket, and a reader drops the rows of
buckets that it doesn't list. Where such rows would outnumber those of the buckets that are left, these are written anew, too.

A commit's file is created at once and only once by a hard link on a local file system, and by a rename that refuses to
replace on HDFS and what keeps its promises (viewfs, abfs, abfss). Object stores whose rename copies are refused.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.operators import constraints
from jobloom.schemas import DEFAULTS, FOREIGN_KEYS, TABLES, UNIQUE
from jobloom.sources.shared import discard, materialize

#: Commits that stay besides the newest, whatever their age, and the age in ms below which nothing is deleted.
KEEP, SPARED_MS = 8, 86_400_000
#: Rows of a bucket, about, when a table is written whole; and how many buckets it has at most.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 65_536
#: Folders of a bucket (and status) after which rows are no longer put beside them: the bucket is written anew.
FOLDERS = 8
#: Folders that a write may make whatever its rows; above that, one for BUCKET_ROWS rows.
LEAST_FOLDERS = 32
_COMMIT = re.compile(r"c-(\d{12})\.json")
_RENAMING = ("hdfs", "viewfs", "abfs", "abfss")


class Conflict(RuntimeError):
    """Another writer committed since this one's base."""


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _one_of(column: str, numbers: set[int]) -> Column:
    """Whether a column is one of some numbers: told by those that are missing between them, where these are fewer."""
    low, high = min(numbers), max(numbers)
    gaps = set(range(low, high + 1)) - numbers
    fewer, some = (True, gaps) if len(gaps) < len(numbers) else (False, numbers)
    among = F.expr(f"{column} IN ({', '.join(map(str, sorted(some)))})") if some else F.lit(False)
    return F.col(column).between(low, high) & (~among if fewer else among)


def _parts(name: str) -> list[str]:
    return ["bucket", "status"] if name == "listings" else ["bucket"]


class TableStore:
    def __init__(self, spark: SparkSession, root: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.bucket_rows = spark, root.rstrip("/"), bucket_rows
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._seen: dict[str, int] = {}  # the commit of the last read, or write, of each table

    # --- files

    def _path(self, text: str):
        path = self._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self._conf)

    def _listed(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder and when they were last changed."""
        path, fs = self._path(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path)] if fs.exists(path) else []

    def _text(self, where: str) -> str:
        path, fs = self._path(where)
        stream = fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, where: str, text: str) -> None:
        path, fs = self._path(where)
        out = fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _create(self, where: str, text: str) -> bool:
        """Creates a file whole, or not at all where there is one."""
        part = f"{os.path.dirname(where)}/_{uuid.uuid4().hex}"
        self._put(part, text)
        (source, fs), (target, _) = self._path(part), self._path(where)
        kind = fs.getUri().getScheme()
        try:
            if kind == "file":
                local = lambda p: unquote(urlparse(p).path) if "://" in p or p.startswith("file:") else p
                os.link(local(part), local(where))
                return True
            if kind not in _RENAMING:
                raise ValueError(f"{kind} doesn't say whether it creates a file only once: keep the tables on one of file, {', '.join(_RENAMING)}")
            files = self._jvm.org.apache.hadoop.fs
            once = self.spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
            once[0] = files.Options.Rename.NONE
            files.FileContext.getFileContext(fs.getUri(), self._conf).rename(source, target, once)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            if fs.exists(source):
                fs.delete(source, False)

    # --- commits

    def _numbers(self) -> list[int]:
        """Numbers of the commits, newest first."""
        found = (_COMMIT.fullmatch(n) for n, _ in self._listed(f"{self.root}/_commits"))
        return sorted((int(m[1]) for m in found if m), reverse=True)

    def commit(self, number: int | None = None) -> dict[str, Any]:
        """The newest commit, or one by its number: number, base, tables (manifest by table), notes."""
        for n in self._numbers() if number is None else [number]:
            try:
                return json.loads(self._text(f"{self.root}/_commits/c-{n:012d}.json")) | {"number": n}
            except ValueError:  # cut off: as if it weren't there
                if number is not None:
                    raise
        return {"number": -1, "base": None, "tables": {}, "notes": {}}

    def _publish(self, base: int, tables: dict[str, str], notes: dict[str, Any]) -> int:
        """Commits tables on a base; raises Conflict where that isn't the newest commit any more."""
        newest = self._numbers()
        number = max(newest[0] if newest else -1, base) + 1
        text = json.dumps({"base": base, "tables": tables, "notes": notes, "at_ms": int(time.time() * 1000)})
        if self.commit()["number"] != base or not self._create(f"{self.root}/_commits/c-{number:012d}.json", text):
            raise Conflict(f"another writer committed after {base}")
        return number

    def current(self, name: str) -> str | None:
        """The name of the table's manifest."""
        return self.commit()["tables"].get(name)

    def manifest(self, name: str, version: str | None) -> dict[str, Any]:
        return json.loads(self._text(f"{self.root}/{name}/_manifests/{version}.json")) if version else {"buckets": 0, "entries": []}

    # --- reading and writing

    def frame(self, name: str, entries: list[dict[str, Any]]) -> DataFrame:
        """The rows of some entries of a manifest; folders that are listed in whole are read by their parent's name."""
        fields = TABLES[name].fields
        if not entries:
            return self.spark.createDataFrame([], TABLES[name])
        of: dict[str, list[dict[str, Any]]] = {}
        for e in entries:
            of.setdefault(e["path"].split("/")[0], []).append(e)
        paths, listed = [], []
        for top, own in of.items():
            folders, whole = dict.fromkeys(e["path"] for e in own), len(own) == own[0]["of"]
            paths += [top] if whole or len(folders) == own[0].get("folders") else folders
            if "held" in own[0] and not whole:
                listed.append((F.col("data") == top.removeprefix("data="), _one_of("_bucket", {e["bucket"] for e in own})))
        own = [f for f in fields if f.name not in _parts(name)]
        parts = [T.StructField(p, TABLES[name][p].dataType if p in TABLES[name].names else T.IntegerType()) for p in _parts(name)]
        schema = T.StructType([*own, T.StructField("_bucket", T.IntegerType()), T.StructField("data", T.StringType()), *parts])
        base = f"{self.root}/{name}"
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{p}" for p in paths])
        if listed:
            fits = F.when(*listed[0])
            for here, one in listed[1:]:
                fits = fits.when(here, one)
            rows = rows.filter(fits.otherwise(F.lit(True)))
        return rows.select(*[f.name for f in fields])

    def read(self, name: str) -> DataFrame:
        """The table of the newest commit; an empty one where there is none."""
        found = self.commit()
        self._seen[name] = found["number"]
        return self.frame(name, self.manifest(name, found["tables"].get(name))["entries"])

    def write(self, name: str, rows: DataFrame, check: bool = True) -> str:
        """Writes, validates and commits a whole table; rows that break a constraint are not committed.

        The base is the commit that this store's last read of the table saw, if it was read at all.
        """
        t = self.begin()
        base = self._seen.get(name, t.base)
        if base != t.base:
            raise Conflict(f"another writer committed after {base}, when {name} was read")
        t.write(name, rows, check)
        number = t.commit()
        # Whatever else was read of the base is still as new as can be: only this store has written since.
        self._seen = {n: number if seen == base else seen for n, seen in self._seen.items()} | {name: number}
        return t.tables[name]

    def begin(self) -> Transaction:
        return Transaction(self)

    def transact(self, work: Callable[[Transaction], Any], tries: int = 5) -> Any:
        """What work returns for a transaction that then commits; after a conflict it is done again on the new base."""
        for left in range(tries - 1, -1, -1):
            t = self.begin()
            out = work(t)
            try:
                t.commit()
                return out
            except Conflict:
                t.abort()
                if not left:
                    raise

    # --- columns and definitions

    @staticmethod
    def unknown_columns(name: str, rows: DataFrame) -> list[str]:
        return sorted(set(rows.columns) - {f.name for f in TABLES[name].fields})

    def assert_known_columns(self, name: str, rows: DataFrame) -> None:
        unknown = self.unknown_columns(name, rows)
        if unknown:
            raise ValueError(f"{name} has unknown columns: {', '.join(unknown)}")

    @staticmethod
    def migrated(name: str, rows: DataFrame) -> DataFrame:
        """Missing columns added with their defaults, else as nulls; updated_at of a listing is its posted_at. A null stays one."""
        out = []
        for f in TABLES[name].fields:
            if f.name in rows.columns:
                value = F.col(f.name)
            elif (name, f.name) == ("listings", "updated_at"):
                value = F.col("posted_at")
            else:
                value = F.lit(DEFAULTS.get(name, {}).get(f.name))
            out.append(value.cast(f.dataType).alias(f.name))
        return rows.select(*out)

    def columns(self, name: str) -> T.StructType:
        return self.read(name).schema

    @staticmethod
    def stale_references(definitions: DataFrame, tables: DataFrame) -> DataFrame:
        """name, target: what definitions (name, sql) refer to by REFERENCES that is no table (name); each once."""
        targets = F.regexp_extract_all("sql", F.lit(r"""(?i)\bREFERENCES[\s"'`\[]+([A-Za-z_][A-Za-z0-9_]*)"""), F.lit(1))
        named = definitions.select("name", F.explode(F.array_distinct(targets)).alias("target"))
        live = tables.select(F.lower("name").alias("_live")).distinct()
        return named.join(live, F.lower("target") == F.col("_live"), "left_anti")

    # --- what nothing needs any more

    def stale_versions(self, name: str) -> list[str]:
        """Data folders that the newest commit doesn't name."""
        used = {e["path"].split("/")[0] for e in self.manifest(name, self.current(name))["entries"]}
        return sorted(n for n, _ in self._listed(f"{self.root}/{name}") if n.startswith("data=") and n not in used)

    def vacuum(self, spared_ms: int = SPARED_MS, keep: int = KEEP, now_ms: int | None = None) -> dict[str, int]:
        """Deletes commits but for the newest `keep` + 1, and what none of those names. Nothing younger than spared_ms goes:
        a reader of an older commit, and a writer that hasn't committed yet, have that long."""
        before = (now_ms if now_ms is not None else int(time.time() * 1000)) - spared_ms
        numbers = self._numbers()
        when = dict(self._listed(f"{self.root}/_commits"))
        file = "c-{:012d}.json".format
        kept = [n for i, n in enumerate(numbers) if i <= keep or when[file(n)] > before]
        gone = {"commits": [f"_commits/{file(n)}" for n in numbers if n not in kept], "manifests": [], "folders": []}
        for name in TABLES:
            manifests = {self.commit(n)["tables"].get(name) for n in kept}
            data = {e["path"].split("/")[0] for m in manifests for e in self.manifest(name, m)["entries"]}
            gone["manifests"] += [f"{name}/_manifests/{n}" for n, at in self._listed(f"{self.root}/{name}/_manifests") if n.removesuffix(".json") not in manifests and at <= before]
            gone["folders"] += [f"{name}/{n}" for n, at in self._listed(f"{self.root}/{name}") if n.startswith("data=") and n not in data and at <= before]
        for some in gone.values():
            for where in some:
                path, fs = self._path(f"{self.root}/{where}")
                fs.delete(path, True)
        return {what: len(some) for what, some in gone.items()}


class Transaction:
    """Reads of one commit, with this transaction's own writes on top, and one commit of all that it wrote."""

    def __init__(self, store: TableStore):
        found = store.commit()
        self.store, self.spark, self.base = store, store.spark, found["number"]
        self.tables: dict[str, str] = dict(found["tables"])
        self.notes: dict[str, Any] = {}
        self.base_notes: dict[str, Any] = found["notes"]
        self.changed = False
        self.folders: list[str] = []  # written by this transaction

    def rows(self, name: str) -> int:
        """How many rows a table has, by its manifest."""
        return sum(e["rows"] for e in self.manifest(name)["entries"])

    def rows_by_status(self) -> dict[str, int]:
        """Listings by status, by their manifest."""
        found: dict[str, int] = {}
        for e in self.manifest("listings")["entries"]:
            found[e["status"]] = found.get(e["status"], 0) + e["rows"]
        return dict(sorted(found.items(), key=str))

    def manifest(self, name: str) -> dict[str, Any]:
        return self.store.manifest(name, self.tables.get(name))

    def read(self, name: str) -> DataFrame:
        return self.store.frame(name, self.manifest(name)["entries"])

    def rows_of(self, name: str, ids: DataFrame) -> DataFrame:
        """The rows of the buckets that ids (id) fall into: all that an upsert of these ids has to look at."""
        manifest = self.manifest(name)
        touched = self._touched(ids, manifest["buckets"])
        return self.store.frame(name, [e for e in manifest["entries"] if e["bucket"] in touched])

    @staticmethod
    def _touched(ids: DataFrame, buckets: int) -> set[int]:
        return {r.b for r in ids.select(bucket_of(F.col("id"), buckets).alias("b")).distinct().collect()} if buckets else set()

    def _written(self, name: str, rows: DataFrame, buckets: int, about: int) -> list[dict[str, Any]]:
        """Entries of rows, written in buckets in order of expiry. about: how many rows these are, which says how many folders they get."""
        data, parts = f"data={uuid.uuid4().hex}", _parts(name)
        where = f"{self.store.root}/{name}/{data}"
        folders = min(buckets, max(LEAST_FOLDERS, about // BUCKET_ROWS))
        shared = ["_bucket"] * (folders < buckets)
        spread = rows.withColumn("bucket", bucket_of(F.col("id"), buckets))
        if shared:
            spread = spread.withColumn("_bucket", F.col("bucket")).withColumn("bucket", F.expr(f"int(bigint(_bucket) * {folders} div {buckets})"))
        order = [*parts, *shared, *["expires_at"] * (name == "listings")]
        self.folders.append(where)
        spread.repartition("bucket").sortWithinPartitions(*order).write.partitionBy(*parts).parquet(where)
        back = self.spark.read.schema(self._schema_with_parts(name)).parquet(where)
        bounds = [F.min("expires_at").alias("low"), F.max("expires_at").alias("high")] if name == "listings" else [F.lit(None).alias("low"), F.lit(None).alias("high")]
        found = back.groupBy(*parts, *shared).agg(F.count("*").alias("rows"), *bounds).collect()
        held: dict[int, int] = {}
        for r in found:
            held[r.bucket] = held.get(r.bucket, 0) + r.rows
        entries = []
        for r in found:
            status = r.status if name == "listings" else None
            folder = "" if name != "listings" else f"/status={'__HIVE_DEFAULT_PARTITION__' if status is None else status}"
            bucket = r._bucket if shared else r.bucket
            entries.append({"path": f"{data}/bucket={r.bucket}{folder}", "bucket": bucket, "status": status, "rows": r.rows, "low": r.low, "high": r.high, "of": len(found)})
            if shared:
                entries[-1]["held"] = held[r.bucket]
        if shared:
            made = len({e["path"] for e in entries})
            for e in entries:
                e["folders"] = made
        return entries

    @staticmethod
    def _schema_with_parts(name: str) -> T.StructType:
        return T.StructType([*TABLES[name].fields, T.StructField("_bucket", T.IntegerType()), T.StructField("bucket", T.IntegerType())])

    def _take(self, name: str, buckets: int, entries: list[dict[str, Any]]) -> None:
        version = f"m-{uuid.uuid4().hex}"
        self.folders.append(f"{self.store.root}/{name}/_manifests/{version}.json")
        self.store._put(self.folders[-1], json.dumps({"buckets": buckets, "entries": entries}))
        self.tables[name], self.changed = version, True

    def write(self, name: str, rows: DataFrame, check: bool = True) -> None:
        """A whole table in place of the one there was."""
        self.store.assert_known_columns(name, rows)
        rows = materialize(self.store.migrated(name, rows), "table")
        n = rows.count()
        buckets = min(MOST_BUCKETS, max(1, -(-n // self.store.bucket_rows)))
        entries = self._written(name, rows, buckets, n)
        discard(rows)
        if check:
            constraints.validate(name, self.store.frame(name, entries), {p: self.read(p) for p in TABLES if p != name})
        self._take(name, buckets, entries)

    def upsert(self, name: str, rows: DataFrame, counts: dict[str, Column] | None = None, gone: DataFrame | None = None) -> dict[str, int]:
        """Rows put in place of those with their ids, or added; rows with the ids in `gone` (id) are taken out.

        counts: aggregates over the rows, taken by the job that writes them. Returns these, rows, and the buckets written.
        """
        self.store.assert_known_columns(name, rows)
        seen = Observation()
        own = self.store.migrated(name, rows).observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (counts or {}).items()])
        own = materialize(own, "upsert")
        out = {k: v or 0 for k, v in seen.get.items()}
        manifest = self.manifest(name)
        ids = own.select("id") if gone is None else own.select("id").union(gone.select("id"))
        if out["rows"] or gone is not None:
            buckets = manifest["buckets"] or min(MOST_BUCKETS, max(1, -(-out["rows"] // self.store.bucket_rows)))
            touched = self._touched(ids, buckets)
            old = [e for e in manifest["entries"] if e["bucket"] in touched]
            rest = [e for e in manifest["entries"] if e["bucket"] not in touched]
            stored = self.store.frame(name, old)
            self._check(name, own, old, rest)
            known = stored.select("id").join(ids, "id", "left_semi")
            beside = max([0, *self._folders(old).values()]) < FOLDERS and gone is None and known.isEmpty()
            about, kept = out["rows"], own
            if not beside:
                touched = self._widened(manifest["entries"], touched)
                old = [e for e in manifest["entries"] if e["bucket"] in touched]
                rest = [e for e in manifest["entries"] if e["bucket"] not in touched]
                kept = self.store.frame(name, old).join(ids, "id", "left_anti").unionByName(own)
                about += sum(e["rows"] for e in old)
            entries = self._written(name, kept, buckets, about)
            self._take(name, buckets, (manifest["entries"] if beside else rest) + entries)
            out["buckets"], out["written"] = len(touched), sum(e["rows"] for e in entries)
        discard(own)
        return out | {"buckets": out.get("buckets", 0), "written": out.get("written", 0)}

    @staticmethod
    def _widened(entries: list[dict[str, Any]], touched: set[int]) -> set[int]:
        """Buckets to write anew: those touched, and what they leave of a shared folder that then holds more rows that nothing lists
        than its other buckets have in all."""
        rows: dict[int, int] = {}
        shared: dict[str, list[dict[str, Any]]] = {}
        for e in entries:
            rows[e["bucket"]] = rows.get(e["bucket"], 0) + e["rows"]
            if "held" in e:
                shared.setdefault("/".join(e["path"].split("/")[:2]), []).append(e)
        more = touched
        while more:
            touched, more = touched | more, set()
            for own in shared.values():
                left = [e for e in own if e["bucket"] not in touched]
                others = {e["bucket"] for e in left}
                if own[0]["held"] - sum(e["rows"] for e in left) > sum(rows[b] for b in others):
                    more |= others
        return touched

    @staticmethod
    def _folders(entries: list[dict[str, Any]]) -> dict[tuple, int]:
        found: dict[tuple, int] = {}
        for e in entries:
            key = e["bucket"], e["status"]
            found[key] = found.get(key, 0) + 1
        return found

    def _check(self, name: str, own: DataFrame, old: list[dict[str, Any]], rest: list[dict[str, Any]]) -> None:
        """Constraints of new rows: their own, keys that other rows have, parents. The table is read by its keys alone."""
        parents = {p: self.read(p) for _, p in [FOREIGN_KEYS[name]] if p in self.tables} if name in FOREIGN_KEYS else {}
        constraints.validate(name, own, parents)
        others = [k for k in UNIQUE[name] if k != "id"]
        for key in others:
            table = self.store.frame(name, old + rest).select("id", key)
            mine = own.select(F.col("id").alias("_id"), key)
            taken = table.join(own.select("id"), "id", "left_anti").join(mine, key, "left_semi")
            found = taken.limit(3).collect()
            if found:
                raise ValueError(f"{name} breaks unique {key}: {found}")

    def remove(self, name: str, ids: DataFrame) -> dict[str, int]:
        """Takes out the rows with the ids (id)."""
        return self.upsert(name, self.spark.createDataFrame([], TABLES[name]), gone=ids)

    def abort(self) -> None:
        """Deletes what this transaction wrote and hasn't committed."""
        for where in self.folders:
            path, fs = self.store._path(where)
            fs.delete(path, True)
        self.folders.clear()

    def commit(self) -> int:
        """Publishes all writes as one commit, if there are any; raises Conflict where another one came between."""
        if not self.changed and not self.notes:
            return self.base
        notes = self.base_notes | self.notes
        number = self.store._publish(self.base, self.tables, notes)
        self.base, self.base_notes, self.notes, self.changed = number, notes, {}, False
        self.folders.clear()
        return number
