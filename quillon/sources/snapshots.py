"""A store of Parquet tables: a version is a manifest of data files, made current by one atomic rename.

``<root>/<table>/data-<id>/`` holds the files of one write, ``<root>/<table>/CURRENT-000001`` is a manifest: a line of JSON
that lists the files of a version and notes for readers of streams. The largest number counts. An append adds files and
rewrites none; an overlap rewrites only the files that hold rows from the watermark on. Files are staged under an id of
their own, so writers do not meet before the rename; a writer that finds its number taken fails, and what it staged goes.
All steps go through Hadoop's file system API, so the root may be any path that Spark can write. Files that only versions
older than the last ``KEEP`` use are removed.
"""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import aligned, newer


class ReplaceError(RuntimeError):
    """A staged version is not what was to be written."""


class SnapshotStore:
    KEEP = 2

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------------------------------------------ manifests

    def _names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _versions(self, table: str) -> list[int]:
        return [int(n.split("-")[1]) for n in self._names(f"{self.root}/{table}") if n.startswith("CURRENT-")]

    def _manifest(self, table: str, version: int | None = None) -> dict:
        version = max(self._versions(table), default=None) if version is None else version
        if version is None:
            return {"version": 0, "files": [], "notes": {}}
        stream = self._fs.open(self._path(f"{self.root}/{table}/CURRENT-{version:06d}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {"version": version} | json.loads(text)

    def _commit(self, table: str, version: int, files: list[str], notes: dict) -> None:
        base = f"{self.root}/{table}"
        pending, current = self._path(f"{base}/.pending-{uuid.uuid4().hex}"), self._path(f"{base}/CURRENT-{version:06d}")
        out = self._fs.create(pending, True)
        try:
            out.write(bytearray(json.dumps({"files": files, "notes": notes}).encode()))
        finally:
            out.close()
        if self._fs.exists(current) or not self._fs.rename(pending, current):
            self._fs.delete(pending, False)
            raise ReplaceError(f"{table}: version {version} could not be made current")
        self._forget(table, version)

    def _forget(self, table: str, version: int) -> None:
        """Removes the files that only old versions use."""
        base = f"{self.root}/{table}"
        old = [v for v in self._versions(table) if v <= version - self.KEEP]
        if not old:
            return
        kept = {f for v in self._versions(table) if v not in old for f in self._manifest(table, v)["files"]}
        gone = {f for v in old for f in self._manifest(table, v)["files"]} - kept
        folders = {f.split("/")[0] for f in kept}
        for f in gone:
            folder = f.split("/")[0]
            self._fs.delete(self._path(f"{base}/{f if folder in folders else folder}"), True)
        for v in old:
            self._fs.delete(self._path(f"{base}/CURRENT-{v:06d}"), False)

    def _stage(self, table: str, df: DataFrame) -> list[str]:
        """Files of ``df``, relative to the table."""
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{table}/{folder}")
        return [f"{folder}/{n}" for n in self._names(f"{self.root}/{table}/{folder}") if n.endswith(".parquet")]

    def _unstage(self, table: str, files: list[str]) -> None:
        for folder in {f.split("/")[0] for f in files}:
            self._fs.delete(self._path(f"{self.root}/{table}/{folder}"), True)

    def _open(self, table: str, files: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{table}/{f}" for f in files])

    # -------------------------------------------------------------------------------------------------- readers

    def tables(self) -> list[str]:
        return [n for n in self._names(self.root) if self._versions(n)]

    def exists(self, table: str) -> bool:
        return bool(self._versions(table))

    def read(self, table: str) -> DataFrame:
        files = self._manifest(table)["files"]
        if not files:
            raise KeyError(f"no table {table}")
        return self._open(table, files)

    def columns(self, table: str) -> list[str]:
        return self.read(table).columns

    def rows(self, table: str) -> int:
        return self.read(table).count() if self.exists(table) else 0

    def notes(self, table: str) -> dict:
        return self._manifest(table)["notes"]

    def watermark(self, table: str, column: str) -> date | None:
        """The largest date of a column; None only if the table is absent or has no value. Other failures are raised."""
        if not self.exists(table):
            return None
        return self.read(table).agg(F.max(F.col(column).cast("date"))).first()[0]

    # -------------------------------------------------------------------------------------------------- writers

    def _guard(self) -> None:
        if self.read_only:
            raise PermissionError("the store is open for reading only")

    def write(self, table: str, df: DataFrame, expect_rows: int | None = None, expect_columns: list[str] | None = None, notes: dict | None = None) -> int:
        """Makes df the table's content and returns its rows. Checks come before the swap."""
        self._guard()
        version = self._manifest(table)["version"] + 1
        if not df.columns:
            raise ReplaceError(f"{table}: no columns")
        files = self._stage(table, df)
        try:
            staged = self._open(table, files)
            n = staged.count()
            if expect_rows is not None and n != expect_rows:
                raise ReplaceError(f"{table}: staged {n} rows, expected {expect_rows}")
            if expect_columns is not None and staged.columns != expect_columns:
                raise ReplaceError(f"{table}: staged columns {staged.columns}, expected {expect_columns}")
            self._commit(table, version, files, notes or {})
        except Exception:
            self._unstage(table, files)
            raise
        return n

    def full_replace(self, table: str, df: DataFrame, expect_rows: int | None = None) -> tuple[int, int]:
        """Rows before and after."""
        before = self.rows(table)
        return before, self.write(table, df, expect_rows, df.columns)

    def append(self, table: str, rows: DataFrame, notes: dict | None = None, without: list[str] | None = None, rest: DataFrame | None = None) -> int:
        """Adds rows as files of their own; returns how many. ``without``: files that go, ``rest``: what stays of them."""
        self._guard()
        old = self._manifest(table)
        files = self._stage(table, rows)
        left = self._stage(table, rest) if rest is not None else []
        try:
            n = self._open(table, files).count()
            kept = [f for f in old["files"] if f not in set(without or [])]
            self._commit(table, old["version"] + 1, kept + left + files, old["notes"] | (notes or {}))
        except Exception:
            self._unstage(table, files + left)
            raise
        return n

    def append_newer(self, table: str, new: DataFrame, column: str) -> int:
        """Adds distinct rows above the watermark; the first rows of a table are taken as they are. Rows added."""
        if not self.exists(table):
            return self.write(table, new)
        return self.append(table, newer(self.read(table), new, column, self.watermark(table, column)))

    def overlap_replace(self, table: str, new: DataFrame, column: str, notes: dict | None = None) -> int:
        """Replaces what lies at or above the watermark; the first rows of a table are taken as they are. Rows added, net.

        Old rows with a null watermark stay; new ones are not taken, unless the table has no watermark at all.
        """
        if not self.exists(table):
            return self.write(table, new, notes=notes)
        mark, old = self.watermark(table, column), self.read(table)
        rows = aligned(old, new)
        if mark is None:
            return self.append(table, rows.distinct(), notes)
        late = F.col(column) >= F.lit(mark)
        touched = old.where(late).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()
        # An input file's name is a URI; its last two parts are the path within the table.
        files = ["/".join(r.f.split("/")[-2:]) for r in touched]
        rest = self._open(table, files).where(~F.coalesce(late, F.lit(False)))
        return self.append(table, rows.where(late).distinct(), notes, files, rest) - sum(r.n for r in touched)

    def drop(self, table: str) -> None:
        self._guard()
        self._fs.delete(self._path(f"{self.root}/{table}"), True)
