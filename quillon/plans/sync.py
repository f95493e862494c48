"""Synchronisation of source tables: what to do with each, and the record of what was done."""

from __future__ import annotations

import logging
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import redact
from ..operators.labels import trading_calendar
from ..sources.client import REFRESH_PAGES, Client, extract_csv
from ..sources.csvscan import read_csv
from ..sources.registry import CALENDAR, PRICES, SOURCES, SourceSpec
from ..sources.snapshots import SnapshotStore

log = logging.getLogger(__name__)

FAILED = frozenset({"download_failed", "check_failed"})
PENDING = frozenset({"needs_update", "needs_bootstrap"})


@dataclass
class Result:
    """What a run found and did for one table."""

    table: str
    stored_as: str
    mode: str
    status: str = "unknown"
    local_max: date | None = None
    api_max: date | None = None
    has_new_data: bool | None = None
    rows_before: int | None = None
    rows_after: int | None = None
    rows_added: int = 0
    table_exists: bool | None = None

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass
class Sync:
    """A run over one store. ``refresh`` chooses the variant that reloads on demand: its page limit is fixed and a probe
    without an answer fails the check even if nothing new was expected."""

    spark: SparkSession
    store: SnapshotStore
    client: Client
    check_only: bool = False
    force: bool = False
    refresh: bool = False
    download_dir: Path | None = None
    keep_downloads: bool = False
    sources: dict[str, SourceSpec] = None

    def __post_init__(self):
        self.sources = self.sources or SOURCES
        if self.refresh:
            self.client.page_limit = REFRESH_PAGES

    def merge(self, spec: SourceSpec, new: DataFrame) -> int:
        """New rows into the stored table; rows added, net."""
        put = self.store.overlap_replace if spec.overlap else self.store.append_newer
        return put(spec.table, new, spec.watermark)

    def _local_max(self, spec: SourceSpec) -> date | None:
        return self.store.watermark(spec.table, spec.watermark) if spec.watermark else None

    @contextmanager
    def _landed(self, files: list[Path]) -> Iterator[str]:
        """A folder beside the tables, which executors can read, with copies of the driver's files; it goes afterwards."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        landing = jvm.org.apache.hadoop.fs.Path(f"{self.store.root}/.landing-{uuid.uuid4().hex}")
        fs = landing.getFileSystem(conf)
        fs.mkdirs(landing)
        try:
            for f in files:
                fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{f.resolve()}"), jvm.org.apache.hadoop.fs.Path(landing, f.name))
            yield landing.toString()
        finally:
            fs.delete(landing, True)

    def _known(self, spec: SourceSpec) -> StructType | None:
        return self.store.read(spec.table).schema if self.store.exists(spec.table) else None

    def _bulk(self, spec: SourceSpec) -> tuple[int, int]:
        """Replaces the table by the bulk export. Downloads go only after success, and only if not to be kept."""
        root = self.download_dir or Path(tempfile.mkdtemp(prefix="quillon-bulk-"))
        archive = self.client.bulk_zip(spec, root)
        with self._landed([extract_csv(archive)]) as folder:
            counts = self.store.full_replace(spec.table, read_csv(self.spark, folder, spec))
        if not self.keep_downloads:
            shutil.rmtree(archive.parent if self.download_dir else root)
        return counts

    def _replaced(self, spec: SourceSpec, result: Result) -> Result:
        try:
            result.rows_before, result.rows_after = self._bulk(spec)
        except Exception as e:  # noqa: BLE001  any failure leaves the old table and is reported
            log.error("%s: bulk load failed: %s", spec.name, redact(e))
            result.status = "download_failed"
            return result
        result.rows_added = result.rows_after - result.rows_before
        result.status = "updated"
        return result

    def _pages(self, spec: SourceSpec, local_max: date | None, folder: Path) -> int | None:
        """Rows added by the source's new pages; None if they could not be read."""
        try:
            if not self.client.land_pages(spec, local_max, folder):
                return None
            with self._landed(sorted(folder.glob("page-*.csv"))) as landing:
                return self.merge(spec, read_csv(self.spark, landing, spec, known=self._known(spec)))
        except Exception as e:  # noqa: BLE001
            log.error("%s: download failed: %s", spec.name, redact(e))
            return None

    def table(self, name: str) -> Result:
        """Brings one table up to date, or says what it would need."""
        spec = self.sources[name]
        result = Result(name, spec.table, spec.mode, local_max=self._local_max(spec))
        if spec.full or (result.local_max is None and spec.bootstrap):
            result.has_new_data = True
            if self.check_only:
                result.status = "needs_update" if spec.full else "needs_bootstrap"
                return result
            result = self._replaced(spec, result)
            if result.status == "updated" and not spec.full:
                result.local_max = self._local_max(spec)
            return result
        new, result.api_max = self.client.probe(spec, result.local_max)
        result.has_new_data = new
        if not new and not self.force:
            result.status = "check_failed" if result.api_max is None else "up_to_date"
            return result
        if self.check_only:
            result.status = "needs_update"
            return result
        folder = Path(tempfile.mkdtemp(prefix="quillon-pages-", dir=self.download_dir))
        try:
            if self.refresh:
                result.rows_before = self.store.rows(spec.table)
            added = self._pages(spec, result.local_max, folder)
            if added is None:
                result.status = "download_failed"
                return result
            result.rows_added = added
            if self.refresh:
                result.rows_after = result.rows_before + result.rows_added
        finally:
            shutil.rmtree(folder, ignore_errors=True)
        result.local_max = self._local_max(spec)
        result.status = "updated"
        return result

    def run(self, names: list[str], skip_calendar: bool = False) -> tuple[list[Result], dict | None, int]:
        """Results, the calendar's record and the exit code: 1 if any table failed."""
        results = [self.table(n) for n in names]
        prices = next((r for r in results if r.table == PRICES), None)
        due = not skip_calendar if self.refresh else prices is not None and prices.status not in FAILED
        calendar = refresh_calendar(self.store, self.check_only, always=self.refresh) if due else None
        return results, calendar, int(any(r.status in FAILED for r in results))


def refresh_calendar(store: SnapshotStore, check_only: bool = False, always: bool = False, source: str = SOURCES[PRICES].table, calendar: str = CALENDAR) -> dict:
    """Rebuilds the calendar from the distinct dates of the prices if their number or the last one differs (or always)."""
    out = {"table": calendar, "source_table": source, "rows_before": 0, "rows_after": 0, "old_max": None, "new_max": None, "status": "missing_source"}
    if not store.exists(source):
        return out
    if store.exists(calendar):
        out["rows_before"], out["old_max"] = store.read(calendar).agg(F.count("*"), F.max("trading_date")).first()
    day = F.col("date").cast("date")
    out["rows_after"], out["new_max"] = store.read(source).agg(F.countDistinct(day), F.max(day)).first()
    same_max = out["old_max"] == out["new_max"]
    changed = not same_max or (out["rows_before"] != out["rows_after"] and not (always and check_only))
    if check_only:
        out["status"] = "needs_update" if changed else "up_to_date"
    elif changed or always:
        store.write(calendar, trading_calendar(store.read(source)))
        out["status"] = "updated"
    else:
        out["status"] = "up_to_date"
    return out
