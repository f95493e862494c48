"""Audit and pruning of a store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..operators.reports import duplicate_keys, table_report
from ..sources.registry import CALENDAR, SOURCES, SourceSpec, kept_tables
from ..sources.snapshots import SnapshotStore

#: Tables whose (ticker, date) keys must be unique.
KEYED = ("sep_base", "daily")


def audit(store: SnapshotStore, sources: dict[str, SourceSpec] = SOURCES) -> DataFrame:
    """A row for each known table: present, rows, date range, entities. Absent tables have nulls."""
    known = [(s.table, s.audit_date, s.entity) for s in sources.values()] + [(CALENDAR, "trading_date", None)]
    schema = "table_name string, present boolean, n_rows long, min_date date, max_date date, entity_column string, distinct_entities long"
    parts = []
    for name, day, entity in known:
        if not store.exists(name):
            parts.append(store.spark.createDataFrame([(name, False, None, None, None, None, None)], schema))
            continue
        df = store.read(name)
        own = table_report(df, name, day if day in df.columns else None, entity if entity in df.columns else None)
        parts.append(own.selectExpr("table_name", "true AS present", "n_rows", "min_date", "max_date", "entity_column", "distinct_entities"))
    return reduce(DataFrame.unionByName, parts)


def audit_duplicates(store: SnapshotStore) -> dict[str, int | None]:
    """Duplicate (ticker, date) keys of the keyed tables; None for an absent one."""
    return {t: duplicate_keys(store.read(t), ["ticker", "date"]).first()[0] if store.exists(t) else None for t in KEYED}


def audit_catalog(store: SnapshotStore) -> list[tuple[str, str, str]]:
    """(table, column, type) of everything stored, in order."""
    return sorted((t, f.name, f.dataType.simpleString()) for t in store.tables() for f in store.read(t).schema)


def prune(store: SnapshotStore, dry_run: bool = True, protected: tuple[str, ...] = (), keep: set[str] | None = None) -> list[str]:
    """Drops what is not a source table or the calendar; the names, in order. Protected roots are refused."""
    if store.root.rstrip("/").rsplit("/", 1)[-1] in protected:
        raise PermissionError(f"{store.root} is protected")
    names = store.tables()
    if not names:
        raise FileNotFoundError(f"no tables below {store.root}")
    drop = sorted(set(names) - (kept_tables() if keep is None else keep))
    if not dry_run:
        for name in drop:
            store.drop(name)
    return drop
