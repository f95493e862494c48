"""The source tables: where each is stored, which column marks its progress, how it is reloaded."""

from __future__ import annotations

from dataclasses import dataclass, replace

PRICES = "SEP"
CALENDAR = "trading_calendar"


@dataclass(frozen=True)
class SourceSpec:
    """One source. ``watermark`` is both the API's filter field and the stored column that shows progress.

    ``overlap``: rows of the last watermark are read again, so that same-day corrections arrive. ``full``: the table is
    always replaced. ``bootstrap``: without local rows it is loaded from a bulk export. ``opt_in``: only on request.
    ``quoted_newlines``: free text in its CSV may hold line breaks, so that a file cannot be split.
    ``audit_date`` and ``entity`` are the columns that the audit reports on.
    """

    name: str
    table: str
    description: str
    watermark: str | None
    full: bool = False
    overlap: bool = False
    bootstrap: bool = False
    opt_in: bool = False
    quoted_newlines: bool = False
    date_columns: tuple[str, ...] = ()
    audit_date: str | None = None
    entity: str | None = None

    @property
    def mode(self) -> str:
        return "full" if self.full else "incremental"


def _specs() -> list[SourceSpec]:
    s = SourceSpec
    return [
        s("SEP", "sep_base", "Daily stock prices", "date", date_columns=("date",), audit_date="date", entity="ticker"),
        s("DAILY", "daily", "Daily valuation ratios", "date", date_columns=("date", "lastupdated"), audit_date="date", entity="ticker"),
        s("SF1", "sf1", "Fundamentals", "lastupdated", overlap=True, date_columns=("datekey", "reportperiod", "lastupdated"), audit_date="datekey", entity="ticker"),
        s("SF2", "sf2", "Insider transactions", "filingdate", overlap=True, date_columns=("filingdate", "transactiondate"), audit_date="filingdate", entity="ticker"),
        s("SFP", "sfp", "Fund prices", "date", bootstrap=True, opt_in=True, date_columns=("date", "lastupdated"), audit_date="date", entity="ticker"),
        s("METRICS", "metrics", "Daily snapshot metrics", "lastupdated", overlap=True, date_columns=("date", "lastupdated"), audit_date="date", entity="ticker"),
        s("TICKERS", "tickers", "Ticker metadata", "lastupdated", full=True, quoted_newlines=True, date_columns=("lastupdated", "firstadded", "firstpricedate", "lastpricedate", "firstquarter", "lastquarter"), entity="ticker"),
        s("ACTIONS", "actions", "Corporate actions", "date", date_columns=("date",), audit_date="date", entity="ticker"),
        s("EVENTS", "events", "Corporate event filings", "date", date_columns=("date",), audit_date="date", entity="ticker"),
        s("SF3", "sf3", "Institutional holdings", "calendardate", bootstrap=True, date_columns=("calendardate",), audit_date="calendardate", entity="ticker"),
        s("SF3A", "sf3a", "Institutional holdings by ticker", "calendardate", bootstrap=True, date_columns=("calendardate",), audit_date="calendardate", entity="ticker"),
        s("SF3B", "sf3b", "Institutional holdings by investor", "calendardate", bootstrap=True, date_columns=("calendardate",), audit_date="calendardate", entity="investorname"),
        s("SP500", "sp500", "Index constituent changes", "date", full=True, date_columns=("date",), audit_date="date", entity="ticker"),
        s("INDICATORS", "indicators", "Indicator descriptions", None, full=True, opt_in=True, quoted_newlines=True),
    ]


SOURCES: dict[str, SourceSpec] = {s.name: s for s in _specs()}


def renamed(tables: dict[str, str]) -> dict[str, SourceSpec]:
    """The registry with other stored table names, for catalogs that have their own."""
    return {k: replace(v, table=tables.get(k, v.table)) for k, v in SOURCES.items()}


def select(tables: list[str] | None = None, check_only: bool = False, refresh: bool = False, sources: dict[str, SourceSpec] = SOURCES) -> list[str]:
    """Names to work on: those asked for; else all that need no request; a sync that only checks takes every one."""
    if tables:
        unknown = [t for t in tables if t not in sources]
        if unknown:
            raise ValueError(f"unknown sources: {', '.join(unknown)}")
        return list(tables)
    return [k for k, v in sources.items() if not v.opt_in or (check_only and not refresh)]


def required_for_models(sources: dict[str, SourceSpec] = SOURCES) -> list[str]:
    return select(sources=sources)


def kept_tables(sources: dict[str, SourceSpec] = SOURCES) -> set[str]:
    """Tables that pruning leaves alone."""
    return {v.table for v in sources.values()} | {CALENDAR}
