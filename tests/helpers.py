"""Comparison with SQL, and a fake source."""

from __future__ import annotations

import datetime
import io
import math
import zipfile
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime):
        return v.date() if v.time() == datetime.time(0) else v
    if isinstance(v, bool):
        return int(v)
    return 0.0 if isinstance(v, float) and v == 0 else v


def rows_of(df):
    return sorted((tuple(plain(x) for x in r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def sql_rows(sql: str, folder: Path = DATA):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)


class Response:
    def __init__(self, text="", payload=None, content=b"", headers=None, error=None):
        self.text, self._payload, self._content, self.headers, self._error = text, payload, content, headers or {"content-type": "text/csv"}, error

    def raise_for_status(self):
        if self._error:
            raise self._error

    def json(self):
        return self._payload

    def iter_content(self, size):
        yield self._content


def zipped(csv: str, names=("data.csv",)) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, csv)
    return out.getvalue()


class Source:
    """A transport that answers from what each source holds: probe dates, pages of CSV, a bulk CSV."""

    def __init__(self, probe=None, pages=None, bulk=None, endless=False):
        self.probe, self.pages, self.bulk, self.endless = probe or {}, pages or {}, bulk or {}, endless
        self.calls = []

    def get(self, url, params=None, timeout=None, stream=False):
        self.calls.append((url, dict(params or {})))
        if url.startswith("bulk:"):
            return Response(content=zipped(self.bulk[url.removeprefix("bulk:")]))
        name, kind = url.rsplit("/", 1)[-1].split(".")
        if kind == "json" and "qopts.export" in params:
            return Response(payload={"datatable_bulk_download": {"file": {"status": "FRESH" if name in self.bulk else "creating", "link": f"bulk:{name}"}}})
        if kind == "json" and "qopts.columns" in params:
            return Response(payload={"datatable": {"data": [[d] for d in self.probe.get(name, [])]}})
        page = int(params.get("qopts.cursor_id", 0))
        pages = self.pages.get(name, [])
        if kind == "json":
            more = page + 1 if self.endless or page + 1 < len(pages) else None
            return Response(payload={"meta": {"next_cursor_id": more}})
        return Response(text=pages[0 if self.endless else page] if pages else "")
