"""Store, synchronisation, gate, audit and command line, against a fake source."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import Response, Source, zipped
from quillon.functions.scalars import redact
from quillon.plans import cli
from quillon.plans.audit import audit, audit_catalog, audit_duplicates, prune
from quillon.plans.gate import assess, run_gate
from quillon.plans.sync import Result, Sync, refresh_calendar
from quillon.sources.client import Client, SourceError, extract_csv
from quillon.sources.registry import SOURCES, kept_tables, renamed, required_for_models, select
from quillon.sources.snapshots import ReplaceError, SnapshotStore

D = dt.date
SEP = "date date, ticker string, close double"


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/db")


def _sync(store, source, tmp_path, **kw):
    limit = kw.pop("page_limit", 5000)
    return Sync(store.spark, store, Client("http://x", "secret-key", source, limit, 0, 2, lambda s: None), download_dir=_dir(tmp_path), **kw)


def _dir(tmp_path) -> Path:
    d = tmp_path / "downloads"
    d.mkdir(exist_ok=True)
    return d


def _put(store, table, rows, schema):
    store.write(table, store.spark.createDataFrame(rows, schema))


def _rows(store, table):
    return sorted(tuple(r) for r in store.read(table).collect())


def test_registry_selection():
    assert "SFP" not in select() and "SFP" in select(check_only=True) and "INDICATORS" not in select(check_only=True, refresh=True)
    assert select(["SFP"]) == ["SFP"] and len(SOURCES) == 14 and len(kept_tables()) == 15
    assert required_for_models() == [k for k in SOURCES if k not in ("SFP", "INDICATORS")]
    assert renamed({"SEP": "p"})["SEP"].table == "p"
    with pytest.raises(ValueError):
        select(["NOPE"])


def test_store_keeps_old_version_when_a_write_fails(store, monkeypatch):
    _put(store, "tickers", [("QLN", "Quill Lane"), ("RRB", "Reed & Rib")], "ticker string, name string")
    new = store.spark.createDataFrame([("INK", "Inkwell")], "ticker string, name string")
    with pytest.raises(ReplaceError):
        store.write("tickers", new, expect_rows=2)
    monkeypatch.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.write("tickers", new)
    monkeypatch.undo()
    assert _rows(store, "tickers") == [("QLN", "Quill Lane"), ("RRB", "Reed & Rib")]
    assert store.full_replace("tickers", new) == (2, 1) and _rows(store, "tickers") == [("INK", "Inkwell")]
    with pytest.raises(PermissionError):
        SnapshotStore(store.spark, store.root, read_only=True).write("tickers", new)


def test_store_keeps_two_versions(store, tmp_path):
    for k in range(4):
        _put(store, "t", [(k,)], "k int")
    names = sorted(p.name for p in (tmp_path / "db/t").iterdir() if not p.name.startswith("."))
    assert names[:2] == ["CURRENT-000003", "CURRENT-000004"] and len(names) == 4 and all(n.startswith("data-") for n in names[2:])


def _files(tmp_path, table):
    return {p.name: p.stat().st_mtime_ns for p in (tmp_path / "db" / table).rglob("*.parquet")}


def test_an_append_rewrites_no_file(store, tmp_path):
    _put(store, "sep_base", [(D(2031, 3, k), "QLN", float(k)) for k in range(1, 9)], SEP)
    old = _files(tmp_path, "sep_base")
    new = store.spark.createDataFrame([(D(2031, 3, 8), "QLN", 0.0), (D(2031, 3, 9), "QLN", 9.0)], SEP)
    assert store.append_newer("sep_base", new, "date") == 1
    now = _files(tmp_path, "sep_base")
    assert old.items() <= now.items() and len(now) > len(old) and store.rows("sep_base") == 9


def test_an_overlap_rewrites_only_files_with_late_rows(store, tmp_path):
    _put(store, "sf2", [(D(2031, 3, 1), "QLN", 1.0)], SEP)
    store.append_newer("sf2", store.spark.createDataFrame([(D(2031, 3, 2), "QLN", 2.0), (D(2031, 3, 2), "RRB", 2.5)], SEP).coalesce(1), "date")
    store.append("sf2", store.spark.createDataFrame([(None, "INK", 0.0)], SEP))
    first = {n: t for n, t in _files(tmp_path, "sf2").items()}
    assert store.overlap_replace("sf2", store.spark.createDataFrame([(D(2031, 3, 2), "QLN", 7.0), (D(2031, 3, 3), "RRB", 3.0), (D(2031, 3, 1), "QLN", 9.0)], SEP), "date") == 0
    assert sorted(map(repr, _rows_any(store, "sf2"))) == sorted(map(repr, [(D(2031, 3, 1), "QLN", 1.0), (D(2031, 3, 2), "QLN", 7.0), (D(2031, 3, 3), "RRB", 3.0), (None, "INK", 0.0)]))
    kept = set(store._manifest("sf2")["files"])
    assert sum(n in {f.split("/")[-1] for f in kept} for n in first) >= 2


def _rows_any(store, table):
    return [tuple(r) for r in store.read(table).collect()]


def test_two_writers_of_one_version(store, monkeypatch):
    _put(store, "t", [(0,)], "k int")
    late = SnapshotStore(store.spark, store.root)
    old = late._manifest("t")
    assert store.append("t", store.spark.createDataFrame([(1,)], "k int")) == 1
    monkeypatch.setattr(late, "_manifest", lambda *a: old)
    with pytest.raises(ReplaceError):
        late.append("t", store.spark.createDataFrame([(2,)], "k int"))
    assert _rows(store, "t") == [(0,), (1,)]


def test_watermark_is_none_only_without_rows(store):
    assert store.watermark("sep_base", "date") is None
    _put(store, "sep_base", [(D(2026, 1, 2), "A", 1.0)], SEP)
    with pytest.raises(Exception):  # noqa: B017, PT011  an unknown column is not taken for an empty table
        store.watermark("sep_base", "nope")


def test_incremental_append_and_calendar(store, tmp_path):
    _put(store, "sep_base", [(D(2031, 3, 4), "QLN", 12.5)], SEP)
    src = Source({"SEP": ["2031-03-05"]}, {"SEP": ["close,date,ticker\n13.25,2031-03-05,RRB\n13.25,2031-03-05,RRB\n12.75,2031-03-05,QLN\n"]})
    results, calendar, code = _sync(store, src, tmp_path).run(["SEP"])
    assert code == 0 and results[0].status == "updated" and results[0].rows_added == 2 and results[0].local_max == D(2031, 3, 5)
    assert calendar["status"] == "updated" and _rows(store, "trading_calendar") == [(D(2031, 3, 4),), (D(2031, 3, 5),)]
    assert all(p.get("date.gte") == "2031-03-05" for _, p in src.calls)
    assert refresh_calendar(store)["status"] == "up_to_date" and list(_dir(tmp_path).iterdir()) == []


def test_first_rows_of_a_table_are_taken_as_they_are(store, tmp_path):
    src = Source({"SEP": ["2026-01-03"]}, {"SEP": ["date,ticker,close\n2026-01-03,A,1.0\n2026-01-03,A,1.0\n"]})
    assert _sync(store, src, tmp_path).table("SEP").rows_added == 2


def test_check_only_changes_nothing(store, tmp_path):
    _put(store, "sep_base", [(D(2026, 1, 3), "A", 1.0)], SEP)
    _put(store, "trading_calendar", [(D(2026, 1, 2),)], "trading_date date")
    results, calendar, _ = _sync(store, Source({"SEP": []}), tmp_path, check_only=True).run(["SEP"])
    assert results[0].status == "up_to_date" and calendar["status"] == "needs_update" and _rows(store, "trading_calendar") == [(D(2026, 1, 2),)]


@pytest.mark.parametrize(("name", "schema", "old", "csv", "mark"), [
    ("SF1", "ticker string, dimension string, datekey date, reportperiod date, lastupdated date, revenue long", ("QLN", "MRY", D(2030, 9, 30), D(2030, 6, 30), D(2031, 3, 4), 41), "revenue,ticker,dimension,datekey,reportperiod,lastupdated\n57,QLN,MRY,2030-09-30,2030-06-30,2031-03-04\n", "lastupdated"),
    ("METRICS", "ticker string, date date, lastupdated date, marketcap long", ("RRB", D(2031, 3, 3), D(2031, 3, 4), 41), "ticker,date,lastupdated,marketcap\nRRB,2031-03-03,2031-03-04,57\n", "lastupdated"),
])
def test_same_day_correction_replaces(store, tmp_path, name, schema, old, csv, mark):
    table = SOURCES[name].table
    _put(store, table, [old], schema)
    src = Source({name: ["2031-03-04"]}, {name: [csv]})
    result = _sync(store, src, tmp_path).table(name)
    assert result.status == "updated" and _rows(store, table) == [(*old[:-1], 57)]
    assert all(p.get(f"{mark}.gte") == "2031-03-04" for _, p in src.calls)


def test_bootstrap_then_pages(store, tmp_path):
    src = Source(bulk={"SF3": "ticker,calendardate,shares\nQLN,2026-01-02,8\n"})
    assert _sync(store, src, tmp_path, check_only=True).table("SF3").status == "needs_bootstrap"
    r = _sync(store, src, tmp_path).table("SF3")
    assert (r.status, r.rows_before, r.rows_after, r.local_max) == ("updated", 0, 1, D(2026, 1, 2)) and list(_dir(tmp_path).iterdir()) == []
    src = Source({"SF3": ["2026-01-05"]}, {"SF3": ["ticker,calendardate,shares\nINK,2026-01-05,9\n"]})
    assert _sync(store, src, tmp_path).table("SF3").rows_added == 1
    assert all("qopts.export" not in p and p["calendardate.gte"] == "2026-01-03" for _, p in src.calls)


def test_full_table_is_always_replaced(store, tmp_path):
    schema = "ticker string, lastupdated date, name string"
    _put(store, "tickers", [(t, D(2031, 3, 4), "a name") for t in ("QLN", "RRB", "INK")], schema)
    csv = 'ticker,lastupdated,firstadded,firstpricedate,lastpricedate,firstquarter,lastquarter,name\nRRB,2031-03-04,,,,,,"Reed\n& Rib"\n'
    src = Source(bulk={"TICKERS": csv})
    assert _sync(store, src, tmp_path, check_only=True).table("TICKERS").status == "needs_update"
    r = _sync(store, src, tmp_path, keep_downloads=True).table("TICKERS")
    assert (r.rows_before, r.rows_after, r.rows_added) == (3, 1, -2) and store.read("tickers").first().name == "Reed\n& Rib"
    assert len(list(_dir(tmp_path).iterdir())) == 1
    stale = _sync(store, Source(), tmp_path).table("TICKERS")
    assert stale.status == "download_failed" and store.rows("tickers") == 1


def test_page_limit(store, tmp_path):
    page = "date,ticker,close\n" + "\n".join(f"2026-01-03,T{i},1.0" for i in range(10_000)) + "\n"
    src = Source({"SEP": ["2026-01-03"]}, {"SEP": [page]}, endless=True)
    results, calendar, code = _sync(store, src, tmp_path, page_limit=2).run(["SEP"])
    assert code == 1 and results[0].status == "download_failed" and not store.exists("sep_base") and calendar is None
    last = "date,ticker,close\n2026-01-04,Z,1.0\n"
    src = Source({"SEP": ["2026-01-03"]}, {"SEP": [page, page, last]})
    assert _sync(store, src, tmp_path, page_limit=3).table("SEP").rows_added == 20_001


def test_missing_date_column_fails_the_download(store, tmp_path):
    src = Source({"DAILY": ["2026-01-03"]}, {"DAILY": ["date,ticker\n2026-01-03,A\n"]})
    assert _sync(store, src, tmp_path).table("DAILY").status == "download_failed"


def test_probe_without_answer(store, tmp_path):
    assert _sync(store, Source({"SEP": []}), tmp_path).table("SEP").status == "check_failed"

    class Broken:
        def get(self, *a, **k):
            return Response(error=RuntimeError("GET http://x?api_key=secret-key failed"))

    client = Client("http://x", "secret-key", Broken(), poll_attempts=1)
    assert client.probe(SOURCES["SEP"], D(2026, 1, 1)) == (False, None)
    with pytest.raises(SourceError) as e:
        client.bulk_zip(SOURCES["TICKERS"], tmp_path)
    assert "secret-key" not in str(e.value) and "<redacted>" in str(e.value) and "secret-key" not in repr(client)
    for text in ("Client(api_key='secret-key', x=1)", '{"api_key": "secret-key"}', "api_key=secret-key", "apikey: secret-key"):
        assert "secret-key" not in redact(text) and redact(text).count("<redacted>") == 1


def test_archives(tmp_path):
    for names in ((), ("a.csv", "b.CSV")):
        p = tmp_path / f"n{len(names)}" / "x.zip"
        p.parent.mkdir()
        p.write_bytes(zipped("a\n1\n", names))
        with pytest.raises(SourceError):
            extract_csv(p)
    p = tmp_path / "slip" / "x.zip"
    p.parent.mkdir()
    p.write_bytes(zipped("a\n1\n", ("../../evil.csv", "readme.txt", "dir/")))
    assert extract_csv(p) == tmp_path / "slip/extracted/evil.csv"
    p.with_name("y.zip").write_text("no")
    with pytest.raises(SourceError):
        extract_csv(p.with_name("y.zip"))


def test_gate(store, tmp_path):
    _put(store, "sep_base", [(D(2026, 1, 2), "A", 1.0)], SEP)
    _put(store, "daily", [(D(2026, 1, 3), "A", D(2026, 1, 3))], "date date, ticker string, lastupdated date")
    csv = "ticker,lastupdated,firstadded,firstpricedate,lastpricedate,firstquarter,lastquarter,name\nA,2026-01-03,,,,,,Apple\n"
    src = Source({"SEP": ["2026-01-03"], "DAILY": []}, {"SEP": ["date,ticker,close\n2026-01-03,A,2.0\n"]}, {"TICKERS": csv})
    out = run_gate(_sync(store, src, tmp_path), ["SEP", "DAILY", "TICKERS"])
    assert out["passed"] and not out["blockers"] and out["calendar"]["status"] == "updated"
    out = run_gate(_sync(store, Source(), tmp_path), ["TICKERS"], reference_policy="report")
    assert out["blockers"] == ["TICKERS requires reference refresh before model use"]
    late = Result("DAILY", "daily", "incremental", "up_to_date", D(2026, 1, 1), D(2026, 1, 5))
    assert assess(late, SOURCES["DAILY"], 1) == ["DAILY is 4 day(s) behind API max 2026-01-05; allowed lag is 1"]
    assert assess(Result("SEP", "sep_base", "incremental", "needs_update"), SOURCES["SEP"]) == ["SEP: needs_update, nothing was loaded", "SEP: no dates in the store"]
    assert assess(Result("INDICATORS", "indicators", "full", "download_failed"), SOURCES["INDICATORS"]) == ["INDICATORS: the run ended with download_failed", "INDICATORS: no such table in the store"]
    with pytest.raises(ValueError):
        run_gate(_sync(store, src, tmp_path), [], -1)


def test_audit_and_prune(store):
    _put(store, "sfp", [("A", D(2026, 1, 2), D(2026, 1, 2), 1.0), ("B", D(2026, 1, 5), D(2026, 1, 5), 1.0)], "ticker string, date date, lastupdated date, close double")
    _put(store, "sep_base", [(D(2026, 1, 2), "A", 1.0), (D(2026, 1, 2), "A", 2.0)], SEP)
    _put(store, "my_panel", [("A",)], "ticker string")
    rows = {r.table_name: r for r in audit(store).collect()}
    assert len(rows) == 15 and (rows["sfp"].min_date, rows["sfp"].max_date, rows["sfp"].distinct_entities) == (D(2026, 1, 2), D(2026, 1, 5), 2)
    assert not rows["daily"].present and rows["daily"].n_rows is None
    assert audit_duplicates(store) == {"sep_base": 1, "daily": None} and ("sfp", "close", "double") in audit_catalog(store)
    assert prune(store) == ["my_panel"] and store.exists("my_panel")
    with pytest.raises(PermissionError):
        prune(store, protected=("db",))
    assert prune(store, dry_run=False) == ["my_panel"] and store.tables() == ["sep_base", "sfp"]


def test_command_line(store, tmp_path, monkeypatch, capsys):
    monkeypatch.delenv("QUILLON_API_KEY", raising=False)
    assert cli.main(["sync", "--db", store.root], spark=store.spark) == 1
    monkeypatch.setenv("QUILLON_API_KEY", "k")
    src = Source({"SEP": ["2026-01-03"]}, {"SEP": ["date,ticker,close\n2026-01-03,A,1.0\n"]})
    assert cli.main(["sync", "--db", store.root, "--tables", "SEP"], src, store.spark) == 0
    assert cli.main(["gate", "--db", store.root, "--tables", "SEP", "--check-only"], Source({"SEP": []}), store.spark) == 0
    assert cli.main(["audit", "--db", store.root], spark=store.spark) == 0
    assert cli.main(["prune", "--db", store.root, "--dry-run"], spark=store.spark) == 0
    assert "Objects to drop: 0" in capsys.readouterr().out
    with pytest.raises(PermissionError):
        cli.main(["prune", "--db", store.root, "--protect", "db"], spark=store.spark)
    monkeypatch.setenv("QUILLON_PROTECTED", "other db")
    with pytest.raises(PermissionError):
        cli.main(["prune", "--db", store.root], spark=store.spark)
    with pytest.raises(SystemExit):
        cli.main(["gate", "--db", store.root, "--max-staleness-days", "-1"])


def _stream(spark, store, tmp_path, name):
    from quillon.streaming import ingest

    src = tmp_path / "in"
    put = lambda rows: spark.createDataFrame(rows, SEP).coalesce(1).write.mode("append").parquet(str(src))
    run = lambda: ingest(spark.readStream.schema(SEP).option("maxFilesPerTrigger", 1).parquet(str(src)), store, SOURCES[name], str(tmp_path / "cp")).awaitTermination()
    return put, run


def test_streaming_keeps_rows_of_one_date_in_two_batches(spark, store, tmp_path):
    put, run = _stream(spark, store, tmp_path, "SEP")
    _put(store, "sep_base", [(D(2031, 3, 3), "QLN", 1.0)], SEP)
    put([(D(2031, 3, 4), "QLN", 2.0), (D(2031, 3, 3), "RRB", 9.0)])
    put([(D(2031, 3, 4), "RRB", 3.0)])
    run()
    put([(D(2031, 3, 4), "INK", 4.0)])
    run()
    run()
    assert _rows(store, "sep_base") == [(D(2031, 3, 3), "QLN", 1.0), (D(2031, 3, 4), "INK", 4.0), (D(2031, 3, 4), "QLN", 2.0), (D(2031, 3, 4), "RRB", 3.0)]


def test_a_replayed_batch_changes_nothing(spark, store):
    from quillon.streaming import merge

    batch = spark.createDataFrame([(D(2031, 3, 4), "QLN", 2.0)], SEP)
    for name in ("SEP", "SF2"):
        spec = SOURCES[name]
        for n in (0, 0, 1, 1, 0):
            merge(batch.withColumnRenamed("date", spec.watermark), n, "a query", store, spec)
        assert store.rows(spec.table) == 2 and merge(batch.withColumnRenamed("date", spec.watermark), 0, "another", store, spec)


def test_policy_schemas_parse(spark):
    from quillon.sources import schemas

    for t in schemas.tables():
        assert spark.createDataFrame([], schemas.schema(t)).columns


def test_policy_files_are_read_in_their_schema(spark, tmp_path):
    from quillon.operators.signals import PUBLIC_DATES, stackable, with_public_date
    from quillon.sources import schemas

    rows = [("a1", "Acme", None, "ACM", "DoD", None, "grant", D(2031, 3, 1), None, 5, None, "x, \"y\""), ("a2", "Acme", None, "ACM", "DoD", None, "grant", D(2031, 3, 1), D(2031, 3, 9), 7, None, None)]
    df = spark.createDataFrame(rows, schemas.schema("federal_awards").replace("decimal(18,2)", "int")).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    for kind in ("parquet", "json", "csv"):
        df.write.format(kind).option("header", True).save(f"{tmp_path}/{kind}")
        got = schemas.read(spark, "federal_awards", f"{tmp_path}/{kind}", kind)
        assert got.schema.simpleString() == df.schema.simpleString() and got.count() == 2
    assert {r.public_date for r in with_public_date(got, "federal_awards").collect()} == {D(2031, 3, 1), D(2031, 3, 9)}
    assert all(set(v) <= set(spark.createDataFrame([], schemas.schema(k)).columns) for k, v in PUBLIC_DATES.items())
    folds = spark.createDataFrame([(0, D(2030, 12, 31), D(2031, 4, 1), D(2031, 4, 30)), (1, D(2031, 1, 31), D(2031, 5, 1), D(2031, 5, 31))], "fold int, train_end date, test_start date, test_end date")
    made = spark.createDataFrame([(0, D(2031, 4, 2)), (0, D(2030, 12, 1)), (0, D(2031, 5, 2)), (1, D(2031, 5, 2)), (7, D(2031, 5, 2))], "fold int, prediction_date date")
    assert sorted(map(tuple, stackable(made, folds).collect())) == [(0, D(2031, 4, 2)), (1, D(2031, 5, 2))]
