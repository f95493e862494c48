from helpers import rows_of, sql_rows
from quillon.llm import decontaminate as D

ITEM = "one two three four five six seven eight nine ten eleven twelve"


def _found(spark, docs, items):
    df = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id, r.n_shared, r.n_item_shingles) for r in D.contaminated(docs, df).collect())


def test_finds_items_in_long_texts_and_partial_ones(spark, docs_of):
    filler = " ".join(f"f{k}" for k in range(5000))
    part = " ".join(ITEM.split()[:10])  # 6 of 8 shingles: three quarters
    less = " ".join(ITEM.split()[:9])
    docs = docs_of([(1, f"{filler} {ITEM.upper()}\n{filler}"), (2, f"{filler} {part} {filler}"), (3, f"{filler} {less} {filler}"), (4, None), (5, ""), (6, "Short\titem"), (7, "a short item"), (None, ITEM), (8, filler)])
    got = _found(spark, docs, [(10, ITEM), (11, "short item"), (12, None), (13, ""), (None, ITEM)])
    assert got == [(1, 10, 8, 8), (2, 10, 6, 8), (6, 11, 1, 1)]


def test_repeats_ties_and_empty_tables(spark, docs_of):
    docs = docs_of([(1, ITEM), (1, ITEM), (2, ITEM + " " + ITEM)])
    assert _found(spark, docs, [(10, ITEM), (10, ITEM), (11, ITEM)]) == [(d, i, 8, 8) for d in (1, 2) for i in (10, 11)]
    assert _found(spark, docs, []) == [] and _found(spark, docs_of([]), [(10, ITEM)]) == []
    assert D.contaminated(docs_of([]), spark.createDataFrame([], "item_id long, text string")).columns == ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"]


def test_shuffled_join_gives_the_same(spark, docs_of, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(D, "small", lambda df, n, bound=0: df)
    assert _found(spark, docs_of([(1, ITEM), (2, "x y z a b c")]), [(10, ITEM)]) == [(1, 10, 8, 8)]


def test_equals_sql(spark, sf_dir):
    names, want = sql_rows(D.OP1_SQL)
    got = D.op1_decontaminate(spark, sf_dir)
    assert sorted(got.columns) == names and rows_of(got) == want


def test_stage(spark, docs_of, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()
    df = docs_of([(1, f"before {item.text} after"), (2, "clean words only in this one"), (None, "x")])
    out = D.decontaminate_stage(spark, df, sf_dir)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["2", "None"]


def test_stage_judges_rows_not_ids(spark, docs_of, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    df = docs_of([(None, item), (None, "clean words only in this one"), (None, None), (7, f"before {item}"), (7, "clean too"), (7, "clean too"), (8, "and this")])
    out = D.decontaminate_stage(spark, df, sf_dir)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (0, "clean words only in this one"), (7, "clean too"), (7, "clean too"), (8, "and this")]


def test_no_python_in_the_plan(spark, sf_dir):
    w = D._sets(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", False)
    assert "Python" not in w._jdf.queryExecution().toString() and "Arrow" not in w._jdf.queryExecution().toString()
