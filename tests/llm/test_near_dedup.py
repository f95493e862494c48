import random

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import near_dedup as N
from quillon.llm.common import shingle_sets, table


def brute(rows):
    """doc_id -> component by comparing every pair of shingle sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def check(df, rows):
    got = N.link_components(df).collect()
    comps, sizes = brute(rows)
    assert {r.doc_id: r.component_id for r in got} == comps
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_edges(docs_of):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "A B\nC"), (6, "a b c d"), (7, long), (8, long + " tail"), (9, "é ü ö ä ß x"), (10, "É ü ö ä ß x"), (11, "a b c d e"), (12, "a  b c d\te")]
    check(docs_of(rows), rows)


def test_empty_table_and_null_ids(docs_of):
    assert N.link_components(docs_of([])).count() == 0
    got = N.link_components(docs_of([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False)]


def test_chains_copies_and_shared_passages(docs_of, monkeypatch):
    """Small buckets are exceeded, so refinement and rounds are taken too."""
    monkeypatch.setattr(N, "SMALL_BUCKET", 3)
    r = random.Random(5)
    word = lambda: f"x{r.randrange(4000)}"
    passage = [word() for _ in range(80)]
    base = [word() for _ in range(120)]
    rows, k = [], 0
    for _ in range(40):  # near copies of one text, each changed at some places
        w = list(base)
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = word()
        rows.append((k := k + 1, " ".join(w)))
    for _ in range(30):  # a passage that otherwise unlike texts share
        rows.append((k := k + 1, " ".join([word() for _ in range(60)] + passage + [word() for _ in range(60)])))
    w = [word() for _ in range(100)]
    for _ in range(12):  # a chain: neighbours are linked, its ends are not
        w = w[4:] + [word() for _ in range(4)]
        rows.append((k := k + 1, " ".join(w)))
    rows += [(k := k + 1, rows[3][1]) for _ in range(20)]
    r.shuffle(rows)
    check(docs_of(rows), rows)


@pytest.mark.parametrize("m", [26, 150])
def test_short_text_and_its_extensions_that_share_one_band(docs_of, m):
    """The text's three shingles lie in two bands, so some extensions, which are linked by it only, share just one."""
    used = lambda t: {int(b) // N.ROWS for b in np.flatnonzero(N.registers(next(shingle_sets(pa.array([t])))[2][0]) != N.EMPTY)}
    hub = next(t for k in range(1000) if len(used(t := f"h{k} a b c d e f")) == 2)
    more = [t for k in range(5000) if len(used(t := f"{hub} x{k}")) == 2][: m // 2]
    rows = [(k, t) for k, t in enumerate(more + [f"{hub} y{k}" for k in range(m - len(more))])] + [(9999, hub)]
    check(docs_of(rows), rows)


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    check(docs, [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()])


def test_estimate_is_close_and_corrected():
    rng = np.random.default_rng(1)
    errors = []
    for j in (0.0, 0.3, 0.75, 0.9):
        for _ in range(20):
            n = 600
            both = int(round(2 * n * j / (1 + j)))
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
            est, spread = N.estimate(N.fine_registers(a)[None], N.fine_registers(b)[None], np.array([n]), np.array([n]))
            assert spread[0] < 0.03
            errors.append(est[0] - j)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in N.components(links).collect()}
    assert all(got[k] == 1 for k in range(2, 61)) and got[101] == 100


def test_stage_keeps_columns_and_one_of_each_group(spark, docs_of):
    df = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words are here now"), (4, None)])
    out = N.near_dedup_stage(spark, df, "")
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_stage_judges_rows_not_ids(spark, docs_of):
    """Rows without an id, or with a shared one: one of each group stays, that with an id of its own if there is one."""
    a, b, c, d = "a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x"
    df = docs_of([(None, a), (5, a), (9, a), (None, b), (None, b), (7, c), (7, d), (7, d), (8, c), (None, None), (None, ""), (7, " ")])
    out = N.near_dedup_stage(spark, df, "")
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert out.columns == df.columns and got == [(0, ""), (0, ""), (0, b), (5, a), (7, " "), (7, d), (8, c)]


@pytest.mark.parametrize("text", ["", "word", "a b c d e f g"])
def test_registers_of_few_shingles(text):
    import pyarrow as pa

    (_, _, sets), = N.shingle_sets(pa.array([text]))
    assert (N.registers(sets[0]) != N.EMPTY).sum() <= max(0, len(text.split()))


def test_few_links_make_few_files(spark, docs_of, monkeypatch):
    """However many partitions hold them: a task that writes a file starts processes beside its executor."""
    files, real = {}, N.materialize

    def noted(df, name, *rest):
        out = real(df, name, *rest)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(N, "materialize", noted)
    r = random.Random(11)
    rows = []
    for k in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(80)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-1]))]
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        check(docs_of(rows), rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    most = spark.sparkContext.defaultParallelism
    assert files["links"] <= most and files["components"] <= most
