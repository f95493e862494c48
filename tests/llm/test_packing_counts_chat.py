import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from helpers import rows_of, sql_rows
from quillon.llm import chat_format as C
from quillon.llm import packing as K
from quillon.llm import token_counts as N


def _slow_fit(items, capacity):
    bins = []
    out = []
    for n, s, c in items:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and s not in b["s"] and c not in b["c"]]
        if fits:
            k = min(fits)[1]
        else:
            bins.append({"left": capacity, "s": set(), "c": set()})
            k = len(bins) - 1
        bins[k]["left"] -= n
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
        out.append(k)
    return out


def test_best_fit_equals_brute_force():
    r = random.Random(1)
    for _ in range(60):
        items = sorted(((r.randrange(1, 50), r.randrange(4), r.randrange(12)) for _ in range(r.randrange(60))), reverse=True)
        assert K.best_fit(items, 100) == _slow_fit(items, 100)


def _check(out, docs, capacity):
    lengths = {}
    for r in docs:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + len((r["text"] or "").split()) + 1
    by_doc, by_bin = {}, {}
    for r in out:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.n_tokens
        by_bin.setdefault((r.shard, r.bin), []).append(r)
    assert by_doc == lengths
    source = {r["doc_id"]: r["source"] for r in docs}
    for rows in by_bin.values():
        assert sum(r.n_tokens for r in rows) <= capacity and len({source[r.doc_id] for r in rows}) == len(rows)


def test_packing(spark):
    r = random.Random(2)
    rows = [(k, " ".join(f"w{r.randrange(99)}" for _ in range(r.choice([0, 3, 20, 64, 65, 400]))), r.choice(["a", "a", "b", None, "c"])) for k in range(300)]
    rows += [(1000 + k, "same words", "s%d" % k) for k in range(20)] + [(2000, None, "x"), (2001, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bin", F.lit("clash"))
    out = K.packed(df, 64, 100).collect()
    _check(out, [x.asDict() for x in df.collect()], 64)
    copies = [(x.shard, x.bin) for x in out if 1000 <= x.doc_id < 1020]
    assert len(set(copies)) == 20
    pieces = sorted((x.piece, x.start, x.n_tokens) for x in out if x.doc_id == next(i for i, t, _ in rows if len(t.split()) == 400))
    assert pieces == [(p, 64 * p, 64 if p < 6 else 17) for p in range(7)]


def test_packing_edges(spark):
    schema = "doc_id long, text string, source string"
    assert K.packed(spark.createDataFrame([], schema)).count() == 0
    twice = K.packed(spark.createDataFrame([(None, "a b", "x"), (None, "a b", "x"), (1, "c", None), (1, "c", None)], schema)).collect()
    assert len(twice) == 4 and len({(x.shard, x.bin) for x in twice if x.doc_id is None}) == 2
    given = spark.createDataFrame([(1, "a", "x", 7), (2, "b", "y", 7), (3, "c", "z", 8)], schema + ", cluster long")
    bins = {x.doc_id: x.bin for x in K.packed(given, cluster="cluster").collect()}
    assert bins[1] != bins[2]
    assert len({x.bin for x in K.packed(given).collect()}) == 1  # a column of that name is no cluster unless it is named
    hot = spark.createDataFrame([(5, f"w{k}", f"s{k}") for k in range(400)], schema)
    shards = [x["count"] for x in K.packed(hot, 64, 20).groupBy("shard").count().collect()]
    assert len(shards) == 20 and max(shards) < 60


def test_packing_whole_table(spark, sf_dir):
    docs = [x.asDict() for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    _check(K.op8_best_fit_packing(spark, sf_dir).collect(), docs, K.CAPACITY)


@pytest.fixture
def rollup(spark, tmp_path):
    return N.Rollup(spark, f"file://{tmp_path}/rollup")


def _batch(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, version string, source string, lang string, n_tokens long, n_chars long, op string")


def _totals(rollup):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens, r.n_chars) for r in rollup.totals().collect()}


def test_rollup_follows_inserts_revisions_and_deletes(spark, rollup):
    """Against recounting everything after each batch."""
    r = random.Random(6)
    state = {}
    for b in range(5):
        rows = []
        for d in r.sample(range(40), 15):
            op = r.choice(["insert", "revise", "delete"])
            row = (d, r.choice("vw"), r.choice("ab"), r.choice(["en", None]), r.randrange(1, 100), r.randrange(1, 500), op)
            rows.append(row)
            if op == "delete":
                state.pop((d, row[1]), None)
            else:
                state[d, row[1]] = row[2:6]
        assert rollup.commit(f"b-{b}", _batch(spark, rows)) and not rollup.commit(f"b-{b}", _batch(spark, rows))
        want = {}
        for (_, v), (s, la, n, c) in state.items():
            x = want.get((s, la, v), (0, 0, 0))
            want[s, la, v] = (x[0] + 1, x[1] + n, x[2] + c)
        assert _totals(rollup) == want


def test_rollup_edges(spark, rollup):
    assert _totals(rollup) == {}
    rows = [(None, "v", "a", "en", 5, 9, "insert"), (None, "v", "a", "en", 5, 9, "insert"), (None, "v", "a", "en", 5, 9, "delete"), (1, "v", None, None, 1, 1, "insert"), (1, "v", None, None, 2, 2, "insert"), (9, "v", "a", "en", 0, 0, "delete")]
    assert rollup.commit("x", _batch(spark, rows))
    assert _totals(rollup) == {("a", "en", "v"): (2, 10, 18), (None, None, "v"): (1, 2, 2)}
    assert rollup.commit("empty", _batch(spark, [])) and len(rollup.batches()) == 2


def test_compaction_keeps_totals_states_and_ids(spark, rollup, tmp_path):
    """A rollup that is compacted after every second batch against one that never is."""
    plain, r = N.Rollup(spark, f"file://{tmp_path}/plain"), random.Random(9)
    rollup.compact()
    for b in range(5):
        rows = [(d, "v", r.choice("ab"), r.choice(["en", None]), r.randrange(1, 100), r.randrange(1, 500), r.choice(["insert", "revise", "delete"])) for d in r.sample(range(20), 9)]
        for own in (rollup, plain):
            assert own.commit(f"b-{b}", _batch(spark, rows))
        if b % 2:
            rollup.compact()
            rollup.compact()
            assert rollup.batches() == [] and not rollup.commit(f"b-{b}", _batch(spark, rows)) and not rollup.commit("b-0", _batch(spark, rows))
            held = rollup._read("ledger", rollup._LEDGER).collect()
            assert len({x.doc_id for x in held}) == len(held) and all(x.live for x in held)
        assert _totals(rollup) == _totals(plain)
    assert len([x for x in (tmp_path / "rollup").iterdir() if x.name.startswith(("base-", "batch-"))]) == 2


def test_a_staged_batch_does_not_count(spark, rollup, tmp_path):
    rollup.commit("a", _batch(spark, [(1, "v", "a", "en", 5, 9, "insert")]))
    rollup.totals().write.parquet(f"{tmp_path}/rollup/staged-{uuid.uuid4().hex}/delta")
    assert _totals(rollup) == {("a", "en", "v"): (1, 5, 9)}


def test_token_counts_round_trip(spark, sf_dir, docs_of):
    e = N.encoder(N.VERSION, N.TOKENIZERS)
    texts = [None, "", "Hello  world's\n\n tokens 123!", "é" * 3000, "<|endoftext|>"]
    got = {r.doc_id: r for r in N.token_counts(docs_of(list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        ids = e.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids) and e.decode(ids) == (t or "") and got[k].n_chars == len(t or "")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "text").collect()
    want = {}
    for r in rows:
        x = want.get((r.source, r.lang, N.VERSION), (0, 0, 0))
        want[r.source, r.lang, N.VERSION] = (x[0] + 1, x[1] + len(e.encode_ordinary(r.text or "")), x[2] + len(r.text or ""))
    assert {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens, r.n_chars) for r in N.op5_token_counts(spark, sf_dir).collect()} == want


def _tools(spark):
    return spark.createDataFrame([("add", "a", "integer", True), ("add", "b", "number", False), ("say", "text", "string", True)], "tool string, param string, type string, required boolean")


def _call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, **({"depends_on": d} if d else {})} for i, n, a, d in calls]})


def test_tool_calls(spark):
    turns = [
        (1, 0, "user", "hi \"there\"\n"), (1, 1, "assistant", _call(("c1", "add", {"b": 1.5, "a": 2}, None))), (1, 2, "tool", '{ "tool_call_id": "c1", "content": {"z": 1, "a": [1, 2]} }'),
        (1, 3, "assistant", _call(("c2", "say", {"text": 5, "x": 1}, ["c1", "nope"]), ("c3", "fly", {}, None))), (1, 4, "tool", '{"tool_call_id": "ghost", "content": "?"}'),
        (1, 5, "assistant", _call(("c1", "add", {"a": 1}, None))), (1, 6, None, None), (1, 7, "assistant", '{"tool_calls": broken'),
        (2, 0, "tool", '{"tool_call_id": "late", "content": 1}'), (2, 1, "assistant", _call(("late", "add", {}, None))),
        (3, 0, "assistant", _call(("p", "add", {"a": 1}, ["q"]))), (3, 1, "assistant", _call(("q", "add", {"a": 1}, ["p"]))),
        (4, 0, "assistant", _call(("second", "add", {"a": 1}, ["first"]))), (4, 1, "assistant", _call(("first", "add", {"a": 1}, None))), (4, 2, "tool", '{"tool_call_id": "first", "content": 1}'),
        (None, None, "user", "lost"), (1, 0, "user", "hi \"there\"\n"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("json", F.lit("clash"))
    got = C.formatted(df, _tools(spark)).collect()
    assert len(got) == len(turns)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].status == "linked" and by[1, 2].status == "result" and by[1, 1].errors == []
    assert by[1, 2].json == '{"message":{"content":{"a":[1,2],"z":1},"tool_call_id":"c1"},"role":"tool"}'
    assert by[1, 1].json == '{"message":{"tool_calls":[{"arguments":{"a":2,"b":1.5},"id":"c1","name":"add"}]},"role":"assistant"}'
    assert by[1, 3].status == "unanswered" and by[1, 3].errors == ["type:text", "unexpected:x", "unknown_dependency:nope", "unknown_tool:fly"] and by[1, 3].level == 1
    assert by[1, 4].status == "orphan_result" and by[1, 5].errors == ["duplicate_id:c1"]
    assert by[1, 6].status == by[1, 7].status == by[None, None].status == "message" and by[1, 6].json == "{}"
    assert by[2, 1].errors == ["missing:a"] and by[2, 0].anchor == 1 and by[2, 0].is_result
    assert by[3, 0].status == by[3, 1].status == "cycle"
    order = sorted((r for r in got if r.conv_id == 4), key=lambda r: (r.anchor, r.level, r.is_result, r.turn))
    assert [r.turn for r in order] == [1, 2, 0]
    assert json.loads(by[1, 0].json) == {"content": "hi \"there\"\n", "role": "user"}


def _slow_chat(turns):
    """(conv, turn) -> (status, anchor, level) of turns with one call or result each, by walking each dependency."""
    call, answers = {}, {}
    for conv, turn, _, text in turns:
        x = json.loads(text)
        for c in x.get("tool_calls", []):
            if (conv, c["id"]) not in call or call[conv, c["id"]][0] > turn:
                call[conv, c["id"]] = (turn, c)
        if "tool_call_id" in x:
            key = (conv, x["tool_call_id"])
            answers[key] = max(turn, answers.get(key, turn))

    def place(key, above=()):
        """(anchor, level) of a call, or None if it leads to a cycle."""
        if key in above:
            return None
        turn, c = call[key]
        deps = [place((key[0], d), (*above, key)) for d in c.get("depends_on", []) if (key[0], d) in call]
        if None in deps:
            return None
        ends = [max(p[0], answers.get((key[0], d), p[0])) for p, d in zip(deps, [d for d in c.get("depends_on", []) if (key[0], d) in call], strict=True)]
        return max([turn, *ends]), max([-1, *(p[1] for p in deps)]) + 1

    out = {}
    for conv, turn, _, text in turns:
        x = json.loads(text)
        key = (conv, x["tool_call_id"] if "tool_call_id" in x else x["tool_calls"][0]["id"])
        if "tool_call_id" in x:
            at = place(key) if key in call else None
            out[conv, turn] = ("result", max(turn, at[0] if at else call[key][0]), at[1] if at else 0) if key in call else ("orphan_result", turn, 0)
        else:
            first = call[key][0] == turn
            at = place(key) if first else None
            out[conv, turn] = ("cycle", turn, 0) if first and not at else ("linked" if first and key in answers else "unanswered", at[0] if at else turn, at[1] if at else 0)
    return out


def test_linking_equals_brute_force_on_random_graphs(spark):
    r = random.Random(12)
    turns = []
    for conv in range(12):
        names = [f"c{k}" for k in range(r.randrange(1, 9))]
        order = [("call", n) for n in names] + [("result", r.choice([*names, "ghost"])) for _ in range(r.randrange(8))]
        r.shuffle(order)
        for turn, (kind, n) in enumerate(order):
            deps = [x for x in names if x != n and r.random() < 0.25]
            text = _call((n, "add", {"a": 1}, deps)) if kind == "call" else json.dumps({"tool_call_id": n, "content": turn})
            turns.append((conv, turn, "assistant" if kind == "call" else "tool", text))
    turns += [(90, k, "assistant", _call((f"d{k}", "add", {"a": 1}, [f"d{k + 1}"] if k < 24 else None))) for k in range(25)]  # a long chain, last first
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.turn): (x.status, x.anchor, x.level) for x in C.formatted(df, _tools(spark)).collect()}
    assert got == _slow_chat(turns)


def test_chat_without_calls_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert C.formatted(spark.createDataFrame([], schema), _tools(spark)).count() == 0


def test_chat_equals_sql(spark, sf_dir):
    names, want = sql_rows(C.OP4_SQL)
    got = C.op4_chat_format(spark, sf_dir)
    assert sorted(got.columns) == names and rows_of(got) == want
