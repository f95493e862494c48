import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import pii, registry, toxicity
from quillon.llm.common import table, text_blocks
from quillon.llm.near_dedup import link_components
from quillon.llm.packing import CAPACITY
from .test_near_dedup import brute as near_brute
from .test_packing_counts_chat import _slow_fit
from .test_pii import brute as spans_of


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        last = k == len(corpus_pipeline.STAGES) - 1
        assert last or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        nxt = spark.read.parquet(f"{tmp_path}/{k}")
        now = {r.doc_id for r in nxt.select("doc_id").distinct().collect()}
        assert now <= ids
        if name == "near_dedup":
            assert link_components(nxt).where("not kept").count() == 0 and len(now) < len(ids)
        if name in ("pii", "packing"):
            assert now == ids
        ids, docs = now, nxt
    assert docs.agg(F.max("n_tokens")).first()[0] <= 2048
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, docs.collect()))


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _redacted(texts):
    """Candidates of all texts one by one, labelers weighed ballot by ballot, spans replaced from the end."""
    found = {i: pii._candidates(t or "", spans_of(t or "")) for i, t in texts.items()}
    ballots = collections.defaultdict(list)
    for i, own in found.items():
        for s, k, e, strict in own:
            ballots[k].append(pii.votes(texts[i], s, k, e, strict))
    chosen = set()
    for k, own in ballots.items():
        q, _ = pii.reliabilities(np.array([[v + 1 for v in b] for b, _ in own]), np.ones(len(own)))
        bits = np.array([x for _, x in own])
        weights = pii.classifier(bits, q, np.ones(len(own)))
        chosen |= {(k, int(x)) for x in set(bits.tolist()) if weights[0] + sum(weights[1 + j] * (x >> j & 1) for j in range(8)) >= 0}
    out = {}
    for i, t in texts.items():
        keep = sorted((s, k, e) for s, k, e, strict in found[i] if strict or (k, pii.votes(t, s, k, e, False)[1]) in chosen)
        merged = []
        for s, k, e in keep:  # spans that overlap are one, named by the first
            if merged and s < merged[-1][2]:
                merged[-1] = (*merged[-1][:2], max(e, merged[-1][2]))
            else:
                merged.append((s, k, e))
        for s, k, e in reversed(merged):
            t = t[:s] + f"[{pii.KINDS[k].upper()}]" + t[e:]
        out[i] = t
    return out


def test_run_equals_brute_force(spark, sf_dir):
    """Every decision made document by document; the fitted model alone is shared with the pipeline."""
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    source = {r.doc_id: r.source for r in table(spark, sf_dir, "documents").collect()}
    judge = toxicity.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).load()
    toxic = {i for i, t in texts.items() for _, _, d, o in text_blocks(pa.array([t or ""])) if judge(d, o)[0] >= 0.5}
    texts = {i: t for i, t in texts.items() if i not in toxic}
    comps, _ = near_brute(list(texts.items()))
    texts = {i: t for i, t in texts.items() if comps[i] == i}
    items = [x for r in table(spark, sf_dir, "benchmark").collect() if (x := _shingles(r.text))]
    texts = {i: t for i, t in texts.items() if not any(100 * len(x & _shingles(t)) >= 75 * len(x) for x in items)}
    texts = _redacted(texts)
    lengths = {i: len((t or "").split()) + 1 for i, t in texts.items()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    total = collections.Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert dict(total) == lengths
    rest = sorted((r for r in got if r.n_tokens < CAPACITY), key=lambda r: (-r.n_tokens, r.doc_id))
    words = {i: " ".join((t or "").lower().split()) for i, t in texts.items()}
    number = {x: k for k, x in enumerate(dict.fromkeys([*map(str, source.values()), *words.values()]))}
    bins = _slow_fit([(r.n_tokens, number[str(source[r.doc_id])], number[words[r.doc_id]]) for r in rest], CAPACITY)
    assert len({r.shard for r in got}) == 1 and len(set(bins)) == len({r.bin for r in rest})


def test_run_on_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, repeats, long and empty texts, an empty table, and columns named as the operators' own."""
    for name in ("labels", "benchmark"):
        table(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    clash = ["w", "h", "s", "rep", "row", "held_out", "cluster", "score", "key", "bin", "component", "n", "doc", "kind", "spans"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [(i, t, None, s, None, *["x"] * len(clash)) for i, t, s in [(1, None, None), (1, "", "a"), (None, "mail a@b.example.com", "a"), (2, long, "a"), (3, long, "b"), (3, "b c", None), (4, "mail a@b.example.com " * 3, "a"), (None, None, None)]]
    for some in (rows, []):
        path = f"{tmp_path}/{len(some)}"
        spark.createDataFrame(some, schema).write.parquet(f"{path}/documents.parquet")
        for name in ("labels", "benchmark"):
            table(spark, str(tmp_path), name).write.parquet(f"{path}/{name}.parquet")
        got = corpus_pipeline.run(spark, path).collect()
        assert {r.doc_id for r in got} == ({1, 2, 4, None} | ({3} if any(r.doc_id == 3 for r in got) else set()) if some else set())
        own = table(spark, path, "documents")
        for name, query in registry.queries().items():
            if name not in ("op4_chat_format", "op5_token_counts", "op8_best_fit_packing", "op1_decontaminate"):
                assert query(spark, path).count() == own.count(), name
            elif name != "op4_chat_format":
                assert query(spark, path).count() >= 0


def test_registered_queries():
    names = sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)] and set(registry.oracle_sql()) <= set(names)
