import collections
import math
import random
import re
import struct
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillon.llm import quality_classifier as C
from quillon.llm import quality_rules as R
from quillon.llm.common import table, text_blocks


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    at = collections.defaultdict(list)
    for j in range(len(w) - 4):
        at[tuple(w[j : j + 5])].append(j)
    covered = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)


EDGES = [None, "", " \n\t", "a", "a b a b a b a b a b a b", "x y z v w\nx y z v w\n\n \nx y z v w ", "#*$%&|<> é ü z", "one two three four five " * 3 + "six", "\n\n", "ab\rab\r\nab", "'quote' \"x\" \\n a,b"]


def _trusted(spark):
    return spark.createDataFrame([(0,)], "doc_id long")


def test_rules_base_counts(spark, docs_of):
    r = random.Random(3)
    texts = EDGES + ["".join(r.choice("ab #\n\t") for _ in range(r.randrange(300))) for _ in range(150)]
    rows = list(enumerate(texts))
    got = {x.doc_id: x for x in R.judged(docs_of(rows), [0.0] * (2 * R.BUCKETS)).collect()}
    for i, t in rows:
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(t), t
        assert x.kept == (not x.base_failed)


def test_rules_ratio_separates(spark, docs_of):
    good = [(k, " ".join(f"{a}{b}ing" for a in "bdfgk" for b in ("ar", "el", "on")) + f" n{k}") for k in range(40)]
    bad = [(100 + k, " ".join(f"{a}{b}{j}%%%" for j, (a, b) in enumerate(zip("bdfgklmnprst", "aeiouaeiouae", strict=True)))) for k in range(10)]
    docs = docs_of(good + bad)
    ratio = R.ratios(docs, spark.createDataFrame([(k,) for k in range(40)], "doc_id long"))
    got = {x.doc_id: x for x in R.judged(docs, ratio).collect()}
    assert min(got[k].score for k, _ in good) > max(got[k].score for k, _ in bad)
    assert R.ratios(docs_of([]), _trusted(spark)) == [0.0] * (2 * R.BUCKETS)
    assert R.judged(docs_of([]), ratio).count() == 0


def _bucket(word, end=False):
    h = xxhash.xxh64(word[-3:].encode() if end else word.encode(), seed=42).intdigest()
    if end:
        h = xxhash.xxh64(struct.pack("<i", 1), seed=h).intdigest()
    return (h - (1 << 64) if h >> 63 else h) % R.BUCKETS + (R.BUCKETS if end else 0)


def test_rules_score_equals_brute_force(spark, docs_of):
    """Both multinomials counted gram by gram, every document's score and verdict from them."""
    r = random.Random(8)
    make = lambda letters: " ".join(r.choice(letters) + r.choice(["ing", "ER", "é", ""]) for _ in range(r.randrange(8, 60)))
    rows = [(k, make(["stone", "river", "lamp"] if k % 3 else ["$$$", "BUY", "lamp"])) for k in range(60)] + [(None, "stone river lamp " * 5), (7, "a repeated id " * 4), (99, None)]
    trusted = {k for k in range(60) if k % 3 and k % 2}
    raw, target = collections.Counter(), collections.Counter()
    grams = {n: [g for w in (t or "").split() for g in (_bucket(w), _bucket(w, True))] for n, (_, t) in enumerate(rows)}
    for n, (i, _) in enumerate(rows):
        raw.update(grams[n])
        target.update(grams[n] if i in trusted else [])
    size = lambda c, half: sum(v for g, v in c.items() if g // R.BUCKETS == half)
    n_raw, n_target = [size(raw, h) for h in (0, 1)], [size(target, h) for h in (0, 1)]

    def ratio(g):
        h = g // R.BUCKETS
        scale = n_target[h] / n_raw[h]
        return math.log((target[g] + R.PRIOR * scale) / (n_target[h] + R.PRIOR * scale * R.BUCKETS)) - math.log((raw[g] + R.PRIOR) / (n_raw[h] + R.PRIOR * R.BUCKETS))

    docs = docs_of(rows)
    got = R.judged(docs, R.ratios(docs, spark.createDataFrame([(k,) for k in trusted], "doc_id long"))).collect()
    want = []
    for n, (i, t) in enumerate(rows):
        score = float(np.mean([ratio(g) for g in grams[n]])) if grams[n] else 0.0
        want.append((i if i is not None else -1, round(score, 4), not base(t)[-1] and score >= R.LEAST))
    assert sorted((x.doc_id if x.doc_id is not None else -1, round(x.score, 4), x.kept) for x in got) == sorted(want)


def test_rules_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {x.doc_id: x for x in R.op9_quality_rules(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(r.text)
    quality = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    assert all(got[i].kept for i, q in quality.items() if q == 1 and not got[i].base_failed)
    assert not any(got[i].kept for i, q in quality.items() if q == 0)


def _slow(net, text):
    n = max(2, -(-len(text) // C.BLOCK))
    x = np.zeros(n * C.BLOCK + C.WIDTH, np.uint8)
    x[: len(text)] = np.frombuffer(text, np.uint8)
    logits = []
    for c in range(n - 1):
        last = c == n - 2
        stop = (c + 2) * C.BLOCK - (C.WIDTH - 1 if last else 0)
        z = np.array([sum(net.w["filters"][k][x[p + k]] for k in range(C.WIDTH)) for p in range(c * C.BLOCK, stop)])
        logits.append(np.maximum(z.max(0) + net.w["bias"], 0) @ net.w["out"])
    return 1 / (1 + np.exp(-np.clip(np.mean(logits) + net.w["shift"][0], -30, 30)))


def test_network_scores_every_byte_of_every_document():
    net = C.Network(3)
    r = random.Random(1)
    texts = [b"", b"x", bytes(r.randrange(97, 123) for _ in range(511)), bytes(r.randrange(97, 123) for _ in range(512)), bytes(r.randrange(97, 123) for _ in range(513)), bytes(r.randrange(97, 123) for _ in range(9000))]
    got = [p for _, _, d, o in text_blocks(pa.array([t.decode() for t in texts]), 1500) for p in C.scorer(net)(d, o)]
    assert got == pytest.approx([_slow(net, t) for t in texts], abs=1e-4)


def test_network_without_two_classes():
    assert C.Network().fit([], np.zeros(0)).prior == 0.5 and C.Network().fit([b"a"], np.ones(1)).prior == 1.0


def test_classifier_contract(spark, sf_dir):
    got = C.op2_quality_classifier(spark, sf_dir).collect()
    assert len(got) == table(spark, sf_dir, "documents").count()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    label = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    held = [x for x in got if x.held_out and x.doc_id in label]
    assert np.mean([x.predicted == label[x.doc_id] for x in held]) >= 0.85


def test_classifier_edges(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "x"), (3, "y" * 5000), (3, "y" * 5000)])
    net = SimpleNamespace(load=C.Network)
    got = C.score(docs, net).collect()
    assert len(got) == 5 and len({x.score for x in got if x.doc_id in (1, 2)}) == 1
    assert C.score(docs_of([]), net).count() == 0
    assert C.trained(docs, spark.createDataFrame([], "doc_id long, quality int")).load().prior == 0.5
