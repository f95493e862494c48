import collections
import math
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import lm_scoring as L
from quillon.llm import toxicity as T
from quillon.llm.common import table, text_blocks


def _trie(texts):
    grams = np.concatenate([L.byte_grams(d, o)[0] for _, _, d, o in text_blocks(pa.array(texts))])
    return L.Trie([np.unique(grams & ((1 << 8 * (j + 1)) - 1), return_counts=True) for j in range(L.ORDER + 1)])


def _slow_ppm(texts):
    """The model by dictionaries: counts of each context, escapes and exclusions symbol by symbol."""
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        b = b"\xff" * L.ORDER + t.encode().lower() + b"\xff"
        for i in range(L.ORDER, len(b)):
            for k in range(L.ORDER + 1):
                counts[b[i - k : i]][b[i]] += 1

    def log10(context, symbol):
        out, seen = 0.0, set()
        for k in range(L.ORDER, -1, -1):
            own = counts.get(context[L.ORDER - k :])
            if own is None:
                continue
            left = {s: n for s, n in own.items() if s not in seen}
            if symbol in left:
                return out + math.log10((left[symbol] - 0.5) / sum(left.values()))
            if left:
                out += math.log10(0.5 * len(left) / sum(left.values()))
            seen = set(own)
        return out - math.log10(256 - len(seen))

    return log10


def test_ppm_equals_dictionaries_and_sums_to_one():
    r = random.Random(2)
    texts = ["".join(r.choice("abé ") for _ in range(r.randrange(40))) for _ in range(30)] + ["", "The Cat"]
    trie, slow = _trie(texts), _slow_ppm(texts)
    for context in (b"\xff" * L.ORDER, *(x.rjust(L.ORDER, b"b") for x in (b"zzzzz", b"ab ab", b"\xff\xffab", b"e cat"))):
        base = int.from_bytes(context, "big") << 8
        got = trie.log10(np.arange(256) + base)
        assert (10**got).sum() == pytest.approx(1)
        assert got == pytest.approx([slow(context, s) for s in range(256)])


def test_lm_scores(spark, docs_of):
    rows = [(k, t) for k, t in enumerate(["the cat sat", "The dog sat", None, "", "new words here", "the cat sat", "é x"] * 6)] + [(None, "the")]
    got = L.score(docs_of(rows)).collect()
    train = [t or "" for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in [*t.encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    slow = _slow_ppm(train)
    assert len(got) == len(rows)
    text = dict(rows)
    for x in got:
        t = (text[x.doc_id] or "").encode().lower()
        w = [*t.split(), None]
        assert x.held_out == (x.doc_id is None or zlib.crc32(str(x.doc_id).encode()) % 7 == 2)
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(c[k] > 0 for k in w), n)
        assert x.base_score == pytest.approx(sum(math.log10((c[k] + 1) / (n + v + 1)) for k in w))
        b = b"\xff" * L.ORDER + t + b"\xff"
        assert x.score == pytest.approx(sum(slow(b[i - L.ORDER : i], b[i]) for i in range(L.ORDER, len(b))))


def test_lm_small_capacities_keep_the_base_exact(spark, sf_dir, monkeypatch):
    """Rare tokens take the join, and the trie is cut: the base score is the same."""
    docs = table(spark, sf_dir, "documents").limit(60)
    whole = {x.doc_id: x for x in L.score(docs).collect()}
    monkeypatch.setattr(L, "TOKENS", 20)
    monkeypatch.setattr(L, "GRAMS", 500)
    for x in L.score(docs).collect():
        y = whole[x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (y.n_tokens, y.n_known, y.train_tokens)
        assert x.base_score == pytest.approx(y.base_score) and x.score < 0


def test_lm_scores_do_not_depend_on_the_looked_up_grams(spark, docs_of, monkeypatch):
    """Looked up, joined or backed off by joins: each score is that of the whole model."""
    r = random.Random(6)
    rows = [(k, "".join(r.choice("abcé T") for _ in range(r.randrange(60)))) for k in range(80)] + [(None, "a zzzzzz q" * 3), (None, "abc")]
    slow = _slow_ppm([t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2])
    for room in (0, 40, L.GRAMS):
        monkeypatch.setattr(L, "GRAMS", room)
        got = L.score(docs_of([(i, t) for i, t in rows])).collect()
        want = []
        for _, t in rows:
            b = b"\xff" * L.ORDER + t.lower().encode() + b"\xff"
            want.append(sum(slow(b[i - L.ORDER : i], b[i]) for i in range(L.ORDER, len(b))))
        assert sorted(x.score for x in got) == pytest.approx(sorted(want))


def test_lm_empty_table(spark, docs_of):
    assert L.score(docs_of([])).count() == 0
    got = L.score(docs_of([(None, "a b")])).first()  # nothing to learn from
    assert got.n_known == 0 and got.train_tokens == 0 and got.base_score == pytest.approx(0) and got.score == pytest.approx(-4 * math.log10(256))


def test_grams_are_counted_for_bytes_and_ends_only():
    texts = ["ab", "", "é", "a" * 50]
    for block in (1, 10, 1000):
        n = [len(L.byte_grams(d, o)[0]) for _, _, d, o in text_blocks(pa.array(texts), block)]
        assert sum(n) == sum(len(t.encode()) + 1 for t in texts)


INSULTS = ["grunzel", "grunzels", "grunzelish", "blorkhead"]


def _labelled(r, n):
    calm = ["river", "stone", "market", "window", "garden", "letter", "summer", "market's", "bread", "paper"]
    out = []
    for k in range(n):
        w = [r.choice(calm) + r.choice(["", "ing", "er"]) for _ in range(r.randrange(5, 300))]
        if k % 3 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(INSULTS))
        out.append((" ".join(w), int(k % 3 == 0)))
    return out


def test_toxicity_finds_inflected_insults_in_long_texts():
    r = random.Random(4)
    rows = _labelled(r, 300)
    judge = T.Judge([t for t, _ in rows], [y for _, y in rows])
    new = _labelled(r, 90)
    p = np.concatenate([judge(d, o) for _, _, d, o in text_blocks(pa.array([t for t, _ in new]))])
    assert np.mean((p >= 0.5) == np.array([y for _, y in new])) >= 0.95


def test_kneser_ney_is_a_distribution():
    r = random.Random(1)
    texts = ["".join(r.choice("abc ") for _ in range(60)) for _ in range(20)]
    model = T.KneserNey(T.counted(texts[:10]), T.counted(texts[10:]))
    for context in ("a b c", "zzzzz", "     "):
        base = int.from_bytes(context.encode(), "big") << 8
        for c in (0, 1):
            assert np.exp(model.log(c, base + np.arange(256))).sum() == pytest.approx(1)


def test_toxicity_grams_collapse_white_and_signs():
    key, counts = T.grams(*next(text_blocks(pa.array(["A,  b!", "", "..", "c"])))[2:])
    text = [k & 255 for k in key]
    assert bytes(text) == b"a b c" and counts.tolist() == [4, 0, 0, 1]


def test_toxicity_contract(spark, sf_dir):
    got = T.op3_toxicity(spark, sf_dir).collect()
    assert len(got) == table(spark, sf_dir, "documents").count()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)


def test_toxicity_held_out_accuracy(spark, sf_dir):
    """Learned from four fifths of the labels, judged on the rest; clean documents are left alone."""
    labels = {x.doc_id: x.toxic for x in table(spark, sf_dir, "labels").collect()}
    rest = [(x.predicted, labels[x.doc_id]) for x in T.op3_toxicity(spark, sf_dir).collect() if x.held_out and x.doc_id in labels]
    assert len(rest) >= 10 and np.mean([p == y for p, y in rest]) >= 0.95
    assert np.mean([p == 0 for p, y in rest if y == 0]) >= 0.97


def _slow_kneser_ney(ordinary, toxic):
    """log P of a byte after ORDER - 1 bytes in either class, from dictionaries of counts and of who follows what."""
    pad = lambda t: b" " * (T.ORDER - 1) + b" ".join(t.encode().lower().split())
    whole = [collections.Counter(p[i : i + T.ORDER] for t in texts for p in [pad(t)] for i in range(len(p) - T.ORDER + 1)) for texts in (ordinary, toxic)]

    def follow(grams):
        out = collections.Counter()
        for g in set(grams):
            out[g[1:]] += 1
        return out

    levels = []
    for own in whole:
        one = [own]
        while len(next(iter(one[-1]))) > T.SHARED + 1:
            one.append(follow(one[-1]))
        levels.append(one)
    both = set(whole[0]) | set(whole[1])
    shared = []
    for size in range(T.SHARED, 0, -1):
        # Distinct grams one byte longer, of the level above, end in this one.
        up = {g[T.ORDER - size - 1 :] for g in both} if size < T.SHARED else both
        shared.append(collections.Counter(g[-size:] for g in up))

    def log(c, gram):
        def p(k):
            if k == len(levels[c]) + len(shared):
                return 1 / 256
            counts, discount = (levels[c][k], T.DISCOUNT) if k < len(levels[c]) else (shared[k - len(levels[c])], 0.75)
            own = gram[k:]
            after = {g: n for g, n in counts.items() if g[:-1] == own[:-1]}
            total = sum(after.values())
            if not total:
                return p(k + 1)
            return max(after.get(own, 0) - discount, 0) / total + sum(min(n, discount) for n in after.values()) / total * p(k + 1)

        return math.log(p(0))

    return log


def test_kneser_ney_equals_dictionaries():
    r = random.Random(3)
    make = lambda letters: ["".join(r.choice(letters) for _ in range(50)) for _ in range(12)]
    a, b = make("abc "), make("abd ")
    model, slow = T.KneserNey(T.counted(a), T.counted(b)), _slow_kneser_ney(a, b)
    for gram in (b"abc ab", b"     a", b"zzzzza", b"b dab ", b"a b c "):
        key = np.array([int.from_bytes(gram, "big")])
        for c in (0, 1):
            assert model.log(c, key)[0] == pytest.approx(slow(c, gram))


def test_toxicity_edges(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "x"), (3, "y " * 5000), (3, "y")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    judge = T.trained(docs, labels)
    assert judge.load().prior == 0.0 and T.score(docs, judge).count() == 5 and T.score(docs_of([]), judge).count() == 0
    assert T.trained(docs, labels.limit(0)).load().prior == 0.5
    r = random.Random(9)
    rows = _labelled(r, 60)
    full = T.Judge([t for t, _ in rows], [y for _, y in rows])
    scores = [x.score for x in T.score(docs, SimpleNamespace(load=lambda: full)).collect()]
    assert len(scores) == 5 and all(0 <= s < 0.5 for s in scores)
