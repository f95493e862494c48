import hashlib
import random
import re

import numpy as np
import pytest

from quillon.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and P.luhn(digits(m[0]))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15])


@pytest.mark.parametrize("alphabet", ["a1@.+-(2 5%\n", "01234 -.", "+1() 23456.-", "a@b.c@"])
def test_base_spans_equal_the_patterns(alphabet):
    r = random.Random(len(alphabet))
    for _ in range(4000):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
        assert P.base_spans(t) == brute(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "(" * 100_000, "a." * 100_000 + "@"):
        P.base_spans(t)
        P._candidates(t, P.base_spans(t))


def test_luhn():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def test_what_a_neighbour_swallowed_is_added(spark, docs_of):
    rows = [(k, f"call me +1 (826) 555-40{k % 90 + 10} or pay 411111111111111{1} now, mail a{k}@b.example.com") for k in range(60)]
    rows += [(100, "é +1 (826) 555-4081 190.137.25.3"), (101, None), (102, ""), (103, "no data here, version 1.2.3.4.5")]
    got = {r.doc_id: r for r in P.personal(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in brute(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[i].n_phone == sum(k == 3 for _, k, _ in brute(t or "")) and set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    assert got[100].spans == "phone:2:19,ip:20:32" and got[100].n_phone == 0
    assert got[101].spans == got[102].spans == ""


def test_obfuscated_address_in_a_text_without_digits(docs_of):
    texts = ["write to jane [at] corp [dot] com today", "write to jane (at) corp (dot) com today"]
    rows = [(k, texts[k % 2]) for k in range(40)]
    assert all(r.spans == "email:9:33" and r.n_email == 0 for r in P.personal(docs_of(rows)).collect())
    assert {r.text for r in P.redact(docs_of(rows)).collect()} == {"write to [EMAIL] today"}


def test_em_finds_the_careless_labeler():
    r = np.random.default_rng(0)
    truth = r.random(5000) < 0.4
    good = lambda p: np.where(r.random(5000) < p, truth, ~truth)
    ballots = np.column_stack([good(0.95), good(0.9), r.random(5000) < 0.5, good(0.85)]) * 2  # three that tell something
    keys, n = np.unique(ballots, axis=0, return_counts=True)
    _, theta = P.reliabilities(keys, n.astype(float))
    assert theta[1, 0, 2] > 0.9 and theta[0, 1, 0] > 0.8 and abs(theta[1, 2, 2] - theta[0, 2, 2]) < 0.1


def test_redaction_keeps_rows_and_columns(spark, docs_of):
    df = docs_of([(1, "mail x@y.example.com now"), (2, None), (None, "ip 10.0.0.1"), (1, "mail x@y.example.com now"), (3, "clean")])
    out = P.pii_stage(spark, df, "")
    assert out.schema == df.schema
    assert sorted(str((r.doc_id, r.text, r.n_chars)) for r in out.collect()) == sorted(str(x) for x in [(1, "mail [EMAIL] now", 16), (2, None, None), (None, "ip [IP]", 7), (1, "mail [EMAIL] now", 16), (3, "clean", 5)])


def test_empty_table(docs_of):
    assert P.personal(docs_of([])).count() == 0


def test_whole_table(spark, sf_dir):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = P.op7_pii(spark, sf_dir).collect()
    assert len(got) == len(text)
    for r in got:
        base = brute(text[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
