"""PII by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier learns from the result.

Four kinds are sought: email, ip, card, phone. Strict patterns (with range, Luhn and digit-count checks) give the base
spans, which always stay. Looser patterns give candidates; on each, five labelers vote for, against or abstain: the strict
pattern, a checksum or range rule, the span's shape, a gazetteer (top-level domains, card issuers, dialling codes,
reserved networks) and the words before it. The votes of all documents are summed into counts of vote patterns, whose
number does not depend on the corpus; from these, per kind, expectation-maximisation estimates how often each labeler
votes what on true and false candidates. The posteriors train a logistic classifier on features of the span and its
surroundings; candidates that it holds to be personal data and that overlap no base span are added.

A labeler is taken to be right with ``PRIOR`` pseudo-votes before any are counted, so that EM holds for a kind with few
candidates as for one with many.

Defined cases: null text is empty and has no spans; a kind without candidates adds none; repeated doc_ids give a row each; extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, table, trimmed

KINDS = ("email", "ip", "card", "phone")
PRIOR = ((4, 1, 1), (1, 1, 4))  # votes against, abstaining and in favour, of false and of true candidates
LABELERS = 5
CONTEXT = 40  # characters before a span that the context labeler reads, of texts that are searched whole

_SOME = re.compile(r"[0-9@]|at[\])]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}+)*+")
_LOOSE_PHONE = re.compile(r"(?<![0-9+.-])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])")
_PLUS_PHONE = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])")
_PLAIN_CARD = re.compile(r"(?<![0-9])(?:[0-9]{15,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CARD_SHAPE = re.compile(r"[0-9]{15,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}")
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38")
_PHONE_SHAPE = re.compile(r"\+?[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}")
_DIAL = re.compile(r"\+?(?:00)?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
_TLD = frozenset("com org net edu gov mil int io ai co uk de fr es it nl be ch at eu us ca au jp cn in br ru pl se no dk fi pt gr ie nz za mx ar cl info biz dev app example test".split())
_WORDS = {
    "email": re.compile(r"e-?mail|contact|write to|reach|address", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|from|ping", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|account|payment", re.I),
    "phone": re.compile(r"phone|tel\b|tel\.|call|mobile|fax|cell|dial", re.I),
}
_AGAINST = re.compile(r"version|release|isbn|issn|doi|order|invoice|section|licen[cs]e|page|figure|build|serial", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def _octets(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict matches, sorted. Emails are found from their @, which is leftmost matching in linear time."""
    if not _SOME.search(text):
        return []
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, 0, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, strict): the base spans and looser matches that overlap none of them, nor one another."""
    loose = [(m.start(), 0, m.end()) for m in _LOOSE_EMAIL.finditer(text)] if "@" in text or "at]" in text or "at)" in text else []
    loose += [(m.start(), 1, m.end()) for m in _IP.finditer(text)]
    loose += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 13 <= len(_digits(m[0])) <= 19]
    # What a strict match has swallowed together with a neighbour, and was dropped with it, is found by its shape.
    loose += [(m.start(), 2, m.end()) for m in _PLAIN_CARD.finditer(text)]
    loose += [(m.start(), 3, m.end()) for p in (_PLUS_PHONE, _LOOSE_PHONE) for m in p.finditer(text)]
    taken = sorted((s, e) for s, _, e in base)
    out = [(*x, True) for x in base]
    for s, kind, e in sorted(loose, key=lambda x: (x[0], x[0] - x[2], x[1])):
        at = bisect_left(taken, (s, -1))
        if (at == len(taken) or taken[at][0] >= e) and (not at or taken[at - 1][1] <= s):
            out.append((s, kind, e, False))
            taken.insert(at, (s, e))
    return out


def votes(text: str, s: int, kind: int, e: int, strict: bool) -> tuple[list[int], int]:
    """The labelers' votes (1, 0 or -1) on a candidate, and the classifier's features as bits."""
    span, before = text[s:e], text[max(0, s - CONTEXT) : s]
    d = _digits(span)
    sign = lambda yes: 1 if yes else -1
    if kind == 0:
        host = re.split(r"@|[\[(]at[\])]", span, maxsplit=1)[-1]
        tail = re.split(r"\.|dot[\])]?\x20?", host)[-1].lower()
        rule, shape, listed = "." in host or "dot" in host, bool(re.search("[A-Za-z]", span.split("@")[0])), tail in _TLD
    elif kind == 1:
        first = int(span.split(".")[0].lstrip("0")[:4] or "0")
        rule, shape = _octets(span), not re.match(r"\.[0-9]", text[e : e + 2]) and not re.search(r"[0-9]\.\Z", before)
        listed = 0 < first < 224 and first != 127
    elif kind == 2:
        rule, shape, listed = luhn(d), bool(_CARD_SHAPE.fullmatch(span)), bool(_ISSUER.match(d))
    else:
        rule, shape, listed = 10 <= len(d) <= 15, bool(_PHONE_SHAPE.fullmatch(span)), bool(_DIAL.match(span))
    near = bool(_WORDS[KINDS[kind]].search(before))
    against = bool(_AGAINST.search(before))
    alone = not (before[-1:].isalnum() or text[e : e + 1].isalnum())
    ballot = [1 if strict else 0, sign(rule), sign(shape), sign(listed), 0 if near == against else sign(near)]
    bits = [rule, shape, listed, near, against, alone, span.startswith("+"), len(set(d)) > 3 or kind == 0]
    return ballot, sum(b << k for k, b in enumerate(bits))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, text-free: base spans and candidates (start, kind, end, strict, votes in base 3, feature bits) of each row."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                own = []
                if text and (base or _SOME.search(text)):
                    for s, kind, e, strict in _candidates(text, base):
                        ballot, bits = votes(text, s, kind, e, strict)
                        own.append({"start": s, "kind": kind, "end": e, "strict": strict, "votes": sum((v + 1) * 3**k for k, v in enumerate(ballot)), "bits": bits})
                out.append(own)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("strict", pa.bool_()), ("votes", pa.int32()), ("bits", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, spans array<struct<start:int,kind:int,end:int,strict:boolean,votes:int,bits:int>>")


def reliabilities(ballots: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Dawid-Skene EM on counted ballots (patterns x labelers, votes 0..2): each pattern's posterior, and P(vote | truth).

    It starts from the share of votes in favour; conditional tables are smoothed by ``PRIOR``.
    """
    cast = (ballots != 1).sum(axis=1)
    q = np.where(cast > 0, (ballots == 2).sum(axis=1) / np.maximum(cast, 1), 0.5)
    q = 0.05 + 0.9 * q
    theta = np.zeros((2, ballots.shape[1], 3))
    for _ in range(rounds):
        share = np.clip((n * q).sum() / n.sum(), 0.01, 0.99)
        for truth, w in ((1, n * q), (0, n * (1 - q))):
            for k in range(ballots.shape[1]):
                table = np.bincount(ballots[:, k], w, 3) + PRIOR[truth]
                theta[truth, k] = table / table.sum()
        log = np.log(theta)
        cols = np.arange(ballots.shape[1])
        yes = np.log(share) + log[1, cols, ballots].sum(axis=1)
        no = np.log(1 - share) + log[0, cols, ballots].sum(axis=1)
        q = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
    return q, theta


def classifier(bits: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on the feature bits, trained on posteriors q of n candidates each."""
    x = np.column_stack([np.ones(len(bits))] + [(bits >> k & 1).astype(float) for k in range(8)])
    b, ridge, w = np.zeros(9), np.diag([1e-3] + [1.0] * 8), n / n.sum() * min(n.sum(), 1e4)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (w * (q - p)) - ridge @ b)
        b += np.clip(step, -3, 3)
    return b


def accepted(spans: DataFrame) -> dict[tuple[int, int], float]:
    """The probability of each (kind, feature bits) of candidates; learned from all candidates' vote patterns."""
    rows = spans.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.bits").agg(F.count("*").alias("n")).orderBy("kind", "votes", "bits").collect()
    out = {}
    for kind in range(len(KINDS)):
        own = [r for r in rows if r.kind == kind]
        n = np.array([r.n for r in own], dtype=float)
        if not own:
            continue
        ballots = np.array([[r.votes // 3**k % 3 for k in range(LABELERS)] for r in own])
        q, _ = reliabilities(ballots, n)
        bits = np.array([r.bits for r in own])
        b = classifier(bits, q, n)
        for x in set(bits.tolist()):
            out[kind, x] = float(1 / (1 + np.exp(-np.clip(b[0] + sum(b[1 + k] * (x >> k & 1) for k in range(8)), -30, 30))))
    return out


def personal(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and ``all_spans`` (start, kind, end) with the added ones."""
    rows = materialize(found(docs), "spans")
    chosen = {k for k, p in accepted(rows).items() if p >= 0.5}

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            counts, digest, text, spans, n = [[] for _ in KINDS], [], [], [], []
            for own in batch.column(1).to_pylist():
                base = sorted((x["start"], x["kind"], x["end"]) for x in own if x["strict"])
                both = sorted(base + [(x["start"], x["kind"], x["end"]) for x in own if not x["strict"] and (x["kind"], x["bits"]) in chosen])
                for k in range(len(KINDS)):
                    counts[k].append(sum(x[1] == k for x in base))
                said = lambda part: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in part)
                digest.append(hashlib.sha256(said(base).encode()).hexdigest())
                text.append(said(both))
                n.append(len(both))
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(spans, kind)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "all_spans"])

    out = materialize(rows.mapInArrow(trimmed(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, all_spans array<struct<start:int,kind:int,end:int>>"), "personal")
    release(rows)
    return out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal(table(spark, sf_dir, "documents")).drop("all_spans")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; n_chars follows. Other columns stay as they are.

    Labelers are weighed on all of ``docs`` first; the second pass finds the spans of each text anew, so that no text is
    shuffled and no key has to be unique.
    """
    rows = materialize(found(docs), "spans")
    chosen = {k for k, p in accepted(rows).items() if p >= 0.5}
    release(rows)
    names = docs.columns

    def run(batches):
        for batch in batches:
            at, out = batch.schema.get_field_index("text"), []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                if text and (base or _SOME.search(text)):
                    own = [(s, k, e) for s, k, e, strict in _candidates(text, base) if strict or (k, votes(text, s, k, e, False)[1]) in chosen]
                    done, parts = 0, []
                    for s, k, e in sorted(own):
                        if e > done:  # base spans of two kinds may overlap: the first names what they cover together
                            parts += [text[done : max(s, done)], f"[{KINDS[k].upper()}]" if s >= done else ""]
                            done = e
                    text = "".join(parts) + text[done:] if own else text
                out.append(text)
            columns = batch.columns
            columns[at] = pa.array(out, batch.schema.field(at).type)
            if "n_chars" in names:
                n = batch.schema.get_field_index("n_chars")
                columns[n] = pa.array([old if t is None else len(t) for t, old in zip(out, columns[n].to_pylist(), strict=True)], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(trimmed(run), docs.schema)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text is replaced."""
    return redact(docs)
