"""Toxicity: class-conditional Kneser-Ney models, compared by length-normalised log-likelihoods.

One model is learned from labelled toxic documents and one from ordinary ones. Both read bytes of words, so an insult is
known in all its inflections. A model discounts the grams of up to ``ORDER`` bytes it has seen and backs off to its
continuation counts of shorter ones; below ``SHARED`` bytes the counts are shared by both classes, and a discount of
``DISCOUNT`` leaves what one class has seen only so often to the backoff whole: a rare expression has the same
probability in both models and is no evidence. A byte's evidence is the difference of its two log-probabilities; a
document's are the mean over all its bytes and the largest means over windows of ``WINDOWS`` bytes, so one insult in a long
text weighs as in a short one. A logistic function, fitted on cross-fitted evidence, turns both into a probability.

Words are lower-cased runs of ASCII letters, digits and bytes beyond ASCII, parted by one space. Learning takes at most
``TRAIN_ROWS`` labelled documents of each class in a hash's order, in a task of its own; scoring takes every whole text.

Defined cases: null text is empty; a text without words has evidence 0; without labels, or with one class only, each
score is that class's share (0.5 without any). Extra columns are ignored; repeated doc_ids give a row each, and each of
their texts is learned while the bound allows. In the pipeline each row has its own verdict, with or without an id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, BLOCK_BYTES, in_one_task, sample_of_labels, table, text_blocks, trimmed, Fitted

TRAIN_ROWS = 2000
ORDER, SHARED = 6, 3
DISCOUNT = 3.0
FOLDS = 3
WINDOWS = (12, 30, 90, 300)
_WORD = _LOWER.copy()
_WORD[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 32


def held_out() -> Column:
    """Rows that give no labels: crc32 of the id's text, modulo 5, is 0; rows without an id give none either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of ORDER bytes, one for each byte of the documents' words and single spaces, and how many each has.

    Every document is taken to begin after spaces.
    """
    plain = _WORD[data]
    keep = plain != 32
    keep[1:] |= plain[:-1] != 32
    if len(data):
        first = offsets[:-1][np.diff(offsets) > 0]
        keep[first] = plain[first] != 32
    counts = np.diff(np.concatenate(([0], np.cumsum(keep)))[offsets])
    plain = plain[keep]
    docs, pad = len(counts), ORDER - 1
    padded = np.full(len(plain) + docs * pad, 32, np.uint8)
    ends = np.cumsum(counts)
    place = np.arange(len(plain)) + np.repeat(np.arange(1, docs + 1) * pad, counts)
    padded[place] = plain
    wide, key = padded.astype(np.int64), np.zeros(len(plain), np.int64)
    for k in range(ORDER):
        key = key << 8 | wide[place - pad + k]
    return key, counts


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of the texts and their counts, a block of text at a time."""
    return merged([np.unique(grams(d, o)[0], return_counts=True) for _, _, d, o in text_blocks(pa.array(texts, pa.string()), BLOCK_BYTES)])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)


class KneserNey:
    """Two models of bytes from the counted grams of ordinary (0) and toxic (1) texts."""

    def __init__(self, ordinary: tuple[np.ndarray, np.ndarray], toxic: tuple[np.ndarray, np.ndarray]):
        self.levels: list[list[tuple]] = [[], []]  # by class, from the longest grams down: grams, counts, contexts, totals, left
        for c, top in enumerate((ordinary, toxic)):
            for size in range(ORDER, SHARED, -1):
                self.levels[c].append(self._level(*top, DISCOUNT))
                top = np.unique(top[0] & ((1 << 8 * (size - 1)) - 1), return_counts=True)  # how many bytes each follows
        self.known = both = np.union1d(ordinary[0], toxic[0])
        for size in range(SHARED, 0, -1):
            both, n = np.unique(both & ((1 << 8 * size) - 1), return_counts=True)
            level = self._level(both, n, 0.75)
            for c in (0, 1):
                self.levels[c].append(level)
        # The evidence of known grams is kept, others' is worked out when they come.
        self.value = self.log(1, self.known) - self.log(0, self.known)

    @staticmethod
    def _level(gram: np.ndarray, n: np.ndarray, discount: float) -> tuple:
        n = n.astype(np.float64)
        context, at = np.unique(gram >> 8, return_index=True)
        add = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0)
        return gram, np.maximum(n - discount, 0), context, add(n), add(np.minimum(n, discount))

    def log(self, c: int, gram: np.ndarray) -> np.ndarray:
        p, left = np.zeros(len(gram)), np.ones(len(gram))
        for size, (seen, n, context, total, rest) in zip(range(ORDER, 0, -1), self.levels[c], strict=True):
            own = gram & ((1 << 8 * size) - 1)
            at, known = _find(context, own >> 8)
            place, found = _find(seen, own)
            if len(context):
                p += np.where(found, left * n[place] / total[at], 0)
                left = np.where(known, left * rest[at] / total[at], left)
        return np.log(p + left / 256)

    def evidence(self, key: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per document: the mean difference of log-probabilities, and the largest mean over windows of each width."""
        code, found = pd.factorize(key)
        at, known = _find(self.known, found)
        value = self.value[at] if len(self.known) else np.zeros(len(found))
        new = found[~known]
        value[~known] = self.log(1, new) - self.log(0, new)
        each = value[code] if len(key) else np.zeros(0)
        total = np.concatenate(([0.0], np.cumsum(each)))
        ends = np.cumsum(counts)
        begins = ends - counts
        out = [(total[ends] - total[begins]) / np.maximum(counts, 1)]
        last = np.repeat(ends, counts)
        for width in WINDOWS:
            stop = np.minimum(np.arange(1, len(each) + 1) + (width - 1), last)  # near its end a document's windows end with it
            best = np.zeros(len(counts))
            if (counts > 0).any():
                best[counts > 0] = np.maximum.reduceat(total[stop] - total[:-1], begins[counts > 0]) / width
            out.append(best)
        return np.column_stack(out)


def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(where):
        return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return at, where[at] == what


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; classes weighed to the share of class 1 in all labels."""
    x = np.column_stack([np.ones(len(x)), x])
    weigh = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.02] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weigh * (y - p)) - ridge @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


class Judge:
    def __init__(self, texts: list[str], toxic: list[int], share: float | None = None):
        y = np.array(toxic, dtype=np.int64)
        self.prior: float | None = None
        if len(set(toxic)) < 2:
            self.prior = float(y.mean()) if len(y) else 0.5
            return
        fold = np.zeros(len(y), np.int64)
        for c in (0, 1):
            fold[np.flatnonzero(y == c)] = np.arange((y == c).sum()) % FOLDS
        parts = [[counted([t for t, f, z in zip(texts, fold, y, strict=True) if f == k and z == c]) for c in (0, 1)] for k in range(FOLDS)]
        x = np.zeros((len(y), 1 + len(WINDOWS)))
        for k in range(FOLDS):
            model = KneserNey(*(merged([parts[j][c] for j in range(FOLDS) if j != k]) for c in (0, 1)))
            own = [t for t, f in zip(texts, fold, strict=True) if f == k]
            x[fold == k] = np.concatenate([model.evidence(*grams(d, o)) for _, _, d, o in text_blocks(pa.array(own, pa.string()), BLOCK_BYTES)])
        self.weights = _logistic(x, y, y.mean() if share is None else share)
        self.model = KneserNey(*(merged([parts[j][c] for j in range(FOLDS)]) for c in (0, 1)))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(offsets) - 1, self.prior)
        x = self.model.evidence(*grams(data, offsets))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + (x * self.weights[1:]).sum(axis=1), -30, 30)))


def trained(docs: DataFrame, labels: DataFrame) -> Fitted:
    usable = ~held_out()
    own = sample_of_labels(labels, (F.col("toxic") == 1) & usable, TRAIN_ROWS).unionByName(sample_of_labels(labels, (F.col("toxic") == 0) & usable, TRAIN_ROWS)).select("doc_id", "toxic")
    share = labels.where(usable).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id").select("text", F.col("toxic").cast("int"), "doc_id", F.xxhash64("doc_id", "text").alias("at"))

    def fit(sample: pa.Table | None) -> Judge:
        return Judge(sample.column("text").to_pylist(), sample.column("toxic").to_pylist(), share) if sample is not None else Judge([], [])

    return Fitted(in_one_task(rows, ["at", "toxic"], 2 * TRAIN_ROWS), fit, "toxic-model")


def score(docs: DataFrame, judge: Fitted) -> DataFrame:
    def run(batches):
        own = judge.load()
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column(2), BLOCK_BYTES):
                p = own(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, judge: Fitted) -> DataFrame:
    """The rows of ``docs`` whose text does not score as toxic, with all columns."""
    at = docs.columns.index("text")

    def run(batches):
        own = judge.load()
        for batch in batches:
            kept = [own(data, offsets) < 0.5 for _, _, data, offsets in text_blocks(batch.column(at), BLOCK_BYTES)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, trained(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose texts score as toxic."""
    return clean(docs, trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
