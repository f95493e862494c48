"""Quality classifier: a byte-level convolutional network in numpy, max-pooled over overlapping chunks of the document.

``FILTERS`` learned filters see ``WIDTH`` bytes each. A document is cut into blocks of ``BLOCK`` bytes; two neighbouring
blocks are a chunk, so chunks overlap by half and cover every byte. Each filter's response is max-pooled over a chunk,
passes a rectifier and a linear layer to the chunk's logit; the mean of a document's chunk logits gives the probability.

Filters are linear in one-hot bytes, so after training the filters of two adjacent bytes become one table of 65,536
rows: a response is ``WIDTH / 2`` lookups, added up. Training: at most ``TRAIN_ROWS`` labelled documents in a hash's
order, fitted in a task of its own, up to ``TRAIN_CHUNKS`` random chunks of each per epoch, Adam on the cross-entropy with
classes weighed alike.

Defined cases: null text is empty; an empty text is one chunk of padding and gets a score like any other; without
labels, or with one class only, every score is that class's share (0.5 without any). Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Fitted, in_one_task, sample_of_labels, table, text_blocks

WIDTH, FILTERS, BLOCK = 6, 16, 256
RUN = 32
TRAIN_ROWS, TRAIN_CHUNKS, EPOCHS, BATCH = 2000, 6, 8, 64


def held_out() -> Column:
    """Rows that give no labels: crc32 of the id's text, modulo 3, is 1; rows without an id give none either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {"filters": r.normal(0, 0.15, (WIDTH, 256, FILTERS)), "bias": np.zeros(FILTERS), "out": r.normal(0, 0.3, FILTERS), "shift": np.zeros(1)}
        self.prior: float | None = None

    def responses(self, x: np.ndarray) -> np.ndarray:
        """x: chunks x bytes; chunks x places x filters."""
        places = x.shape[1] - WIDTH + 1
        out = np.zeros((x.shape[0], places, FILTERS))
        for k in range(WIDTH):
            out += self.w["filters"][k][x[:, k : k + places]]
        return out

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 11) -> Network:
        share = float(labels.mean()) if len(labels) else 0.5
        if len(set(labels.tolist())) < 2:
            self.prior = share
            return self
        r = np.random.default_rng(seed)
        weigh = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        padded = [np.frombuffer(t + bytes(max(2, -(-len(t) // BLOCK)) * BLOCK - len(t)), np.uint8) for t in texts]
        m, v, step = {k: np.zeros_like(x) for k, x in self.w.items()}, {k: np.zeros_like(x) for k, x in self.w.items()}, 0
        for epoch in range(EPOCHS):
            rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
            for rows in np.array_split(r.permutation(len(texts)), max(1, len(texts) // BATCH)):
                owner, chunks = [], []
                for d, i in enumerate(rows):
                    n = max(1, len(padded[i]) // BLOCK - 1)
                    for c in r.permutation(n)[:TRAIN_CHUNKS]:
                        owner.append(d)
                        chunks.append(padded[i][c * BLOCK : (c + 2) * BLOCK])
                owner, x = np.array(owner), np.stack(chunks)
                z = self.responses(x)
                at = z.argmax(axis=1)
                top = np.take_along_axis(z, at[:, None, :], 1)[:, 0] + self.w["bias"]
                act = np.maximum(top, 0)
                each = np.bincount(owner, minlength=len(rows))
                logit = np.bincount(owner, act @ self.w["out"], len(rows)) / each + self.w["shift"]
                p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                g = (p - labels[rows]) * weigh[rows] / len(rows)
                g_chunk = (g / each)[owner]
                back = g_chunk[:, None] * self.w["out"] * (top > 0)
                grad = {"out": g_chunk @ act + 1e-4 * self.w["out"], "shift": np.array([g.sum()]), "bias": back.sum(0), "filters": np.zeros_like(self.w["filters"])}
                f = np.broadcast_to(np.arange(FILTERS), at.shape)
                chunk = np.arange(len(x))[:, None]
                for k in range(WIDTH):
                    np.add.at(grad["filters"][k], (x[chunk, at + k], f), back)
                step += 1
                for key, w in self.w.items():
                    m[key] = 0.9 * m[key] + 0.1 * grad[key]
                    v[key] = 0.999 * v[key] + 0.001 * grad[key] ** 2
                    w -= rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self) -> list[np.ndarray]:
        """For each pair of adjacent places, the summed filters of all pairs of bytes: first + 256 * second."""
        f = self.w["filters"].astype(np.float32)
        return [(f[k][None, :, :] + f[k + 1][:, None, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]


def scorer(net: Network):
    """A function of (bytes, offsets) to the probabilities of the documents."""
    tables, bias, out, shift = net.tables(), net.w["bias"].astype(np.float32), net.w["out"].astype(np.float32), float(net.w["shift"][0])

    def run(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = np.diff(offsets)
        docs = len(n)
        if net.prior is not None:
            return np.full(docs, net.prior)
        blocks = np.maximum(2, -(-n // BLOCK))
        padded = np.zeros(int(blocks.sum()) * BLOCK + WIDTH + 1, np.uint8)
        starts = (np.cumsum(blocks) - blocks) * BLOCK
        padded[np.arange(len(data)) + np.repeat(starts - offsets[:-1], n)] = data
        pair = padded[:-1].astype(np.uint16) | padded[1:].astype(np.uint16) << 8
        top = np.empty((int(blocks.sum()), FILTERS), np.float32)
        z, more = np.empty((RUN * BLOCK, FILTERS), np.float32), np.empty((RUN * BLOCK, FILTERS), np.float32)
        for b in range(0, len(top), RUN):  # the responses of some blocks at a time stay in the cache
            m = min(RUN, len(top) - b)
            near = pair[b * BLOCK : (b + m) * BLOCK + WIDTH].astype(np.intp)
            size = m * BLOCK
            np.take(tables[0], near[:size], axis=0, out=z[:size], mode="clip")
            for k in range(1, len(tables)):
                np.take(tables[k], near[2 * k : 2 * k + size], axis=0, out=more[:size], mode="clip")
                np.add(z[:size], more[:size], out=z[:size])
            # Places whose bytes reach beyond the block count for it, unless its document ends there.
            half = z[:size].reshape(m, BLOCK, FILTERS)
            while half.shape[1] > 1:
                half = np.maximum(half[:, : half.shape[1] // 2], half[:, half.shape[1] // 2 :])
            top[b : b + m] = half[:, 0]
        last = np.cumsum(blocks) - 1
        for k, at in enumerate(last):  # the last WIDTH - 1 places of a document would see its neighbour
            lo = at * BLOCK
            z = sum(tables[j // 2][pair[lo + j : lo + j + BLOCK - WIDTH + 1]] for j in range(0, WIDTH, 2))
            top[at] = z.max(axis=0)
        ends = np.zeros(len(top), bool)
        ends[last] = True
        chunk = np.maximum(top, np.concatenate((top[1:], top[-1:])))[~ends]
        logits = np.einsum("ij,j->i", np.maximum(chunk + bias, 0), out)
        owner = np.repeat(np.arange(docs), blocks - 1)
        return 1 / (1 + np.exp(-np.clip(np.bincount(owner, logits, docs) / (blocks - 1) + shift, -30, 30)))

    return run


def trained(docs: DataFrame, labels: DataFrame) -> Fitted:
    own = sample_of_labels(labels, F.col("quality").isNotNull() & ~held_out(), TRAIN_ROWS).select("doc_id", "quality")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id").select("text", F.col("quality").cast("double"), F.xxhash64("doc_id", "text").alias("at"))

    def fit(sample: pa.Table | None) -> Network:
        if sample is None:
            return Network().fit([], np.zeros(0))
        return Network().fit([t.encode() for t in sample.column("text").to_pylist()], sample.column("quality").to_numpy())

    return Fitted(in_one_task(rows, ["at", "quality"], TRAIN_ROWS), fit, "quality-model")


def score(docs: DataFrame, net: Fitted) -> DataFrame:
    def run(batches):
        judge = scorer(net.load())
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column(2), 1 << 19):
                p = judge(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(p.astype(np.float64)), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, trained(docs, table(spark, sf_dir, "labels")))
