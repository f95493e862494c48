"""Best-fit packing under conflicts: residual-ordered bins carry bitmaps of the sources and duplicate clusters they hold.

A document is its words and an end; longer than ``CAPACITY`` it is cut into pieces, of which the full ones fill a bin
each. What is left is packed longest first: the bins of a shard are ordered by residual capacity, and the search starts
at the tightest bin that has room and goes on to its successors until one holds neither the document's source nor its
duplicate cluster; if none does, a new bin is opened. Unless a column of clusters is named, documents with the same
lower-cased words are a cluster.

Rows are dealt by hash to shards of about ``SHARD`` rows, packed independently: bins of different shards never meet, a hot
source, cluster or doc_id spreads over all shards (a row's place in its file is part of the hash), and a task holds some
thousand (id, source, cluster, length) rows whatever the corpus. The price is at most some partly filled bins a shard.

Defined cases: null text is empty and takes one token; null sources are one source; a null doc_id is packed like others;
repeated rows are packed each (in different bins, as they are one cluster). Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .native import words

CAPACITY = 2048
SHARD = 2000


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each item (length, source, cluster), packed in the order given."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in items:
        s, c = 1 << source, 1 << cluster
        at = bisect_left(order, (length, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        if residual > length:
            insort(order, (residual - length, b))
        out.append(b)
    return out


def packed(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens, shard, bin: a row for each piece of each document."""
    w = words(F.lower("text"))
    own = F.xxhash64(F.col(cluster)) if cluster else F.xxhash64(F.array_join(w, " "))
    shards = max(1, -(-docs.count() // shard))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), own.alias("cluster"), (F.size(w) + 1).cast("long").alias("n"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", F.monotonically_increasing_id()), F.lit(shards)) if shards > 1 else F.lit(0).cast("long"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "cluster", "n"], kind="stable", na_position="first").reset_index(drop=True)
        source, cluster = pd.factorize(part["source"])[0].tolist(), pd.factorize(part["cluster"])[0].tolist()
        full = (part["n"] // capacity).tolist()
        rest = (part["n"] % capacity).tolist()
        order = sorted((k for k in range(len(part)) if rest[k]), key=lambda k: (-rest[k], k))
        bins = best_fit([(rest[k], source[k], cluster[k]) for k in order], capacity)
        used = max(bins, default=-1) + 1
        out = [(k, full[k], rest[k], b) for k, b in zip(order, bins, strict=True)]
        for k, pieces in enumerate(full):
            out += [(k, piece, capacity, used + piece) for piece in range(pieces)]
            used += pieces
        k, piece, n, b = (list(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"doc_id": part["doc_id"].iloc[k].to_numpy(), "piece": piece, "start": [p * capacity for p in piece], "n_tokens": n, "shard": part["shard"].iloc[0], "bin": b}).astype({"doc_id": "Int64"})

    return rows.groupBy("shard").applyInPandas(pack, "doc_id long, piece long, start long, n_tokens long, shard long, bin long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: a row for each piece of each document, with the bin it goes to."""
    return packed(docs)
