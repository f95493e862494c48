"""Token counts as delta-maintained rollups: signed changes keep additive totals by source, language and tokenizer version.

A rollup is a folder of committed batches. A batch brings rows (doc_id, version, source, lang, n_tokens, n_chars, op) with
op ``insert`` / ``revise`` (the document now counts so much) or ``delete``. Against the ledger's last state of each
(doc_id, version) it becomes signed deltas: what the document counted before is taken away under its old source and
language, what it counts now is added. A batch holds its summed deltas and its ledger rows; both appear with one rename
of its folder, so a batch is committed wholly or not at all, and committing an id again changes nothing. A lock file lets
one writer commit at a time; one that a killed driver left must be removed by hand. Totals are the sum of all batches'
deltas, a few rows a batch; no text counted before is read again. ``compact`` puts all batches into one base, which holds
their totals, their ids and the last state of each document that counts.

Defined cases: null text counts no tokens; rows without a doc_id cannot be revised: each is its own insert, and other ops
on them are ignored; of rows with one key in a batch the last in (op, source, lang, n_tokens, n_chars) order holds, with
delete before insert before revise; a delete of an unknown key changes nothing; null source or lang is a group of its own.
"""

from __future__ import annotations

import base64
import contextlib
import os
import uuid

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import _scratch, checkpoint_dir, table

#: Folder of public vocabularies on the driver, from which executors get their copy, and the vocabulary counted by.
TOKENIZERS = os.environ.get("QUILLON_TOKENIZERS", "/opt/tokenizers")
VERSION = "byte_bpe_50k"
#: Words, numbers, runs of signs and of white space, as public byte-level vocabularies of this family are split.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(version: str, folder: str | None = None):
    """The encoding of a vocabulary file in ``folder``, or, without one, of the file that Spark handed to this executor."""
    import tiktoken

    folder = folder or SparkFiles.getRootDirectory()

    if (folder, version) not in _encoders:
        with open(f"{folder}/{version}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[folder, version] = tiktoken.Encoding(version, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[folder, version]


def token_counts(docs: DataFrame, version: str = VERSION, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, version, source, lang, n_tokens, n_chars, op = insert, of each row of docs(doc_id, source, lang, text)."""

    docs.sparkSession.sparkContext.addFile(f"{folder}/{version}.tiktoken")

    def run(batches):
        encode = encoder(version).encode_ordinary
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            n = [len(encode(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "source", "lang", "n_tokens", "n_chars"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(run, "doc_id long, source string, lang string, n_tokens long, n_chars long")
    return rows.withColumns({"version": F.lit(version), "op": F.lit("insert")})


def _parse(schema: str) -> list[StructField]:
    return StructType.fromDDL(schema).fields


class Rollup:
    """Committed batches below ``path``, a folder that all executors share."""

    _KEY = ["doc_id", "version"]
    _STATE = ["source", "lang", "n_tokens", "n_chars", "live"]
    _DELTA = "source string, lang string, version string, n_docs long, n_tokens long, n_chars long"
    _CHANGES = "doc_id long, version string, source string, lang string, n_tokens long, n_chars long, op string"
    _LEDGER = "doc_id long, version string, source string, lang string, n_tokens long, n_chars long, live boolean, seq long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, kind: str) -> list[str]:
        root = self._p(self.path)
        if not self._fs.exists(root):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(root) if x.getPath().getName().startswith(kind))

    def _base(self) -> tuple[str | None, int]:
        """The folder of the last compaction and the number of the last batch in it."""
        bases = self._folders("base-")
        return (bases[-1], int(bases[-1].split("-")[1])) if bases else (None, -1)

    def batches(self) -> list[str]:
        """Folders of the batches committed since the last compaction, in order of commit."""
        return [b for b in self._folders("batch-") if int(b.split("-")[1]) > self._base()[1]]

    def _last(self) -> int:
        return max([self._base()[1], *(int(b.split("-")[1]) for b in self.batches())])

    def _committed(self, batch_id: str) -> bool:
        base = self._base()[0]
        if any(b.split("-", 2)[2] == batch_id for b in self.batches()):
            return True
        return base is not None and not self.spark.read.schema("id string").parquet(f"{self.path}/{base}/ids").where(F.col("id") == batch_id).isEmpty()

    def _read(self, kind: str, schema: str) -> DataFrame:
        base = self._base()[0]
        paths = [f"{self.path}/{b}/{kind}" for b in ([base] if base else []) + self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @contextlib.contextmanager
    def _locked(self):
        self._fs.mkdirs(self._p(self.path))
        lock = self._p(f"{self.path}/lock")
        if not self._fs.createNewFile(lock):
            raise RuntimeError(f"another commit holds {lock}")
        try:
            yield
        finally:
            self._fs.delete(lock, False)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Applies a batch; False if its id is committed already."""
        with self._locked():
            return self._commit(batch_id, changes)

    def compact(self) -> None:
        """Puts the base and all batches into one base, with one rename; then removes what it was made of.

        The base holds the last state of the documents that count, so its size does not depend on how often they were
        revised. What a killed driver has left of older folders is not read, and goes with the next compaction.
        """
        with self._locked():
            if not self.batches():
                return
            old, seq, staged = self._folders("base-") + self._folders("batch-"), self._last(), f"{self.path}/staged-{uuid.uuid4().hex}"
            state = self._read("ledger", self._LEDGER).groupBy(*self._KEY).agg(F.max_by(F.struct(*self._STATE, "seq"), "seq").alias("x")).where("x.live")
            state.select(*self._KEY, "x.*").write.parquet(f"{staged}/ledger")
            self.totals().write.parquet(f"{staged}/delta")
            ids = self.spark.createDataFrame([(b.split("-", 2)[2],) for b in self.batches()], "id string")
            if base := self._base()[0]:
                ids = ids.unionByName(self.spark.read.schema("id string").parquet(f"{self.path}/{base}/ids"))
            ids.coalesce(1).write.parquet(f"{staged}/ids")
            if not self._fs.rename(self._p(staged), self._p(f"{self.path}/base-{seq:08d}")):
                raise RuntimeError(f"{staged} could not be renamed")
            for folder in old:
                self._fs.delete(self._p(f"{self.path}/{folder}"), True)

    def _commit(self, batch_id: str, changes: DataFrame) -> bool:
        if self._committed(batch_id):
            return False
        seq = self._last() + 1
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        # What is counted is counted once, and read from there by both of its uses.
        changes.select(*(F.col(f.name).cast(f.dataType) for f in _parse(self._CHANGES))).write.parquet(f"{staged}/changes")
        changes = self.spark.read.schema(self._CHANGES).parquet(f"{staged}/changes")
        op = F.when(F.col("op") == "delete", 0).when(F.col("op") == "insert", 1).otherwise(2)
        rows = changes.select("doc_id", "version", op.alias("o"), "source", "lang", "n_tokens", "n_chars")
        keyed = rows.where("doc_id is not null").groupBy(*self._KEY).agg(F.max(F.struct("o", "source", "lang", "n_tokens", "n_chars")).alias("x"))
        new = keyed.select(*self._KEY, "x.source", "x.lang", "x.n_tokens", "x.n_chars", (F.col("x.o") > 0).alias("live"))
        new.withColumn("seq", F.lit(seq).cast("long")).write.parquet(f"{staged}/ledger")
        new = self.spark.read.schema(self._LEDGER).parquet(f"{staged}/ledger")
        now = new.where("live").select("source", "lang", "version", F.lit(1).alias("n_docs"), "n_tokens", "n_chars")
        if seq:
            last = self._read("ledger", self._LEDGER).join(new.select(*self._KEY), self._KEY, "left_semi").groupBy(*self._KEY).agg(F.max_by(F.struct(*self._STATE), "seq").alias("x")).where("x.live")
            now = now.unionByName(last.select("x.source", "x.lang", "version", F.lit(-1).alias("n_docs"), (-F.col("x.n_tokens")).alias("n_tokens"), (-F.col("x.n_chars")).alias("n_chars")))
        now = now.unionByName(rows.where("doc_id is null and o > 0").select("source", "lang", "version", F.lit(1).alias("n_docs"), "n_tokens", "n_chars"))
        self._sum(now).write.parquet(f"{staged}/delta")
        self._fs.delete(self._p(f"{staged}/changes"), True)
        return self._fs.rename(self._p(staged), self._p(f"{self.path}/batch-{seq:08d}-{batch_id}"))

    @staticmethod
    def _sum(rows: DataFrame) -> DataFrame:
        return rows.groupBy("source", "lang", "version").agg(*(F.sum(c).cast("long").alias(c) for c in ("n_docs", "n_tokens", "n_chars")))

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens, n_chars; groups without documents are gone."""
        return self._sum(self._read("delta", self._DELTA)).where("n_docs <> 0")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of all documents, brought about by signed deltas.

    A first batch inserts every document with an estimate of its tokens (a quarter of its characters), and once more under
    a tokenizer version ``chars``. A second one revises every estimate to the tokenizer's count and deletes what counted
    under ``chars``. Both are committed again, to no effect.
    """
    path = f"{checkpoint_dir(spark)}/quillon-rollup-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    rollup = Rollup(spark, path)
    docs = table(spark, sf_dir, "documents")
    chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    plain = docs.where("doc_id is not null").select("doc_id", "source", "lang", chars.alias("n_chars"))
    estimated = plain.withColumns({"version": F.lit(VERSION), "n_tokens": F.floor(F.col("n_chars") / 4), "op": F.lit("insert")})
    by_chars = plain.withColumns({"version": F.lit("chars"), "n_tokens": F.col("n_chars"), "op": F.lit("insert")})
    counted = token_counts(docs).withColumn("op", F.when(F.col("doc_id").isNull(), "insert").otherwise("revise"))
    batches = [("estimate", estimated.unionByName(by_chars)), ("count", counted.unionByName(by_chars.withColumn("op", F.lit("delete"))))]
    for name, changes in batches * 2:
        rollup.commit(name, changes)
    return rollup.totals()
