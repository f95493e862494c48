"""LM scoring: prediction by partial matching over a byte-context trie, with escapes (method D) and symbol exclusion.

The trie is learned from the training documents: every byte with its ``ORDER`` bytes of context, the text with A-Z
lower-cased, an end symbol behind it. Counts of shorter contexts are sums over longer ones. Each symbol that a context has
seen gives half a count to its escape: a symbol costs (count - 1/2) / total, one that its longest known context has not
seen costs the escape, distinct / (2 total), and is sought in the next shorter context, where the symbols that the longer
one has seen are excluded; below order 0 all bytes left are equally likely. The code length of a text is the sum over its
bytes and its end; ``score`` is its log10 probability, of the whole text with its spaces and unknown words spelled out.

Sizes: no gram is dropped. The log-probabilities of at most ``GRAMS`` grams, those counted most often, are looked up; the
others are joined by their key, and those that training has not seen take their escapes by joins with the contexts of
each order. A token's count is looked up in a table of the tokens that make up one in ``TOKENS`` of all tokens or more (so
at most ``TOKENS`` of them); rarer ones are joined by their 64-bit hash, and hot tokens never reach that join.
``Trie`` is the same model in memory, for small corpora.

Defined cases: null text is empty and consists of its end only; without training documents every count is 0; repeated
doc_ids give a row each; a null doc_id is held out (it has no remainder) and scored; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, materialize, release, small, table, text_blocks, word_hashes, words_of

ORDER = 5
GRAMS = 1_500_000
TOKENS = 400_000
_END = 0xFF  # no byte of UTF-8 text
_END_TOKEN = np.uint64(0x5851F42D4C957F2D)
_BLOCK = 2 << 20
#: A task holds so many counted keys before it adds them up; those that are still more than half of it are sent on.
HELD = 3_000_000


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))


def _packed(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes from each place on as one number; runs of 1, 2, 4 bytes are joined."""
    run, width, out, have = data.astype(np.int64), 1, None, 0
    while True:
        if size & width:  # this run stands before what there is
            out = run[: len(data) - have - width + 1] << 8 * have | out[width:] if have else run
            have += width
        if 2 * width > size:
            return out
        run, width = run[:-width] << 8 * width | run[width:], 2 * width


def byte_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's grams of ORDER + 1 bytes (context and symbol, packed), and how many each has (bytes and an end)."""
    n = np.diff(offsets)
    docs = len(n)
    padded = np.full(len(data) + docs * (ORDER + 1), _END, dtype=np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(1, docs + 1) * ORDER + np.arange(docs), n)
    padded[place] = _LOWER[data]
    key = _packed(padded, ORDER + 1)
    keep = np.ones(len(key), dtype=bool)
    ends = np.cumsum(n + 1 + ORDER)[:-1]  # the next document's padding starts here; grams that reach back across it go
    for k in range(ORDER):
        keep[ends - ORDER + k] = False
    return key[keep], n + 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, counts = words_of(data, offsets)
    return word_hashes(data, start, end), counts


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first)


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.concatenate((first, [len(key)])))


def corpus_counts(docs: DataFrame) -> DataFrame:
    """kind (0: tokens by hash, 1: grams), key, n over ``docs``; each task adds up what it reads before it is shuffled."""

    def run(batches):
        held = {0: [], 1: []}

        def told(kind):
            key, n = _summed(held.pop(kind))
            held[kind] = []
            for k in range(0, len(key), 200_000):
                own = key[k : k + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int8)), pa.array(own), pa.array(n[k : k + 200_000])], ["kind", "key", "n"])

        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column(0), _BLOCK):
                words, _ = tokens(data, offsets)
                key, n = _counted(words.view(np.int64))
                ends = np.array([_END_TOKEN]).view(np.int64), np.array([last - first])
                for kind, parts in ((0, [(key, n), ends]), (1, [_counted(byte_grams(data, offsets)[0])])):
                    held[kind] += parts
                    if sum(len(k) for k, _ in held[kind]) > HELD:
                        held[kind] = [_summed(held[kind])]
                        if len(held[kind][0][0]) > HELD // 2:
                            yield from told(kind)
        for kind in (0, 1):
            if held[kind]:
                yield from told(kind)

    return docs.select("text").mapInArrow(run, "kind byte, key long, n long").repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Trie:
    """Sorted arrays of grams and contexts of each order."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        """grams[j]: keys of j context bytes and a symbol, and their counts; each order's suffixes are in the next lower."""
        self.key, self.count, self.context, self.total, self.distinct, self.excluded = [], [], [], [], [], []
        for j, (key, n) in enumerate(grams):
            order = np.argsort(key)
            key, n = key[order], n[order].astype(np.float64)
            context, at = np.unique(key >> 8, return_index=True)
            if not len(key):
                at = np.zeros(0, np.int64)
            add = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0)  # noqa: B023, E731
            below = np.zeros(len(key))
            if j:
                suffix = key & ((1 << 8 * j) - 1)
                place, known = _find(self.key[j - 1], suffix)
                below = np.where(known, self.count[j - 1][place], 0) if len(self.key[j - 1]) else below
            for own, x in ((self.key, key), (self.count, n), (self.context, context), (self.total, add(n)), (self.distinct, add(np.ones(len(key)))), (self.excluded, add(below))):
                own.append(x)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after its context."""
        out, live = np.zeros(len(grams)), np.arange(len(grams))
        mass, seen = np.zeros(len(grams)), np.zeros(len(grams))  # of the symbols that the next longer context excludes
        for j in range(len(self.key) - 1, -1, -1):
            g = grams[live] & ((1 << 8 * (j + 1)) - 1)
            place, known = _find(self.context[j], g >> 8)
            if known.any():
                total = np.where(known, self.total[j][place] - mass[live], 1)
                distinct = np.where(known, self.distinct[j][place] - seen[live], 0)
                at, found = _find(self.key[j], g)
                found &= known
                count = np.where(found, self.count[j][at], 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    step = np.where(found, np.log10((count - 0.5) / total), np.where(known & (distinct > 0), np.log10(0.5 * distinct / total), 0))
                out[live] += step
                mass[live], seen[live] = np.where(known, self.excluded[j][place], mass[live]), np.where(known, self.distinct[j][place], seen[live])
                live = live[~found]
            if not len(live):
                return out
        out[live] -= np.log10(256 - seen[live])
        return out


def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(where):
        return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return at, where[at] == what


def _pair(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.toArrow()
    return got.column(0).to_numpy(), got.column(1).to_numpy()


def gram_table(counts: DataFrame) -> DataFrame:
    """key, n, p, step of every training gram: p is its log10 probability after its whole context, step its count in
    sixteenths of an octave."""
    context = Window.partitionBy(F.shiftright("key", 8))
    p = F.log10(F.col("n") - 0.5) - F.log10(F.sum("n").over(context))
    return materialize(counts.where("kind = 1").select("key", "n", p.alias("p"), F.floor(F.log2("n") * 16).cast("int").alias("step")), "grams")


def hot_step(grams: DataFrame) -> int:
    """The lowest step from which on there are at most GRAMS grams."""
    least, held = 1 << 30, 0
    for row in grams.groupBy("step").count().orderBy(F.desc("step")).collect():
        held += row["count"]
        if held > GRAMS:
            break
        least = row.step
    return least


def backed_off(keys: DataFrame, n_keys: int, grams: DataFrame) -> DataFrame:
    """key, p of grams that training has not seen after their whole context: the escapes of ``Trie.log10``, by joins.

    ``seen`` holds the symbols of the longest known context so far, which the next shorter one excludes.
    """
    level, made = grams.select("key", "n"), []
    state = keys.select("key", F.lit(0.0).alias("p"), F.array().cast("array<long>").alias("seen"), F.lit(False).alias("done"))
    for j in range(ORDER, -1, -1):
        if j < ORDER:
            level = materialize(level.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n")), "level")
            made.append(level)
        of = F.shiftright(F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)), 8)
        need = keys.select(of.alias("context")).distinct()
        own = level.select(F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(F.lit(255)).alias("s"), "n").join(small(need, n_keys), "context", "left_semi")
        own = own.groupBy("context").agg(F.collect_list(F.struct("s", "n")).alias("own"))
        if j < 2:
            own = F.broadcast(own)  # at most 256 contexts
        state = state.withColumn("context", of).join(own, "context", "left").selectExpr(
            "key", "p", "seen", "done", "own is not null and not done as live", "transform(own, x -> x.s) as symbols",
            "aggregate(own, 0L, (a, x) -> a + if(array_contains(seen, x.s), 0L, x.n)) as total", "size(own) - size(seen) as fresh",
            "get(filter(own, x -> x.s = key & 255), 0).n as hit",
        ).selectExpr(
            "key", "p + case when not live then 0.0 when hit is not null then log10((hit - 0.5D) / total) when fresh > 0 then log10(0.5D * fresh / total) else 0.0 end as p",
            "if(live, symbols, seen) as seen", "done or (live and hit is not null) as done",
        )
    out = materialize(state.selectExpr("key", "if(done, p, p - log10(256 - size(seen))) as p"), "escapes")
    release(*made)
    return out


def score(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out().alias("held_out"))
    counts = materialize(corpus_counts(docs.where(~F.col("held_out"))), "counts")
    words = counts.where("kind = 0")
    n_all, v_all = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot_key, hot_n = _pair(words.where(F.col("n") * TOKENS >= n_all).select("key", "n").orderBy("key"))
    grams_of = gram_table(counts)
    least = hot_step(grams_of)
    hot_gram, hot_p = _pair(grams_of.where(F.col("step") >= least).select("key", "p").orderBy("key"))
    end_n = docs.where(~F.col("held_out")).count()  # each training document has one end
    shared = spark.sparkContext.broadcast((hot_gram, hot_p, hot_key, hot_n))

    def run(batches):
        hot_gram, hot_p, hot_key, hot_n = shared.value
        for batch in batches:
            ids, out_of = batch.column("doc_id"), batch.column("held_out")
            for first, last, data, offsets in text_blocks(batch.column("text"), _BLOCK):
                hashed, n_words = tokens(data, offsets)
                code, found = pd.factorize(hashed)
                found = found.view(np.int64)
                at, hot = _find(hot_key, found)
                log = np.where(hot, np.log10(hot_n[at] + 1.0), 0.0) if len(hot_key) else np.zeros(len(found))
                doc = np.repeat(np.arange(last - first), n_words)
                known = np.bincount(doc, hot[code], last - first)
                base = np.bincount(doc, log[code], last - first)
                rare = ~hot[code]
                ends = np.bincount(doc[rare], minlength=last - first).cumsum()
                rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(found[code[rare]]))
                known, base = known + (end_n > 0), base + np.log10(end_n + 1.0)
                grams, n_grams = byte_grams(data, offsets)
                gram_code, gram_found = pd.factorize(grams)
                at, hot = _find(hot_gram, gram_found)
                log = np.where(hot, hot_p[at], 0.0) if len(hot_gram) else np.zeros(len(gram_found))
                doc = np.repeat(np.arange(last - first), n_grams)
                ppm = np.bincount(doc, log[gram_code], last - first)
                rare = ~hot[gram_code]
                cold, times = np.unique(doc[rare] * len(gram_found) + gram_code[rare], return_counts=True)
                ends = pa.array(np.concatenate([[0], np.bincount(cold // len(gram_found), minlength=last - first).cumsum()]).astype(np.int32))
                cold, times = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (gram_found[cold % len(gram_found)], times.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), out_of.slice(first, last - first), pa.array(n_words + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(ppm), rest, cold, times],
                    ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rest", "cold", "times"],
                )

    rows = docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rest array<long>, cold array<long>, times array<long>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode("rest").alias("key"))
    cold = words.where(F.col("n") * TOKENS < n_all).select("key", "n")
    more = rare.join(cold, "key").groupBy("row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("n") + 1)).alias("b"))
    few = grams_of.where(F.col("step") < least).select("key", "p")
    cold_of = lambda df: df.select("row", F.explode(F.arrays_zip("cold", "times")).alias("x")).select("row", F.col("x.cold").alias("key"), F.col("x.times").alias("k"))
    # Training documents hold no gram that training has not seen.
    unseen = materialize(cold_of(rows.where("held_out")).join(few, "key", "left_anti"), "unseen")
    new = materialize(unseen.select("key").distinct(), "new")
    n_new = new.count()
    escapes = backed_off(new, n_new, grams_of)
    ppm = cold_of(rows).join(few, "key").unionByName(unseen.join(small(escapes, n_new), "key")).groupBy("row").agg(F.sum(F.col("k") * F.col("p")).alias("s"))
    out = rows.drop("rest", "cold", "times").join(more, "row", "left").join(ppm, "row", "left")
    out = out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n_all + v_all + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
    out = materialize(out, "lm")
    release(rows, counts, grams_of, unseen, new, escapes)
    return out


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
