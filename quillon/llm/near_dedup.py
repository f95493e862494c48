"""MinHash near-dedup with HyperMinHash sketches: bands of compressed registers find candidates, full sets confirm them.

Sketch: a document's distinct 5-word shingles are hashed to 64 bits; the top bits choose one of ``BUCKETS`` registers and
the smallest remainder of a bucket is kept as its leading-zero count and ``MANTISSA`` bits (two bytes a register). For the
bands, a bucket without shingles takes the register of the first bucket in use on a fixed random walk of its own, so that a
register of two documents is equal with about the probability of their Jaccard similarity however short they are, and a
line that short documents share does not by itself fill a band. A finer sketch of ``FINE`` one-byte registers of the same
kind serves the estimates.

Candidates: documents with equal shingle sets are one class, told by a 128-bit digest of the set. A class stands as one
row of the sketch table, by its row number, so that rows which share a doc_id and differ in text stay apart. Classes meet
in bands of ``ROWS`` registers.
1. Of the smallest members of the buckets that a class is in, the one it meets most often is estimated by registers and
   confirmed on full sets. Components come from these links.
2. Buckets that still hold two components compare their members by collision-corrected register estimates; a pair is
   looked at in the first band it shares only. What comes out are the members that have a possible link, at most one row a
   member and bucket, never pairs. A bucket above ``CHUNK`` members is split: the members of its largest component are
   dealt to chunks, the others are compared with each chunk.
3. Those members' full sets meet by bucket and chunk, where shared shingles are counted by postings and links that join
   components come out, fewer than members. No bucket is capped.

What banding may miss: a pair at the threshold shares no band with probability 5e-6, whatever its length; more alike, far
less. A pair is left to its estimate if that is ``DEVIATIONS`` deviations below the threshold (3e-5 at the threshold).

Defined cases: null text is empty text; a document without words has an empty set, no links and is kept; fewer than five
words form one shingle; rows with a null doc_id keep a null component and are kept; repeated doc_ids are one document's
rows only if their texts link. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix, release, shingle_sets, small, table, trimmed, without

BUCKETS, MANTISSA, ROWS = 128, 10, 4
BANDS = BUCKETS // ROWS
#: Buckets and mantissa bits of the second, finer sketch, which estimates read.
FINE, FINE_MANTISSA = 512, 4
#: Pairs so many deviations below the threshold are not confirmed.
DEVIATIONS = 4
EMPTY = np.uint16(0xFFFF)
#: Buckets of up to so many representatives are compared together, many at a time; larger ones one by one.
SMALL_BUCKET = 24
#: Members of a bucket's largest component that one task compares with the others.
CHUNK = 1024
_WALK = np.random.Generator(np.random.PCG64(77)).integers(0, BUCKETS, (4 * BUCKETS, BUCKETS))
THRESHOLD = 0.75


def registers_of(shingles: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS, mantissa: int = MANTISSA) -> np.ndarray:
    """Sketches of documents' sorted sets, one behind the other: of each bucket's smallest remainder, leading zeros and the
    bits after the first one."""
    bits = buckets.bit_length() - 1
    out = np.full(len(counts) * buckets, EMPTY, dtype=np.uint16)
    if len(shingles):
        cell = np.repeat(np.arange(len(counts)) * buckets, counts) + (shingles >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        rest = (shingles[first] << np.uint64(bits)) >> np.uint64(11)  # 53 bits, exact as a double
        part, power = np.frexp(rest.astype(np.float64))
        zeros = np.minimum(53 - power, 62)
        tail = np.where(rest > 0, (part * 2 - 1) * (1 << mantissa), 0).astype(np.int64)
        out[cell[first]] = (zeros.astype(np.int64) << mantissa | tail).astype(np.uint16)
    return out.reshape(len(counts), buckets)


def registers(shingles: np.ndarray, buckets: int = BUCKETS, mantissa: int = MANTISSA) -> np.ndarray:
    return registers_of(shingles, np.array([len(shingles)]), buckets, mantissa)[0]


def dense(regs: np.ndarray) -> np.ndarray:
    """Registers without gaps: an empty bucket takes the register of the first one in use on its walk."""
    out = regs.copy()
    doc, at = np.nonzero((regs == EMPTY) & (regs != EMPTY).any(axis=1)[:, None])
    for step in _WALK:
        if not len(doc):
            return out
        value = regs[doc, step[at]]
        got = value != EMPTY
        out[doc[got], at[got]] = value[got]
        doc, at = doc[~got], at[~got]
    for d in np.unique(doc):  # sets of very few shingles: the next bucket in use
        used = np.flatnonzero(regs[d] != EMPTY)
        own = at[doc == d]
        out[d, own] = regs[d, used[np.searchsorted(used, own) % len(used)]]
    return out


def fine_of(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sketch for estimates: more buckets of one byte, four bits of leading zeros and four of the mantissa; 255: empty."""
    wide = registers_of(shingles, counts, FINE, FINE_MANTISSA)
    return np.where(wide == EMPTY, 255, np.minimum(wide & 255, 254)).astype(np.uint8)


def fine_registers(shingles: np.ndarray) -> np.ndarray:
    return fine_of(shingles, np.array([len(shingles)]))[0]


def chance(n: np.ndarray) -> np.ndarray:
    """For sets of n shingles: the chance that the smallest remainder of a bucket has i leading zeros, for i < 48."""
    i = np.arange(48)
    per = np.asarray(n, dtype=np.float64)[:, None] / FINE
    return np.exp(-per * 0.5 ** (i + 1)) - np.exp(-per * 0.5**i)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, p_a: np.ndarray | None = None, p_b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of fine registers, corrected for registers that are equal by accident, and the deviation
    of such an estimate at the threshold. ``p_a`` and ``p_b`` are ``chance`` of the sizes, where they are known already.

    Two unrelated minima agree in zeros and mantissa with probability sum_i p_a(i) p_b(i) / 2**FINE_MANTISSA. The buckets
    in use are a sample, without replacement, of the union's shingles: the more of them it holds, the less it deviates.
    """
    used = np.maximum(((a != 255) | (b != 255)).sum(axis=1), 1)
    same = ((a == b) & (a != 255)).sum(axis=1)
    accident = used * ((chance(n_a) if p_a is None else p_a) * (chance(n_b) if p_b is None else p_b)).sum(axis=1) / (1 << FINE_MANTISSA)
    est = np.clip((same - accident) / np.maximum(used - accident, 1e-9), 0, 1)
    union = (n_a + n_b) / (1 + THRESHOLD)
    left = np.clip(1 - used / np.maximum(union, 1), 0, 1)
    spread = THRESHOLD * (1 - THRESHOLD) * left / used + accident / used**2 + 1 / used**2
    return est, np.sqrt(spread)


def _bytes_of(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def sketch(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, set_id (digest of the set), regs (without gaps), fine: one row per input row."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, last, sets in shingle_sets(batch.column(1)):
                counts = np.array([len(s) for s in sets], dtype=np.int64)
                own = np.concatenate(sets)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                regs, fine = ([x.tobytes() for x in m] for m in (dense(registers_of(own, counts)), fine_of(own, counts)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(counts), pa.array(digest, pa.binary()), pa.array(regs, pa.binary()), pa.array(fine, pa.binary())], ["doc_id", "n_shingles", "set_id", "regs", "fine"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, n_shingles long, set_id binary, regs binary, fine binary")
    return made.withColumn("row", F.monotonically_increasing_id())


def bands(reps: DataFrame) -> DataFrame:
    """rep, band, key: a row for each band."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = _bytes_of(batch.column(1), np.uint16, BUCKETS).reshape(-1, BANDS, ROWS)
            key = np.zeros(regs.shape[:2], dtype=np.uint64)
            for k in range(ROWS):
                key = key << np.uint64(16) | regs[:, :, k].astype(np.uint64)
            key = mix(key ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :])
            rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int8), len(regs))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(band), pa.array(key.view(np.int64).ravel())], ["rep", "band", "key"])

    return reps.select("rep", "regs").mapInArrow(trimmed(run), "rep long, band byte, key long")


def _fits(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * 75


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes allow the threshold and whose estimate is within the deviations of it."""
    side = lambda p: reps.select(F.col("rep").alias(p), F.col("fine").alias(f"r_{p}"), F.col("n_shingles").alias(f"n_{p}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, r_a, r_b, n_a, n_b = batch.columns
            n_a, n_b = n_a.to_numpy(), n_b.to_numpy()
            est, spread = estimate(_bytes_of(r_a, np.uint8, FINE), _bytes_of(r_b, np.uint8, FINE), n_a, n_b)
            keep = pa.array(np.flatnonzero(_fits(n_a, n_b) & (est >= THRESHOLD - DEVIATIONS * spread)))
            yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], ["a", "b"])

    return both.select("a", "b", "r_a", "r_b", "n_a", "n_b").mapInArrow(trimmed(run), "a long, b long")


def _sets(need: DataFrame, n_need: int, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, s (the full set): made anew from the texts of the classes in ``need`` (rep)."""
    asked = materialize(reps.select("rep", "doc_id", "set_id").join(small(need, n_need), "rep", "left_semi"), "asked")

    def run(batches):
        for batch in batches:
            out = [s.tobytes() for _, _, sets in shingle_sets(batch.column(1)) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in out], pa.binary()), pa.array(out, pa.binary()), batch.column(0)], ["set_id", "s", "doc_id"])

    texts = docs.select("doc_id", "text").join(small(asked.select("doc_id"), n_need), "doc_id", "left_semi")
    made = texts.mapInArrow(trimmed(run), "set_id binary, s binary, doc_id long").join(small(asked, n_need), ["set_id", "doc_id"])
    out = materialize(made.select("rep", "s").dropDuplicates(["rep"]), "sets")
    release(asked)
    return out


def _confirmed(pairs: DataFrame, n_pairs: int, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= 75 * union."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), 2 * n_pairs, reps, docs)
    side = lambda p: sets.select(F.col("rep").alias(p), F.col("s").alias(f"s_{p}"))

    def judge(batches):
        for batch in batches:
            a, b, s_a, s_b = (batch.column(k).to_pylist() for k in ("a", "b", "s_a", "s_b"))
            keep = []
            for k, (x, y) in enumerate(zip(s_a, s_b, strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= 75 * (len(x) + len(y) - both) and both:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"])

    found = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "s_a", "s_b").mapInArrow(trimmed(judge), "a long, b long")
    out = materialize(found, "links", n_pairs)
    release(sets)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``links`` (a, b), by alternating large-star and small-star.

    It ends when each node points at one node, and none at a node that points elsewhere: every component is a star then.
    The minima of a round are broadcast while the links are few, so that a node with many links is not dealt to one task;
    beyond that, the joins are such as Spark splits when a key is skewed.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    state, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(small(least, 2 * n), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small(least, 2 * n), "u")
        step = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(step, "stars", 2 * n)
        release(state)
        state = edges = new
        ends = new.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("x"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).groupBy("e.x").agg(F.sum("e.o").alias("o"), F.max("e.i").alias("i"), F.lit(1).alias("k"))
        n, open_ = ends.agg(F.coalesce(F.sum("o"), F.lit(0)), F.count(F.when((F.col("o") > 1) | ((F.col("o") > 0) & (F.col("i") > 0)), 1))).first()
        if not open_:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _open(rows: DataFrame, comps: DataFrame | None, n_comps: int) -> DataFrame:
    """key, band, rep, component, own, chunk of the buckets that hold two or more components.

    Of buckets with the same members, the one of the earliest band stays. ``own`` is the chunk of a member; those that are
    not of the bucket's largest component are in every chunk.
    """
    if comps is None:
        labelled = rows.withColumn("component", F.col("rep"))
    else:
        labelled = rows.join(small(comps.select(F.col("node").alias("rep"), "component"), n_comps), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    x, y = F.bit_xor(F.xxhash64("rep")), F.bit_xor(F.xxhash64("rep", F.lit(1)))
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("band").alias("band"), x.alias("x"), y.alias("y"))
    stats = parts.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max(F.struct("n", "component")).getField("component").alias("most"), F.min("band").alias("band"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    one = stats.where("k > 1").groupBy("n", "x", "y").agg(F.min_by(F.struct("key", "most"), "band").alias("b")).select("b.key", "b.most", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    dealt = labelled.join(one, "key").select("key", "band", "rep", "component", own.alias("own"), "chunks", (F.col("component") == F.col("most")).alias("major"))
    where = F.when(F.col("major") | (F.col("chunks") == 1), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    return dealt.select("key", "band", "rep", "component", "own", "major", F.explode(where).alias("chunk"))


def _pairs_of(key, chunk, comp, own, major, n, some):
    """Rows i and j of the same bucket and chunk that are of different components and sizes allow; blocks of both.

    Two members that are dealt to different chunks meet once: in the chunk of the one from the largest component, else in
    the later of their own.
    """
    begins = np.concatenate(([True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])))
    first = np.flatnonzero(begins)
    size = np.diff(np.concatenate((first, [len(key)])))
    group = np.cumsum(begins)

    def fit(i, j):
        here_i, here_j = own[i] == chunk[i], own[j] == chunk[j]
        met = (here_i & here_j) | (here_i & ~here_j & (major[i] | (own[j] < chunk[j]))) | (here_j & ~here_i & (major[j] | (own[i] < chunk[i])))
        keep = met & (comp[i] != comp[j]) & _fits(n[i], n[j])
        return i[keep], j[keep]

    of_small = np.repeat(size <= some, size)
    for d in range(1, some):
        at = np.flatnonzero((group[d:] == group[:-d]) & of_small[d:]) if d < len(key) else np.zeros(0, np.int64)
        if len(at):
            yield fit(at, at + d)
    for lo, m in zip(first[size > some], size[size > some], strict=True):
        inside = np.arange(lo, lo + m)
        kinds, count = np.unique(comp[inside], return_counts=True)
        most = comp[inside] == kinds[count.argmax()]
        rest = inside[~most]
        for k, x in enumerate(rest):  # with all of the largest component, and with what comes later of the others
            other = np.concatenate((inside[most], rest[k + 1 :]))
            yield fit(np.full(len(other), x), other)


def possible(open_: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of ``open_`` that may be linked, by their registers, with another of the same bucket and chunk.

    Buckets stream through in order; a bucket's pairs are compared where they stand, so none is spelled out in rows. A pair
    is looked at in the first band that it shares.
    """
    dealt = open_.join(reps.select("rep", "n_shingles", "fine", "regs"), "rep").select("key", "chunk", "component", "rep", "own", "major", "band", "n_shingles", "fine", "regs")
    dealt = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "component", "rep")

    def told(key, chunk, comp, rep, own, major, band, n, fine, regs):
        sizes, at = np.unique(n, return_inverse=True)
        likely = chance(sizes)[at]
        keep = np.zeros(len(key), bool)
        for i, j in _pairs_of(key, chunk, comp, own, major, n, SMALL_BUCKET):
            for k in range(0, len(i), 20_000):
                x, y = i[k : k + 20_000], j[k : k + 20_000]
                est, spread = estimate(fine[x], fine[y], n[x], n[y], likely[x], likely[y])
                hit = np.flatnonzero(est >= THRESHOLD - DEVIATIONS * spread)
                x, y = x[hit], y[hit]
                shared = (regs[x] == regs[y]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[x]
                keep[x[shared]] = keep[y[shared]] = True
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, chunk, comp, rep, own, major)], ["key", "chunk", "component", "rep", "own", "major"])

    def run(batches):
        def columns(batch):
            plain = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(8)]
            return [*plain, _bytes_of(batch.column(8), np.uint8, FINE), _bytes_of(batch.column(9), np.uint16, BUCKETS)]

        for whole in _buckets(batches, columns):
            yield from told(*whole)

    return dealt.mapInArrow(trimmed(run), "key long, chunk int, component long, rep long, own int, major boolean")


def _buckets(batches, columns):
    """Runs of whole buckets (equal in the first two columns) from sorted batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = columns(batch)
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))  # the last bucket may go on in the next batch
        whole = int(last[-1]) + 1 if len(last) else 0
        if whole:
            yield [x[:whole] for x in now]
        held = [x[whole:] for x in now]
    if held is not None:
        yield held


def joining(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) on full sets that join the components of each bucket and chunk of ``rows``, fewer than its members.

    Shared shingles are counted through the postings of the bucket's shingles, a member at a time.
    """
    dealt = rows.join(sets, "rep").select("key", "chunk", "component", "rep", "own", "major", "s").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "component", "rep")

    def told(comp, rep, sets):
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(code, kind="stable")
        postings, starts = owner[order], np.concatenate(([0], np.cumsum(np.bincount(code))))
        begins = np.cumsum(size) - size
        up = {int(c): int(c) for c in comp}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        kinds, count = np.unique(comp, return_counts=True)
        most = kinds[count.argmax()]
        for x in np.flatnonzero(comp != most):
            codes = code[begins[x] : begins[x] + size[x]]
            lengths = starts[codes + 1] - starts[codes]
            spots = np.repeat(starts[codes] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            both = np.bincount(postings[spots], minlength=len(sets))
            for y in np.flatnonzero((100 * both >= 75 * (size[x] + size - both)) & (comp != comp[x])):
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q:
                    up[p] = q
                    yield int(rep[x]), int(rep[y])

    def run(batches):
        def columns(batch):
            plain = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            made = np.empty(batch.num_rows, dtype=object)
            made[:] = [np.frombuffer(x, np.uint64) for x in batch.column(6).to_pylist()]
            return [*plain, made]

        for key, chunk, comp, rep, sets in _buckets(batches, columns):
            ends = np.flatnonzero(np.concatenate(((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]), [True]))) + 1
            links, lo = [], 0
            for hi in ends:
                links += told(comp[lo:hi], rep[lo:hi], list(sets[lo:hi]))
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(trimmed(run), "a long, b long")


def link_components(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id, kept; see the module's text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialize(sketch(texts), "sketch")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(full.groupBy("set_id", "n_shingles").agg(F.min("row").alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("copies")), "classes")
    reps = materialize(classes.select("rep", "low").join(sketches, F.col("rep") == F.col("row")).select("rep", "low", "doc_id", "set_id", "n_shingles", "regs", "fine"), "reps")
    banded = bands(reps)
    busy = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1")
    rows = materialize(banded.join(busy.drop("n"), "key"), "bands")
    # First: of the buckets' smallest members the one met most often, of equals the smallest, which most others choose too.
    met = rows.where("rep <> pivot").groupBy("pivot", "rep").agg(F.count("*").alias("n"))
    stars = met.groupBy(F.col("rep").alias("b")).agg(F.max(F.struct("n", (-F.col("pivot")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    pairs = materialize(_estimated(stars, reps), "stars")
    links, comps, n_comps = None, None, 0
    if n := pairs.count():
        links = _confirmed(pairs, n, reps, texts)
        comps = materialize(components(links), "components", 2 * n)
        n_comps = comps.count()
    release(pairs)
    # Then: what is still apart.
    some = materialize(possible(_open(rows.select("key", "band", "rep"), comps, n_comps), reps), "possible")
    release(rows)
    if n := some.count():
        sets = _sets(some.select("rep").distinct(), n, reps, texts)
        more = materialize(joining(some, sets), "joins")
        release(sets)
        # What was joined before enters as a star, which is no larger than its links.
        old, comps = comps, materialize(components(more if comps is None else more.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))), "components", n + 2 * n_comps)
        n_comps = comps.count()
        release(old, more)
    release(some, links, reps)
    if comps is None:
        named = classes.select("set_id", "n_shingles", "copies", "low", F.col("low").alias("component"))
    else:
        own = classes.join(small(comps.withColumnRenamed("node", "rep"), n_comps), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        least = own.where("component <> rep").groupBy("component").agg(F.min("low").alias("l"))
        first = classes.select(F.col("rep").alias("component"), F.col("low").alias("f")).join(small(least, n_comps), "component", "inner").select("component", F.least("l", "f").alias("least"))
        named = own.join(first, "component", "left").select("set_id", "n_shingles", "copies", "low", F.coalesce("least", "low").alias("component"))
    # Only classes with copies or links need telling; every other document is its own component.
    told = materialize(named.where("copies > 1 or component <> low").select(F.col("set_id").alias("s"), F.col("n_shingles").alias("n"), "component"), "told")
    out = sketches.select("doc_id", "n_shingles", "set_id").join(small(told, told.count()), (F.col("set_id") == F.col("s")) & (F.col("n_shingles") == F.col("n")) & F.col("doc_id").isNotNull(), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = materialize(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near")
    release(sketches, classes, comps, told)
    return out


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that with the smallest doc_id of its own, else any of those without one.

    Rows without an id, and rows that share one, are told apart; empty texts stay.
    """
    return without(docs, lambda rows: link_components(rows).where("not kept"))
