"""Quality rules [native]: a hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials.

N-grams are the words themselves and the ends of words (their last three characters), each hashed into ``BUCKETS``
buckets. The raw multinomial counts every document; the target multinomial counts every trusted one, that is, those labelled
good. A document's score is the mean over its n-grams of
log(p_target / p_raw), both with ``PRIOR`` added to each bucket; it is kept if the score is at least ``LEAST`` and it
passes the plain rules. The two tables (2 x BUCKETS numbers, whatever the corpus) enter the plan as one literal.

Defined cases: null text is empty and fails (fewer than ten words); without trusted labels the score is 0 and the plain
rules decide; repeated doc_ids give a row each; rows with a null doc_id are scored like others; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table
from .native import words

BUCKETS = 8192
PRIOR = 50.0
#: Nats per n-gram. Ordinary text scores near 0, whatever its language; upper-cased or symbol-ridden text far below.
LEAST = -0.5


def _grams(w: str) -> Column:
    return F.expr(f"concat(transform({w}, x -> pmod(xxhash64(x), {BUCKETS})), transform({w}, x -> {BUCKETS} + pmod(xxhash64(right(x, 3), 1), {BUCKETS})))")


def ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(p_target / p_raw) of each bucket: first those of words, then those of word ends."""
    ids = trusted.where("doc_id is not null").select("doc_id").distinct().withColumn("t", F.lit(1))
    marked = docs.select("doc_id", "text").join(small(ids, ids.count()), "doc_id", "left").select("t", words(F.col("text")).alias("w"))
    counts = marked.select("t", F.explode(_grams("w")).alias("g")).groupBy("g").agg(F.count("*").alias("raw"), F.count("t").alias("target")).collect()
    out = [0.0] * (2 * BUCKETS)
    import math

    for half in (0, 1):
        own = [r for r in counts if r.g // BUCKETS == half]
        raw, target = sum(r.raw for r in own), sum(r.target for r in own)
        if target:
            by = {r.g: r for r in own}
            for g in range(half * BUCKETS, (half + 1) * BUCKETS):
                r, t = (by[g].raw, by[g].target) if g in by else (0, 0)
                scale = target / raw  # the prior weighs as much in either table, relative to its size
                out[g] = round(math.log((t + PRIOR * scale) / (target + PRIOR * scale * BUCKETS)) - math.log((r + PRIOR) / (raw + PRIOR * BUCKETS)), 6)
    return out


def judged(docs: DataFrame, ratio: list[float]) -> DataFrame:
    """doc_id, the base counts, score, base_failed and kept, a row for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("t"), words(F.col("text")).alias("w"))
    # Hashes of 5-word windows, only for documents that have any.
    windows = "transform(array(transform(w, x -> xxhash64(x))), h -> transform(slice(h, 1, size(h) - 4), (x, i) -> xxhash64(x, h[i + 1], h[i + 2], h[i + 3], h[i + 4])))[0]"
    split = split.withColumn("s", F.expr(f"CASE WHEN size(w) >= 5 THEN {windows} ELSE cast(array() AS array<bigint>) END"))
    # Windows seen twice: neighbours in sorted order. Words covered by the windows [p, p + 5): each adds up to 5 new ones.
    pairs = "sort_array(transform(s, (x, i) -> struct(x, i)))"
    places = "sort_array(filter(transform(v, (e, k) -> CASE WHEN (k > 0 AND v[greatest(k - 1, 0)].x = e.x) OR (k < size(v) - 1 AND v[least(k + 1, size(v) - 1)].x = e.x) THEN e.i END), e -> e IS NOT NULL))"
    covered = "aggregate(transform(p, (e, k) -> CASE WHEN k = size(p) - 1 THEN 5 ELSE least(5, p[least(k + 1, size(p) - 1)] - e) END), 0L, (a, e) -> a + e)"
    repeat = f"CASE WHEN size(array_distinct(s)) = size(s) THEN 0L ELSE transform(array({pairs}), v -> transform(array({places}), p -> {covered})[0])[0] END"
    literal = "cast(split('" + ",".join(f"{x:g}" for x in ratio) + "', ',') AS array<double>)"
    lines = "filter(split(t, '\\n', -1), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    total = f"aggregate(w, 0D, (a, x) -> a + r[pmod(xxhash64(x), {BUCKETS})] + r[{BUCKETS} + pmod(xxhash64(right(x, 3), 1), {BUCKETS})])"
    score = f"CASE WHEN size(w) = 0 THEN 0D ELSE transform(array({literal}), r -> {total})[0] / (2 * size(w)) END"
    base = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.expr(f"cast(transform(array({lines}), l -> size(l) - size(array_distinct(l)))[0] AS bigint)").alias("n_dup_lines"),
        F.expr(repeat).alias("n_repeat_words"),
        F.expr(score).alias("score"),
    )
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return base.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= LEAST))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, ratios(docs, table(spark, sf_dir, "labels").where("quality = 1")))
