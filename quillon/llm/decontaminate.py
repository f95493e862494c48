"""Benchmark decontamination [native]: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size (powers of two of their distinct 5-word shingles) and each gets a MinHash sketch whose
length its size sets: the ``n - ceil(0.75 n) + 1`` smallest shingle hashes. A document that holds three quarters of an
item's shingles holds at least one of these, so probing a document's shingle hashes against the sketches finds every such
pair, however long the document is. Each class has its own largest sketch value and its own least document length: a
document is probed with the classes that it is long enough for, and with no hash above the largest value of these.
Candidates are then decided on the shingles' words, not on hashes: the shingles of a candidate's item, which are few, are
sought in its document, so that a passage that many documents and items share makes no more rows than candidates' items.

Everything is DataFrame code. The sketches are broadcast while they are few (their count is checked), else they shuffle.

Defined cases: null text is empty; texts without words have no shingles; fewer than five words form one shingle, so a
short item is found only in a document of just these words. Rows with a null doc_id or item_id are not reported; rows
that share a doc_id (or item_id) are one set. Words are lower-cased. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, release, small, table, without
from .native import shingles, words

CONTAINMENT = 75  # percent of an item's distinct shingles


def _sets(df: DataFrame, key: str, joined: bool) -> DataFrame:
    w = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), words(F.lower("text")).alias("w"))
    return w.select(key, F.explode(F.array_distinct(shingles("w", joined=joined))).alias("s"))


def sketches(items: DataFrame) -> DataFrame:
    """h, item_id, n_item, size_class: the smallest hashes of each item, as many as its size asks for."""
    sets = _sets(items, "item_id", joined=False).distinct().groupBy("item_id").agg(F.sort_array(F.collect_list("s")).alias("hs"))
    n = F.size("hs")
    need = n - F.ceil(n * CONTAINMENT / 100).cast("int") + 1
    sized = sets.select("item_id", n.cast("long").alias("n_item"), F.floor(F.log2(n)).cast("int").alias("size_class"), F.slice("hs", F.lit(1), need).alias("hs"))
    return sized.select(F.explode("hs").alias("h"), "item_id", "n_item", "size_class")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment of the pairs at or above the threshold."""
    sketch = materialize(sketches(items), "sketches")
    # At most 31 rows, as many as there are powers of two among sizes.
    classes = sketch.groupBy("size_class").agg(F.count("*").alias("n"), F.max("h").alias("top"), F.min("n_item").alias("least")).orderBy("size_class").collect()
    n_sketch = sum(c.n for c in classes)
    if not n_sketch:
        release(sketch)
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double")
    w = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), words(F.lower("text")).alias("w"))
    hashed = w.select("doc_id", F.size("w").alias("n_words"), shingles("w").alias("hs"))
    # At most n_words - 4 distinct shingles (one if fewer words): too few for an item of this size cannot hold it.
    room = F.greatest(F.col("n_words") - 4, F.lit(1)) * 100
    never = F.lit(-(1 << 63)).cast("long")
    bound = F.greatest(never, never, *(F.when(room >= c.least * CONTAINMENT, F.lit(c.top)) for c in classes))
    probes = hashed.withColumn("bound", bound)
    low = probes.select("doc_id", "n_words", F.explode(F.filter("hs", lambda h: h <= F.col("bound"))).alias("h"))
    hits = low.join(small(sketch, n_sketch), "h").where(room >= F.col("n_item") * CONTAINMENT).select("doc_id", "item_id")
    candidates = materialize(hits.distinct(), "candidates")
    n = candidates.count()
    suspects = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(candidates.select("doc_id").distinct(), n), "doc_id", "left_semi")
    truth = _sets(items, "item_id", joined=True).distinct()
    asked = candidates.join(truth, "item_id")
    have = _sets(suspects, "doc_id", joined=True).join(small(truth.select("s").distinct(), n_sketch * 4, BROADCAST_ROWS // 5), "s", "left_semi").distinct()
    shared = asked.join(have, ["doc_id", "s"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    size = truth.groupBy("item_id").agg(F.count("*").alias("n_item_shingles"))
    found = shared.join(small(size, n_sketch), "item_id").where(F.col("n_shared") * 100 >= F.col("n_item_shingles") * CONTAINMENT)
    out = materialize(found.select("doc_id", "item_id", "n_item_shingles", "n_shared", F.round(F.col("n_shared") / F.col("n_item_shingles"), 6).alias("containment")), "leaks")
    release(sketch, candidates)
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each contaminated document and each benchmark item that it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a benchmark item; rows without an id, or with a shared one, are told apart."""
    return without(docs, lambda rows: contaminated(rows, table(spark, sf_dir, "benchmark")))


_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM d),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT DISTINCT item_id, unnest({_SHINGLES}) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM bs GROUP BY 1),
j AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item_shingles, n_shared, round(n_shared / n_item_shingles, 6) AS containment
FROM j JOIN n USING (item_id) WHERE n_shared * 100 >= n_item_shingles * 75
"""
