"""Data-quality reports of a feature panel and table audits, each in one pass over its input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(wide: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """From one row with columns ``{name}|{field}`` to a row for each name."""
    items = F.array(*[F.struct(F.lit(n).alias("name"), *[F.col(f"`{n}|{f}`").cast(t).alias(f) for f, t in fields.items()]) for n in names])
    return wide.select(F.explode(items).alias("x")).select("x.*")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, nulls."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}|nulls") for c in columns])
    return _rows(wide, columns, {"nulls": "long"}).withColumnRenamed("name", "column_name")


def key_report(df: DataFrame, keys: tuple[str, str] = ("ticker", "date")) -> DataFrame:
    """n_rows, duplicate_keys (keys that more than one row has), null_{key}s."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.agg(F.sum("n").alias("n_rows"), F.count_if((F.col("n") > 1) & F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()).alias("duplicate_keys"), *[F.coalesce(F.sum(F.when(F.col(k).isNull(), F.col("n"))), F.lit(0)).alias(f"null_{k}s") for k in keys])


def _availability(name: str, columns: list[str], extra: Column | None = None) -> list[Column]:
    if not columns:
        fields = ["columns", "rows_any", "rows_all", "null_values"] + (["rows_all_with_target"] if extra is not None else [])
        return [F.lit(0).cast("long").alias(f"{name}|{f}") if f == "columns" else F.count_if(F.lit(False)).alias(f"{name}|{f}") for f in fields]
    any_ = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    all_ = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in columns])
    out = [F.lit(len(columns)).cast("long").alias(f"{name}|columns"), F.count_if(any_).alias(f"{name}|rows_any"), F.count_if(all_).alias(f"{name}|rows_all"), F.coalesce(F.sum(nulls), F.lit(0)).alias(f"{name}|null_values")]
    return out + ([F.count_if(all_ & extra).alias(f"{name}|rows_all_with_target")] if extra is not None else [])


_FIELDS = {"columns": "long", "rows_any": "long", "rows_all": "long", "null_values": "long"}


def bucket_report(df: DataFrame, buckets: dict[str, list[str]]) -> DataFrame:
    """bucket, columns, rows_any, rows_all, null_values; a bucket without columns has zeros."""
    wide = df.agg(*[c for k, v in buckets.items() for c in _availability(k, v)])
    return _rows(wide, list(buckets), _FIELDS).withColumnRenamed("name", "bucket")


def bucket_split_report(df: DataFrame, buckets: dict[str, list[str]], target: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """The bucket report for each split, and rows that are whole and have the target; splits without rows have zeros."""
    own = df.groupBy("split").agg(F.count("*").alias("n_rows"), *[c for k, v in buckets.items() for c in _availability(k, v, F.col(target).isNotNull())])
    named = df.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    both = named.join(own, "split", "left")
    fields = _FIELDS | {"rows_all_with_target": "long"}
    items = F.array(*[F.struct(F.lit(k).alias("bucket"), *[F.coalesce(F.col(f"`{k}|{f}`").cast(t), F.lit(len(v) if f == "columns" else 0).cast(t)).alias(f) for f, t in fields.items()]) for k, v in buckets.items()])
    return both.select("split", F.coalesce("n_rows", F.lit(0).cast("long")).alias("split_rows"), F.explode(items).alias("x")).select("split", "split_rows", "x.*")


def policy_report(df: DataFrame, optional: list[str]) -> DataFrame:
    """feature, status: skipped (all null), partial (some null) or available."""
    wide = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"{c}|have") for c in optional])
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(F.col(f"`{c}|have`") == 0, "skipped").when(F.col(f"`{c}|have`") < F.col("n"), "partial").otherwise("available").alias("status")) for c in optional])
    return wide.select(F.explode(items).alias("x")).select("x.*")


def target_report(df: DataFrame, horizons: tuple[int, ...] = (5, 21)) -> DataFrame:
    """horizon and, for its target and winner flag, what is available, null, at odds or invalid."""
    out, fields = [], {}
    for h in horizons:
        t, w = F.col(f"target_{h}d"), F.col(f"winner_{h}d")
        counts = {
            "target_available": t.isNotNull(), "target_null": t.isNull(), "winner_available": w.isNotNull(), "winner_null": w.isNull(),
            "unexpected_winner_nulls": t.isNotNull() & w.isNull(), "unexpected_winner_values": t.isNull() & w.isNotNull(), "invalid_winner_values": ~w.isin(0, 1),
        }
        fields = dict.fromkeys(counts, "long")
        out += [F.count_if(F.coalesce(v, F.lit(False))).alias(f"{h}d|{k}") for k, v in counts.items()]
    return _rows(df.agg(*out), [f"{h}d" for h in horizons], fields).withColumnRenamed("name", "horizon")


def unclassified(columns: list[str], buckets: dict[str, list[str]], keys: tuple[str, ...] = ("ticker", "date", "split"), prefixes: tuple[str, ...] = ("target_", "winner_")) -> list[str]:
    known = {c for v in buckets.values() for c in v} | set(keys)
    return [c for c in columns if c not in known and not c.startswith(prefixes)]


def is_valid(duplicates: int, null_keys: int, targets: list[dict]) -> bool:
    """A panel is valid without duplicate or null keys and without winner flags at odds with their targets."""
    return not duplicates and not null_keys and not any(t["unexpected_winner_nulls"] or t["unexpected_winner_values"] or t["invalid_winner_values"] for t in targets)


def table_report(df: DataFrame, name: str, date_col: str | None, entity_col: str | None) -> DataFrame:
    """table_name, rows, min_date, max_date, entity_column, distinct_entities of one table."""
    day = F.col(date_col).cast("date") if date_col else F.lit(None).cast("date")
    return df.agg(F.count("*").alias("n_rows"), F.min(day).alias("min_date"), F.max(day).alias("max_date"), (F.countDistinct(entity_col) if entity_col else F.lit(None).cast("long")).alias("distinct_entities")).select(F.lit(name).alias("table_name"), "n_rows", "min_date", "max_date", F.lit(entity_col).cast("string").alias("entity_column"), "distinct_entities")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """duplicate_keys: how many keys have more than one row."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("duplicate_keys"))


def freshness(local_max: DataFrame, api_max: DataFrame, allowed: int = 0) -> DataFrame:
    """table_name, local_max, api_max, lag_days, fresh of the tables in both (table_name, max_date)."""
    both = local_max.withColumnRenamed("max_date", "local_max").join(F.broadcast(api_max.withColumnRenamed("max_date", "api_max")), "table_name")
    return both.withColumn("lag_days", F.datediff("api_max", "local_max").cast("long")).withColumn("fresh", F.coalesce(F.col("lag_days") <= allowed, F.lit(False)))
