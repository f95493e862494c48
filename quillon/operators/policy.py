"""Public-policy signals: entity resolution, the policy graph, activity and relevance scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import BILL_ACTION_WEIGHTS, ROLE_WEIGHTS, SECTOR_KEYWORDS, keyword_hits, name_score, normal_name, weight_of


def bill_activity(actions: DataFrame, entity: str = "entity", days: tuple[int, ...] = (30, 90)) -> DataFrame:
    """entity, date, bill_activity_{d}d: weighted actions (entity, action, date) of the last d days, the day included."""
    daily = actions.groupBy(entity, "date").agg(F.sum(weight_of(F.col("action"), BILL_ACTION_WEIGHTS)).alias("_w"))
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long")
    w = Window.partitionBy(entity).orderBy(day)
    return daily.withColumns({f"bill_activity_{d}d": F.sum("_w").over(w.rangeBetween(-(d - 1), 0)) for d in days}).drop("_w")


def keyword_relevance(bills: DataFrame, text: str = "text", keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """bills with relevance_{sector}: how many of the sector's keywords the text holds."""
    return bills.withColumns({f"relevance_{k}": keyword_hits(F.coalesce(F.col(text), F.lit("")), v) for k, v in (keywords or SECTOR_KEYWORDS).items()})


def committee_relevance(assignments: DataFrame, overlaps: DataFrame, dates: DataFrame) -> DataFrame:
    """date, company, committee_relevance_score: role weight x overlap of the memberships in force on each date.

    assignments: member, committee, role, start, end (null: still in force); overlaps: committee, company, overlap.
    Memberships become signed changes at their start and after their end, summed by committee and carried forward in
    order, so that no date is joined with every membership. One without a start, or that ends before it starts, is never
    in force. A company whose committee is null has a row with 0.
    """
    weight = weight_of(F.col("role"), ROLE_WEIGHTS)
    held = assignments.where("start IS NOT NULL AND (end IS NULL OR end >= start)")
    begin = held.select("committee", F.col("start").alias("date"), weight.alias("w"))
    stop = held.where("end IS NOT NULL").select("committee", F.date_add("end", 1).alias("date"), (-weight).alias("w"))
    asked = dates.select("date").where("date IS NOT NULL").distinct()
    grid = asked.join(F.broadcast(overlaps.select("committee").where("committee IS NOT NULL").distinct())).select("committee", "date", F.lit(0.0).alias("w"), F.lit(True).alias("asked"))
    both = begin.unionByName(stop).groupBy("committee", "date").agg(F.sum("w").alias("w")).withColumn("asked", F.lit(False)).unionByName(grid)
    w = Window.partitionBy("committee").orderBy("date")
    power = both.withColumn("power", F.sum("w").over(w)).where("asked").select("committee", "date", "power")
    every = overlaps.join(F.broadcast(dates.select("date").distinct())).join(power, ["committee", "date"], "left")
    return every.groupBy("date", "company").agg(F.sum(F.coalesce("power", F.lit(0.0)) * F.col("overlap")).alias("committee_relevance_score"))


def concentration(awards: DataFrame, entity: str, part: str, amount: str) -> DataFrame:
    """entity, top_share, hhi: the largest share of its amount by one part, and the sum of squared shares."""
    parts = awards.groupBy(entity, part).agg(F.sum(amount).alias("_a"))
    share = F.try_divide(F.col("_a"), F.sum("_a").over(Window.partitionBy(entity)))
    return parts.withColumn("_s", share).groupBy(entity).agg(F.max("_s").alias("top_share"), F.sum(F.col("_s") * F.col("_s")).alias("hhi"))


def edges(parts: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """src, dst, edge_type, weight: parts maps an edge type to (frame with weight, source column, target column)."""
    out = None
    for kind, (df, a, b) in parts.items():
        own = df.select(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"), F.lit(kind).alias("edge_type"), F.col("weight").cast("double").alias("weight"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("src", "dst", "edge_type").agg(F.sum("weight").alias("weight"))


def two_hop(edge: DataFrame, first: str, second: str) -> DataFrame:
    """src, dst, paths, weight over an edge of type ``first`` and one of type ``second``.

    Products of weights are summed; edges are combined by node before they meet, so a node's pairs are distinct ones.
    """
    a = edge.where(F.col("edge_type") == first).select("src", F.col("dst").alias("mid"), F.col("weight").alias("wa"))
    b = edge.where(F.col("edge_type") == second).select(F.col("src").alias("mid"), "dst", F.col("weight").alias("wb"))
    return a.join(b, "mid").groupBy("src", "dst").agg(F.count("*").alias("paths"), F.sum(F.col("wa") * F.col("wb")).alias("weight"))


def fuzzy_matches(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """left_id, right_id, score: the best right name for each left one, of names that sound alike in their first word.

    left and right: id, name. A block is a soundex code of the first word and a length, which splits the large codes; a left
    name is sought in the blocks of every length that the least score allows, so each pair meets once. Equal names on either
    side are compared once.
    """
    key = lambda c: F.soundex(F.split(F.col(c), " ")[0])
    a = left.select(F.col("id").alias("left_id"), normal_name(F.col("name")).alias("na"))
    b = right.select(normal_name(F.col("name")).alias("nb"), "id").groupBy("nb").agg(F.min("id").alias("right_id"))
    size = F.length("na")
    near = F.sequence(F.ceil(size * least).cast("int"), F.floor(size / least).cast("int"))
    sought = a.select("na").distinct().withColumns({"k": key("na"), "n": F.explode(near)})
    pairs = sought.join(b.withColumns({"k": key("nb"), "n": F.length("nb")}), ["k", "n"]).where(F.abs(F.length("na") - F.length("nb")) <= (1 - least) * F.greatest(F.length("na"), F.length("nb")))
    scored = pairs.withColumn("score", name_score(F.col("na"), F.col("nb"))).where(F.col("score") >= least)
    best = scored.groupBy("na").agg(F.max(F.struct("score", (-F.col("right_id")).alias("r"))).alias("x"))
    return a.join(best, "na").select("left_id", (-F.col("x.r")).alias("right_id"), F.col("x.score").alias("score"))


def cascade(records: DataFrame, companies: DataFrame, fuzzy_least: float = 0.8) -> DataFrame:
    """record_id, company_id, method, confidence: the first of ticker, cik, exact name, fuzzy name that matches.

    records and companies: id, ticker, cik, name. Each step sees only what the steps before left over; a key that several
    companies have gives the smallest id.
    """
    left, out = records, None
    for method, key, confidence in (("ticker", F.col("ticker"), 1.0), ("cik", F.col("cik"), 0.99), ("exact_name", normal_name(F.col("name")), 0.95)):
        one = companies.select(key.alias("_k"), F.col("id").alias("company_id")).where("_k IS NOT NULL AND _k <> ''").groupBy("_k").agg(F.min("company_id").alias("company_id"))
        hit = left.withColumn("_k", key).join(one, "_k").select(F.col("id").alias("record_id"), "company_id", F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))
        out = hit if out is None else out.unionByName(hit)
        left = left.join(hit.select(F.col("record_id").alias("id")), "id", "left_anti")
    fuzzy = fuzzy_matches(left, companies, fuzzy_least).select(F.col("left_id").alias("record_id"), F.col("right_id").alias("company_id"), F.lit("fuzzy_name").alias("method"), F.col("score").alias("confidence"))
    return out.unionByName(fuzzy)


def review_queue(records: DataFrame, resolved: DataFrame, sure: float = 0.9) -> DataFrame:
    """record_id, reason: records that nothing matched, or only with less confidence than ``sure``."""
    none = records.select(F.col("id").alias("record_id")).join(resolved.select("record_id"), "record_id", "left_anti").withColumn("reason", F.lit("unmatched"))
    return none.unionByName(resolved.where(F.col("confidence") < sure).select("record_id", F.lit("low_confidence").alias("reason")))
