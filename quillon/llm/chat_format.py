"""Chat formatting [native]: tool calls linked to their results, ordered, validated and written as canonical JSON.

A turn whose text is a JSON object may hold calls, ``{"tool_calls": [{"id", "name", "arguments", "depends_on"?}], ...}``,
or be a result, ``{"tool_call_id", "content"}``. Calls and results of a conversation are hash-joined by identifier.
The order is topological: a result comes after its call and a call after the results it depends on; levels are peeled
off round by round (a round for each step of the longest chain of dependencies), and calls left over lie on a cycle.
Arguments are checked against a table of parameters (tool, param, type, required). JSON is canonical: names sorted, no
white space, absent values left out, equal values written alike.

The result has a row for each turn, so no conversation is gathered in one task however long it is. Turns in the order of
(conv_id, anchor, level, is_result, turn) are the conversation.

``status``: ``message`` (no tool call), ``linked`` or ``unanswered`` (calls), ``result``, ``orphan_result`` (no such
call), ``cycle``; ``errors`` lists, sorted, ``duplicate_id:``, ``unknown_dependency:``, ``unknown_tool:``, ``missing:``,
``unexpected:`` and ``type:`` of calls. Defined cases: null text, invalid JSON and other JSON are messages; a null role is
left out of the JSON; a null conv_id or turn links with nothing; a call id used again in a conversation keeps its first
turn; repeated rows give a row each. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, small, table

#: Parameters of the tools that conversations may call; the type is a JSON type's name.
TOOLS = [
    ("search", "query", "string", True), ("search", "limit", "integer", False),
    ("calculator", "expression", "string", True),
    ("weather", "city", "string", True), ("weather", "days", "integer", False),
]
_ID = ["conv_id", "call_id"]


def _kind(value: str) -> Column:
    s = F.expr(f"schema_of_variant({value})")
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "BIGINT", "integer")
        .when(s.isin("DOUBLE", "FLOAT") | s.startswith("DECIMAL"), "number").otherwise("null")
    )


def _checked(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """conv_id, call_id, error: what is wrong with the arguments of each call."""
    n = tools.count()
    known, tools = small(tools.select("tool").distinct(), n), small(tools, n)
    unknown = calls.join(known, F.col("name") == F.col("tool"), "left_anti").select(*_ID, F.concat(F.lit("unknown_tool:"), F.coalesce("name", F.lit(""))).alias("error"))
    given = calls.join(known, F.col("name") == F.col("tool")).select(*_ID, "tool", F.expr("try_variant_get(args, '$', 'map<string,variant>')").alias("m"))
    pairs = given.select(*_ID, "tool", F.explode("m").alias("param", "value")).withColumn("kind", _kind("value")).drop("value")
    typed = pairs.join(tools, ["tool", "param"], "left")
    wrong = typed.select(*_ID, F.when(F.col("type").isNull(), F.concat(F.lit("unexpected:"), "param")).when((F.col("type") != F.col("kind")) & ~((F.col("type") == "number") & (F.col("kind") == "integer")), F.concat(F.lit("type:"), "param")).alias("error")).where("error is not null")
    need = given.join(small(tools.where("required").select("tool", "param"), n), "tool")
    missing = need.where(~F.coalesce(F.array_contains(F.map_keys("m"), F.col("param")), F.lit(False))).select(*_ID, F.concat(F.lit("missing:"), "param").alias("error"))
    return unknown.unionByName(wrong).unionByName(missing)


def _levels(calls: DataFrame, results: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, call_id, anchor, level of all calls that lie on no cycle.

    anchor: the latest turn that the call must follow, its own included; level: dependencies below it.
    """
    answered = results.groupBy(*_ID).agg(F.max("turn").alias("answered"))
    free = calls.join(edges.select(*_ID).distinct(), _ID, "left_anti").select(*_ID, F.col("turn").alias("anchor"), F.lit(0).alias("level"))
    parts = [materialize(free.select(*_ID, "anchor", "level"), "levels")]
    while True:
        if len(parts) > 8:  # rounds are added to what there is, and written anew together from time to time
            whole = materialize(reduce(DataFrame.unionByName, parts), "levels")
            release(*parts)
            parts = [whole]
        done = reduce(DataFrame.unionByName, parts)
        met = edges.join(done.select("conv_id", F.col("call_id").alias("dep"), F.col("anchor").alias("a"), F.col("level").alias("l")), ["conv_id", "dep"], "left")
        met = met.join(answered.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left")
        ready = met.groupBy(*_ID).agg(F.count("*").alias("n"), F.count("l").alias("have"), F.max(F.greatest("a", F.coalesce("answered", "a"))).alias("a"), F.max("l").alias("l")).where("n = have")
        ready = ready.join(done.select(*_ID), _ID, "left_anti").join(calls.select(*_ID, "turn"), _ID).select(*_ID, F.greatest("turn", "a").alias("anchor"), (F.col("l") + 1).alias("level"))
        new = materialize(ready, "ready")
        if new.isEmpty():
            release(new)
            return done
        parts.append(new)


def formatted(turns: DataFrame, tools: DataFrame) -> DataFrame:
    """conv_id, turn, anchor, level, is_result, status, errors, json: a row for each turn of turns(conv_id, turn, role, text)."""
    base = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    looks = F.coalesce(F.col("text").rlike(r"^\s*\{[\s\S]*\"tool_call(?:s|_id)\""), F.lit(False))
    parsed = base.withColumn("v", F.when(looks, F.try_parse_json("text")))
    parsed = parsed.withColumns({"listed": F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')"), "answers": F.expr("try_variant_get(v, '$.tool_call_id', 'string')")})
    role = F.struct(F.col("text").alias("content"), "role")
    plain = parsed.where("listed is null and answers is null").select("conv_id", "turn", F.col("turn").alias("anchor"), F.lit(0).alias("level"), F.lit(False).alias("is_result"), F.lit("message").alias("status"), F.array().cast("array<string>").alias("errors"), F.to_json(role).alias("json"))
    tool = parsed.where("listed is not null or answers is not null")
    if tool.isEmpty():
        return plain
    tool = materialize(tool.select("conv_id", "turn", "role", F.to_json("v").alias("v"), F.transform("listed", lambda x: F.to_json(x)).alias("listed"), "answers").withColumn("row", F.monotonically_increasing_id()), "tools").withColumn("v", F.try_parse_json("v"))
    said = tool.where("listed is not null").select("row", "conv_id", "turn", F.posexplode("listed").alias("place", "c")).withColumn("c", F.try_parse_json("c"))
    said = said.select("row", "conv_id", "turn", "place", F.expr("try_variant_get(c, '$.id', 'string')").alias("call_id"), F.expr("try_variant_get(c, '$.name', 'string')").alias("name"), F.expr("try_variant_get(c, '$.arguments', 'variant')").alias("args"), F.expr("try_variant_get(c, '$.depends_on', 'array<string>')").alias("deps"))
    first = said.where("call_id is not null and conv_id is not null and turn is not null").groupBy(*_ID).agg(F.min(F.struct("turn", "row", "place")).alias("f")).select(*_ID, "f.row", "f.place")
    calls = said.join(first, [*_ID, "row", "place"])
    again = said.where("call_id is not null").join(first, [*_ID, "row", "place"], "left_anti").select("row", F.concat(F.lit("duplicate_id:"), "call_id").alias("error"))
    results = tool.where("listed is null and answers is not null").select("row", "conv_id", "turn", F.col("answers").alias("call_id"))
    asked = calls.select(*_ID, F.explode(F.array_distinct("deps")).alias("dep"))
    there = calls.select("conv_id", F.col("call_id").alias("dep"))
    edges = asked.join(there.hint("shuffle_hash"), ["conv_id", "dep"], "left_semi")
    lost = asked.join(there, ["conv_id", "dep"], "left_anti").select(*_ID, F.concat(F.lit("unknown_dependency:"), "dep").alias("error"))
    levels = _levels(calls, results, edges)
    errors = lost.unionByName(_checked(calls, tools)).join(calls.select(*_ID, "row"), _ID).select("row", "error").unionByName(again)
    by_row = errors.groupBy("row").agg(F.array_sort(F.collect_set("error")).alias("errors"))
    state = calls.select(*_ID, "row").join(levels, _ID, "left").join(results.select(*_ID).distinct().withColumn("yes", F.lit(True)), _ID, "left")
    per_turn = state.groupBy("row").agg(F.max("anchor").alias("a"), F.max("level").alias("l"), F.max(F.col("level").isNull()).alias("cycle"), F.min(F.coalesce("yes", F.lit(False))).alias("all_answered"))
    of_call = results.join(levels.hint("shuffle_hash"), _ID, "left").join(calls.select(*_ID, F.col("turn").alias("call_turn")), _ID, "left").select("row", F.col("anchor").alias("ra"), F.col("level").alias("rl"), "call_turn")
    out = tool.join(per_turn, "row", "left").join(of_call, "row", "left").join(by_row, "row", "left")
    is_result = F.col("listed").isNull()
    status = (
        F.when(is_result & F.col("call_turn").isNull(), "orphan_result").when(is_result, "result")
        .when(F.coalesce("cycle", F.lit(False)), "cycle").when(F.coalesce("all_answered", F.lit(False)), "linked").otherwise("unanswered")
    )
    json = F.concat(F.lit('{"message":'), F.to_json("v"), F.when(F.col("role").isNotNull(), F.concat(F.lit(',"role":'), F.expr("substring(to_json(array(role)), 2, length(to_json(array(role))) - 2)"))).otherwise(F.lit("")), F.lit("}"))
    anchor = F.greatest("turn", F.coalesce("a", "turn"), F.coalesce("ra", "call_turn", "turn"))
    linked = out.select("conv_id", "turn", anchor.alias("anchor"), F.coalesce("l", "rl", F.lit(0)).alias("level"), is_result.alias("is_result"), status.alias("status"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), json.alias("json"))
    return plain.unionByName(linked)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame(TOOLS, "tool string, param string, type string, required boolean")
    out = formatted(table(spark, sf_dir, "conversations"), tools)
    return out.withColumn("errors", F.array_join("errors", ","))


OP4_SQL = r"""
SELECT conv_id, turn, turn AS anchor, 0 AS level, FALSE AS is_result, 'message' AS status, '' AS errors,
       CAST(json_object('content', text, 'role', role) AS VARCHAR) AS json
FROM conversations
"""
