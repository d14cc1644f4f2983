"""Chat formatting: tool calls linked with their results, ordered, validated and serialised as canonical JSON.

A message whose text is a JSON object with ``tool_calls``, a list of {id, name, arguments}, makes calls;
one of role ``tool`` whose text is an object with ``tool_call_id`` is a result. Results meet calls in a
hash join on (conversation, id). The order is topological: a result stands no earlier than the message
that calls it, all else by turn. Arguments are checked against the tools' schemas.

Everything is DataFrame functions. The result is a row per message with its sort key, not a row per
conversation, so that a conversation of any length is no group of one task: the only exchanges are on
(conversation, id) of the calls and results, and on the calling messages. Schemas are a parameter, of
MAX_TOOLS at most, and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

#: Tools that may be given; their table is broadcast.
MAX_TOOLS = 10_000
#: Tools of the registered query: name: {argument: (JSON type, whether it is required)}.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
    "read_file": {"path": ("string", True), "lines": ("array", False)},
}

ROLES = ("system", "user", "assistant", "tool")
CALLS = "array<struct<id:string,name:string,arguments:string>>"


def json_type(value: Column) -> Column:
    """JSON type of a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null").when((kind == "BIGINT") | kind.rlike(r"^DECIMAL\([0-9]+,0\)$"), "integer").otherwise("number")
    )


def problems(arguments: Column, schema: Column) -> Column:
    """What is wrong with a call's arguments, by argument; schema: array of (argument, type, required), null for an unknown tool."""
    given = F.coalesce(F.from_json(arguments, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    entries = F.map_entries(given)
    kinds = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), json_type(e["value"]).alias("type")))
    fits = lambda have, want: (have == want) | ((want == "number") & (have == "integer"))
    missing = F.transform(F.filter(schema, lambda s: s["required"] & ~F.exists(kinds, lambda k: k["key"] == s["argument"])), lambda s: F.concat(s["argument"], F.lit(": missing")))
    wrong = F.transform(F.filter(kinds, lambda k: F.exists(schema, lambda s: (s["argument"] == k["key"]) & ~fits(k["type"], s["type"]))), lambda k: F.concat(k["key"], F.lit(": not of its type")))
    unknown = F.transform(F.filter(kinds, lambda k: ~F.exists(schema, lambda s: s["argument"] == k["key"])), lambda k: F.concat(k["key"], F.lit(": not in the schema")))
    parsed = F.try_parse_json(arguments)
    readable = arguments.isNull() | parsed.isNotNull()
    return (
        F.when(schema.isNull(), F.array(F.lit("unknown tool"))).when(~readable, F.array(F.lit("arguments: not JSON, or with a repeated key")))
        .when(arguments.isNotNull() & (json_type(parsed) != "object"), F.array(F.lit("arguments: not an object"))).otherwise(F.array_sort(F.concat(missing, wrong, unknown)))
    )


def format_messages(messages: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """Per message: conv_id, turn, role, order_turn, order_rank, n_calls, n_answered, problems, linked, message.

    Sorted by (conv_id, order_turn, order_rank, turn, message) a conversation is in topological order.
    message is JSON with sorted keys and no spaces; arguments too. linked: whether a result's call is
    known (null for other messages). Of calls of one id in one conversation the first counts, the
    others are noted in problems, and stay. Arguments that are a string hold their JSON, as some
    interfaces send them; those that aren't an object, or repeat a key, are a problem, and what can't be
    parsed stays as a string. Numbers without a fraction, 1.0 too, are integers.
    Fields of a message other than content, tool_calls and tool_call_id are not part of the format.
    Results of one call stay each. Null texts have no content;
    text that isn't such JSON is content; a null id or conversation links with nothing. Equal rows
    stay each; an empty table gives no rows; other columns than conv_id, turn, role, text aren't read.
    """
    if len(tools) > MAX_TOOLS:
        raise ValueError(f"more than {MAX_TOOLS} tools")
    spark = messages.sparkSession
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    looks = F.ltrim("text").startswith("{")
    calls = F.when(looks & (F.col("role") == "assistant"), F.from_json(F.get_json_object("text", "$.tool_calls"), CALLS))
    result_of = F.when(looks & (F.col("role") == "tool"), F.get_json_object("text", "$.tool_call_id"))
    rows = rows.select("*", F.filter(F.coalesce(calls, F.array().cast(CALLS)), lambda c: c.isNotNull()).alias("calls"), result_of.alias("result_of"))
    rows = rows.select("*", F.when((F.size("calls") > 0) | F.col("result_of").isNotNull(), F.coalesce(F.get_json_object("text", "$.content"), F.lit(""))).otherwise(F.col("text")).alias("content"))
    talk = rows.where((F.size("calls") == 0) & F.col("result_of").isNull())
    asks, results = rows.where(F.size("calls") > 0), rows.where((F.size("calls") == 0) & F.col("result_of").isNotNull())

    each = asks.select("conv_id", "turn", F.posexplode("calls").alias("k", "c")).where("conv_id is not null and c.id is not null").select("conv_id", F.col("c.id").alias("id"), "turn", "k")
    first = each.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "k")).alias("first"))
    answers = results.groupBy("conv_id", F.col("result_of").alias("id")).agg(F.count("*").alias("answers"))
    linked = results.join(first.select("conv_id", F.col("id").alias("result_of"), F.col("first.turn").alias("call_turn")), ["conv_id", "result_of"], "left")
    message = lambda *more: F.to_json(F.struct(F.coalesce("content", F.lit("")).alias("content"), F.col("role"), *more))
    none = F.array().cast("array<string>")
    done = ["conv_id", "turn", "role"]
    linked = linked.select(*done, F.greatest("turn", "call_turn").alias("order_turn"), F.when(F.col("call_turn") >= F.col("turn"), 1).otherwise(0).alias("order_rank"), F.lit(0).alias("n_calls"), F.lit(0).cast("bigint").alias("n_answered"), none.alias("problems"), F.col("call_turn").isNotNull().alias("linked"), message(F.col("result_of").alias("tool_call_id")).alias("message"))
    plain = talk.select(*done, F.col("turn").alias("order_turn"), F.lit(0).alias("order_rank"), F.lit(0).alias("n_calls"), F.lit(0).cast("bigint").alias("n_answered"), none.alias("problems"), F.lit(None).cast("boolean").alias("linked"), message().alias("message"))

    schemas = [(name, [(a, t, bool(r)) for a, (t, r) in arguments.items()]) for name, arguments in tools.items()]
    schemas = F.broadcast(spark.createDataFrame(schemas, "name string, schema array<struct<argument:string,type:string,required:boolean>>"))
    calling = asks.withColumn("row", F.monotonically_increasing_id()).select("row", *done, "content", F.posexplode("calls").alias("k", "c"))
    calling = calling.select("*", F.col("c.id").alias("id"), F.col("c.name").alias("name")).join(schemas, "name", "left").join(first, ["conv_id", "id"], "left").join(answers, ["conv_id", "id"], "left")
    found = F.concat(problems(F.col("c.arguments"), F.col("schema")), F.when(F.col("id").isNull(), F.array(F.lit("no id"))).when(F.col("name").isNull(), F.array(F.lit("no name"))).when((F.col("first.turn") != F.col("turn")) | (F.col("first.k") != F.col("k")), F.array(F.lit("an id used before"))).otherwise(none))
    raw = F.coalesce(F.col("c.arguments"), F.lit("{}"))
    # what can't be parsed stays as a string
    call = F.struct(F.coalesce(F.try_parse_json(raw), raw.cast("variant")).alias("arguments"), F.col("id"), F.col("name"))
    calling = calling.groupBy("row", *done, "content").agg(F.array_sort(F.collect_list(F.struct("k", F.to_json(call).alias("call"), F.transform(found, lambda p: F.concat_ws(" ", "name", p)).alias("found")))).alias("each"), F.sum(F.when(F.col("answers") > 0, 1).otherwise(0)).cast("bigint").alias("n_answered"))
    whole = F.concat(F.substring(message(), F.lit(1), F.length(message()) - 1), F.lit(',"tool_calls":['), F.array_join(F.col("each.call"), ","), F.lit("]}"))
    calling = calling.select(*done, F.col("turn").alias("order_turn"), F.lit(0).alias("order_rank"), F.size("each").alias("n_calls"), "n_answered", F.flatten("each.found").alias("problems"), F.lit(None).cast("boolean").alias("linked"), whole.alias("message"))
    return plain.unionByName(linked).unionByName(calling)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_messages(table(spark, sf_dir, "conversations"), TOOLS)
    return out.withColumn("problems", F.array_join("problems", ";"))


#: For conversations without tool calls, as those of the tables are; calls and results are tested against brute force.
SQL = """
SELECT conv_id, turn, role, turn AS order_turn, 0 AS order_rank, 0 AS n_calls, CAST(0 AS BIGINT) AS n_answered, '' AS problems,
       CAST(NULL AS BOOLEAN) AS linked, CAST(to_json(struct_pack(content := coalesce(text, ''), role := role)) AS VARCHAR) AS message
FROM conversations
"""
