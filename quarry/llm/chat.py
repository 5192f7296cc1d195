"""Chat formatting: tool calls linked to results, ordered, validated, in canonical JSON. DataFrame functions only.

A message whose text is a JSON object with tool_calls (a list of id, name, arguments and, optionally,
after: ids it waits for) makes calls; one with tool_call_id is a result. Others are plain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, row_hash

#: Argument names of the known tools, with their types in JSON and whether they are required.
TOOLS = {
    "search": {"query": ("STRING", True), "limit": ("BIGINT", False)},
    "calculator": {"expression": ("STRING", True)},
    "weather": {"city": ("STRING", True), "days": ("BIGINT", False)},
    "fetch": {"url": ("STRING", True), "timeout": ("BIGINT", False), "headers": ("OBJECT", False)},
}
_ENDLESS = 1 << 40  # longer than any chain; jumps along a circle stop growing there
_FIELDS = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>, tool_call_id string"


def _schema_table(spark, tools: dict) -> DataFrame:
    """One row a tool: as many as the caller lists."""
    rows = [(t, [a for a, (_, need) in args.items() if need], {a: kind for a, (kind, _) in args.items()}) for t, args in tools.items()]
    return spark.createDataFrame(rows, "name string, required array<string>, types map<string,string>")


def _checked(calls: DataFrame, tools: dict) -> DataFrame:
    """calls with valid: a known tool, all required arguments, no unknown ones, types as declared."""
    c = calls.join(_schema_table(calls.sparkSession, tools), "name", "left")
    v = F.try_parse_json("arguments")
    c = c.withColumn("is_object", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    c = c.withColumn("given", F.when(F.col("is_object"), F.transform_values(v.cast("map<string,variant>"), lambda _, x: F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0))))
    fits = F.forall(F.map_entries("given"), lambda e: F.coalesce(F.col("types")[e["key"]] == e["value"], F.lit(False)))
    whole = F.size(F.array_except("required", F.map_keys("given"))) == 0
    valid = F.col("types").isNotNull() & F.col("is_object") & F.coalesce(fits, F.lit(False)) & F.coalesce(whole, F.lit(False))
    return c.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("required", "types", "is_object", "given")


def _depths(calls: DataFrame) -> DataFrame:
    """conv_id, id, depth of calls: 0 without known predecessors, else one more than the deepest; null in a circle or behind one.

    calls: a row for each conv_id and id. A call's depth is the greatest of least and of depth(on) + far
    over its open waits. A round settles calls with no open waits, puts settled depths into what waits
    for them, and lets a wait for a call that has a single open wait jump to that one, so that chains
    of n calls take log2(n) rounds. Waits may jump to what has just settled, so of open calls that no
    circle holds up one settles in every second round; when two rounds settle none, all that are left
    are in or behind circles.
    """
    key = ["conv_id", "id"]
    own = calls.select(*key, "after")
    waits = own.select(*key, F.explode(F.array_distinct("after")).alias("on")).join(own.select("conv_id", F.col("id").alias("on")), ["conv_id", "on"])
    waits = checkpointed(waits.select(*key, "on", F.lit(1).cast("long").alias("far")))
    state = own.select(*key, F.lit(0).cast("long").alias("least"))
    done, idle = calls.sparkSession.createDataFrame([], "conv_id long, id string, depth long"), False
    while True:
        open_waits = waits.groupBy(*key).agg(F.count("*").alias("n"), F.min("on").alias("next"), F.max("far").alias("step"))
        state = checkpointed(state.join(open_waits, key, "left"))
        settled = state.where("n is null").select(*key, F.col("least").alias("depth"))
        none = settled.isEmpty()
        if none and idle:
            return done
        done, idle = done.unionByName(settled), none
        if waits.isEmpty():
            return done
        at = state.where("n is not null").select("conv_id", F.col("id").alias("on"), F.col("least").alias("low"), "n", "next", "step")
        at = at.unionByName(done.select("conv_id", F.col("id").alias("on"), F.col("depth").alias("low")), allowMissingColumns=True)
        jumps, held = (F.col("n") == 1) & (F.col("next") != F.col("on")), lambda x: F.least(x, F.lit(_ENDLESS))
        moved = checkpointed(waits.join(at, ["conv_id", "on"]).select(
            *key, F.when(jumps, F.col("next")).when(F.col("n") > 0, F.col("on")).alias("on"),
            F.when(jumps, held(F.col("far") + F.col("step"))).otherwise(F.col("far")).alias("far"), held(F.col("low") + F.col("far")).alias("low"),
        ))
        raised = moved.groupBy(*key).agg(F.max("low").alias("low"))
        state = state.where("n is not null").join(raised, key, "left").select(*key, F.greatest("least", "low").alias("least"))
        waits = checkpointed(moved.where("on is not null").groupBy(*key, "on").agg(F.max("far").alias("far")))


def format_chats(messages: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """A row for each message: conv_id, turn, role, kind, place, depth, n_calls, n_linked, n_invalid, message.

    messages: conv_id long, turn long, role string, text string; other columns are ignored. kind is
    plain, calls or result. place and depth order a conversation: a result's place is its call's turn
    at least, a call's depth follows the calls it waits for, a result is one deeper than its call; a
    call that waits for itself, however indirectly, has depth null, and so have its result, its message and what waits for it. n_linked: results found for its
    calls, or 1 for a result whose call exists. n_invalid: calls whose arguments fail their tool's
    schema, each call by itself; unknown tools fail. message is canonical JSON: fields in order of name, no blanks, JSON
    payloads likewise.

    Null text is an empty plain message; null role stays out of the JSON. Text that isn't a JSON object, blanks
    around it aside, or malformed, is plain. Of calls with one id in a conversation the earliest (by turn, then row, then
    place in the message; a null turn is last) says what they wait for. Calls without an id have no results, and nothing waits for them;
    a null in tool_calls is a call without id, name and arguments. A null turn stays null unless a result's call has one, and is no bar to a
    link. Null conv_id is one conversation. Repeated rows each have a row, as alike as they are; their calls are one call. Empty input: no rows.
    """
    m = messages.select(F.coalesce("conv_id", F.lit(-(1 << 62))).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    json = F.when(F.ltrim("text", F.lit(" \t\n\r")).startswith("{"), F.try_parse_json("text"))
    typed = F.when(json.isNotNull(), F.from_json("text", _FIELDS))
    m = m.withColumn("row", row_hash("conv_id", "turn", "role", "text")).withColumn("x", typed)
    has_calls = F.coalesce(F.size("x.tool_calls") > 0, F.lit(False))
    kind = F.when(has_calls, "calls").when(F.col("x.tool_call_id").isNotNull(), "result").otherwise("plain")
    m = m.withColumn("kind", kind)
    calls = m.where("kind = 'calls'").select("conv_id", "turn", "row", F.posexplode("x.tool_calls").alias("pos", "c")).select("conv_id", "turn", "row", "pos", "c.*")
    known = lambda x: F.concat(F.lit("id "), x)  # noqa: E731 - no id looks like the place of a call without one
    calls = calls.withColumn("id", F.coalesce(known(F.col("id")), F.concat_ws(" ", F.lit("at"), F.hex("row"), "pos"))).withColumn("after", F.transform("after", known))
    calls = checkpointed(_checked(calls, tools))
    results = m.where("kind = 'result'").select("conv_id", known(F.col("x.tool_call_id")).alias("id"), "row")
    first = calls.groupBy("conv_id", "id").agg(F.min("turn").alias("call_turn"), F.min_by("after", F.struct(F.col("turn").isNull(), "turn", "row", "pos")).alias("after"))
    found = results.groupBy("conv_id", "id").agg(F.count("*").alias("found"))
    linked = first.join(_depths(first), ["conv_id", "id"], "left").join(found, ["conv_id", "id"], "left")
    linked = checkpointed(linked.select("conv_id", "id", "call_turn", "depth", F.coalesce("found", F.lit(0)).alias("found")))
    sums = [F.max("depth").alias("depth"), F.sum("found").alias("n_linked"), F.sum("invalid").alias("n_invalid"), F.max(F.col("depth").isNull()).alias("circular")]
    by_id = calls.dropDuplicates(["row", "pos"]).groupBy("conv_id", "row", "id").agg(F.count_if(~F.col("valid")).alias("invalid"))
    of_calls = by_id.join(linked, ["conv_id", "id"], "left").groupBy("row").agg(*sums).withColumn("call_turn", F.lit(None).cast("long"))
    of_calls = of_calls.withColumn("depth", F.when(~F.col("circular"), F.col("depth"))).drop("circular").withColumn("fact", F.lit(True))
    of_results = results.distinct().join(linked, ["conv_id", "id"]).select(
        "row", (F.col("depth") + 1).alias("depth"), F.lit(1).cast("long").alias("n_linked"), F.lit(0).cast("long").alias("n_invalid"), "call_turn", F.lit(True).alias("fact")
    )
    facts = of_calls.unionByName(of_results)
    plain = F.col("kind") == "plain"
    message = F.to_json(F.struct(F.when(plain, F.col("text")).alias("content"), F.when(~plain, F.try_parse_json("text")).alias("payload"), "role"))
    out = m.join(facts, "row", "left")
    depth = F.when(F.col("fact"), F.col("depth")).otherwise(0)  # plain, or a result of no known call
    return out.select(
        F.when(F.col("conv_id") != -(1 << 62), F.col("conv_id")).alias("conv_id"), "turn", "role", "kind", F.greatest("turn", "call_turn").alias("place"), depth.cast("long").alias("depth"),
        F.when(F.col("kind") == "calls", F.size("x.tool_calls")).otherwise(0).cast("long").alias("n_calls"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("n_invalid", F.lit(0)).cast("long").alias("n_invalid"), message.alias("message"),
    )


#: For conversations without tool calls, as in the test tables.
ORACLE = """
SELECT conv_id, turn, role, 'plain' AS kind, turn AS place, 0::BIGINT AS depth, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_invalid,
        '{"content":' || to_json(COALESCE(text, '')) || COALESCE(',"role":' || to_json(role), '') || '}' AS message FROM conversations
"""
