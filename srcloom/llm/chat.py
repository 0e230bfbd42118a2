"""Tool calls of chats: linked to their results, ordered, validated, written as canonical JSON.

``link_calls`` takes calls (conv_id, call_id, turn, name, arguments, after) and results (conv_id,
call_id, turn, content).  Calls and results meet in an equi-join on conversation and identifier.  A
call stands behind the call it names in ``after``: its level is the number of calls before it in that
chain, found by doubling (each round a call learns the calls twice as far back), so rounds grow with
the logarithm of the longest chain, and each round is a join.  Rows are ordered by (level, turn,
call_id).  Arguments are parsed as JSON and checked against the tool's schema: needed names, types,
no other names.  Every call is one row with one line of canonical JSON: names in order, no white space;
a conversation is never gathered, so one that holds a third of all rows is no hot group.

Schemas are a small literal: {tool: {name: (type, needed)}}, types string, integer, number, boolean,
array, object.

``calls_from_turns`` reads a chat table: a user's or system's turn is a call of ``ask`` or ``configure``
with the identifier conversation:turn, it stands behind the last such turn before it, and an assistant's
turn is a result of the last such turn before it, whatever the numbers between.  That last turn is found
in stretches of ``STRETCH`` turn numbers and then over the stretches.  Of turns with one number the least
in order of role and text has the plain identifier; others have a digest behind it, so that none is lost.
Assistant turns whose text is a JSON object with ``tool_calls`` and tool turns with ``tool_call_id`` are
calls and results as they say; turns of any other role are results of no call.

Defined results: errors are listed in the order unknown_tool, bad_json, missing:name, type:name,
extra:name, no_result, result_before_call, cycle; a call named twice keeps its first turn; ``after`` that
names no call counts as null; calls on a cycle have level -1.  Of several results of a call the first is
linked; the others, and results of no call, are rows of their own with null level and name and the error
repeated_result or no_call.  Null text is null content; null conv_id, turn or identifier makes no call or
result; equal calls are one, and so are results of a call that agree in turn and text; texts of any length are kept whole; an empty table gives no rows; extra columns
aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.llm.storage import materialize

SCHEMAS = {"ask": {"text": ("string", True), "turn": ("integer", True)}, "configure": {"text": ("string", True), "turn": ("integer", True)}}
CALL = "array<struct<id:string,name:string,arguments:string,after:string>>"
#: Turn numbers in which the last call before a turn is looked for first.
STRETCH = 256
#: Patterns of variant types.
KINDS = {"string": "^STRING$", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def calls_from_turns(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table (conv_id, turn, role, text)."""
    rows = chats.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text")).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    said = rows.withColumn("tools", F.when((F.col("role") == "assistant") & F.col("text").startswith("{"), F.from_json("text", f"struct<tool_calls:{CALL}>")["tool_calls"]))
    said = said.withColumn("reply_to", F.when((F.col("role") == "tool") & F.col("text").startswith("{"), F.get_json_object("text", "$.tool_call_id")))
    plain = said.where(F.col("role").isin("user", "system")).select("conv_id", "turn", "role", "text").distinct()
    first = plain.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("first"))
    key = lambda turn: F.concat("conv_id", F.lit(":"), turn.cast("string"))
    other = said.where("tools IS NULL AND reply_to IS NULL AND coalesce(role, '') NOT IN ('user', 'system')")
    before = _turns_before(first.select("conv_id", "turn"), other.where("role = 'assistant'").select("conv_id", "turn"))
    # the rows' side of these joins may have hot keys, which Spark splits; the other has one row for each key
    asked = plain.join(before.join(first, ["conv_id", "turn"]), ["conv_id", "turn"])
    named = F.when(F.struct("role", "text").eqNullSafe(F.col("first")), key(F.col("turn"))).otherwise(F.concat(key(F.col("turn")), F.lit(":"), F.hex(F.xxhash64("role", "text"))))
    asked = asked.withColumn("call_id", named)
    asked = asked.select("conv_id", "call_id", "turn", F.when(F.col("role") == "user", "ask").otherwise("configure").alias("name"), F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"}).alias("arguments"), key(F.col("last")).alias("after"))
    told = said.where("tools IS NOT NULL").select("conv_id", "turn", F.explode("tools").alias("t")).select("conv_id", F.col("t.id").alias("call_id"), "turn", F.col("t.name").alias("name"), F.col("t.arguments").alias("arguments"), F.col("t.after").alias("after"))
    replies = said.where("reply_to IS NOT NULL").select("conv_id", F.col("reply_to").alias("call_id"), "turn", F.get_json_object("text", "$.content").alias("content"))
    answers = other.join(before, ["conv_id", "turn"], "left")
    # a result of no call names a turn that is none
    answers = answers.select("conv_id", F.coalesce(F.when(F.col("role") == "assistant", key(F.col("last"))), F.concat(key(F.col("turn")), F.lit(":result"))).alias("call_id"), "turn", F.col("text").alias("content"))
    return asked.unionByName(told), answers.unionByName(replies)


def _turns_before(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, turn, last) of different turns of calls and answers: the last call's turn before each."""
    turns = calls.select("conv_id", "turn", F.lit(1).alias("call")).unionByName(answers.select("conv_id", "turn", F.lit(0).alias("call"))).groupBy("conv_id", "turn").agg(F.max("call").alias("call"))
    turns = turns.withColumn("stretch", F.floor(F.col("turn") / STRETCH)).withColumn("own", F.when(F.col("call") == 1, F.col("turn")))
    ended = turns.groupBy("conv_id", "stretch").agg(F.max("own").alias("end"))
    carried = ended.select("conv_id", "stretch", F.max("end").over(Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = turns.withColumn("near", F.max("own").over(Window.partitionBy("conv_id", "stretch").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)))
    return inside.join(carried, ["conv_id", "stretch"]).select("conv_id", "turn", F.coalesce("near", "carried").alias("last"))


def levels(calls: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, after); -1 on and behind cycles."""
    ids = calls.select("conv_id", F.col("call_id").alias("after"))
    known = calls.where("after IS NOT NULL").join(ids, ["conv_id", "after"], "left_semi").select("conv_id", "call_id", "after")
    now = calls.select("conv_id", "call_id").join(known, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("after").alias("up"), F.when(F.col("after").isNull(), 0).otherwise(1).cast("long").alias("level"))
    now = materialize(now, "levels-0")
    for k in range(most_rounds):
        count = now.agg(F.count("up"), F.count("*")).first()
        if not count[0] or 2**k > count[1]:  # no call has a parent left, or the rest are on cycles
            break
        far = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        # many calls may stand behind one: the left side is what Spark splits
        now = materialize(now.join(far, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), f"levels-{k + 1}")
    return now.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).otherwise(-1).alias("level"))


def _other_than(names: list[str]):
    return lambda k: ~k.isin(*names)


def _errors(schemas: dict) -> F.Column:
    """Names of what is wrong with arguments of tool ``name``, as an array of strings."""
    given = F.json_object_keys("arguments")
    out = F.when(F.lit(True), F.array(F.lit("unknown_tool")))
    for tool, fields in sorted(schemas.items()):
        checks = []
        for field, (kind, needed) in sorted(fields.items()):
            value = F.schema_of_variant(F.try_variant_get("parsed", f"$['{field}']", "variant"))
            missing = ~F.coalesce(F.array_contains(given, field), F.lit(False))
            wrong = F.when(~missing & ~F.coalesce(value.rlike(KINDS[kind]), F.lit(False)), F.lit(f"type:{field}"))
            checks.append(F.when(missing, F.lit(f"missing:{field}")).otherwise(wrong) if needed else wrong)
        extra = F.transform(F.filter(F.array_sort(given), _other_than(list(fields))), lambda k: F.concat(F.lit("extra:"), k))
        own = F.concat(F.array_compact(F.array(*checks)), extra)
        bad = F.col("parsed").isNull() | given.isNull()
        out = F.when(F.col("name") == tool, F.when(bad, F.array(F.lit("bad_json"))).otherwise(own)).otherwise(out)
    return out


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, call_id, level, turn, name, linked, errors, json: one row for each call, and for each result that is linked to none."""
    calls = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c")).select("conv_id", "call_id", "c.*")
    calls = materialize(calls, "calls")
    results = materialize(results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").select("conv_id", "call_id", "turn", "content").distinct(), "results")
    best = results.groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").alias("result_turn"), "content")).alias("r"))
    rows = calls.join(best.select("conv_id", "call_id", "r.*", F.lit(True).alias("linked")), ["conv_id", "call_id"], "left").join(levels(calls), ["conv_id", "call_id"])
    known = best.join(calls.select("conv_id", "call_id", F.lit(True).alias("called")), ["conv_id", "call_id"], "left").withColumn("called", F.coalesce("called", F.lit(False)))
    odd = results.join(known, ["conv_id", "call_id"]).where(~F.col("called") | ~F.struct(F.col("turn").alias("result_turn"), "content").eqNullSafe(F.col("r")))
    rows = rows.withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("parsed", F.try_parse_json("arguments"))
    late = F.array_compact(F.array(F.when(~F.col("linked"), "no_result"), F.when(F.col("result_turn") <= F.col("turn"), "result_before_call"), F.when(F.col("level") < 0, "cycle")))
    rows = rows.withColumn("errors", F.concat(_errors(schemas), late))
    # names in order; an object's own names are in order in a variant
    whole = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("parsed"), F.lit("null")), F.lit(',"call_id":'), _text(F.col("call_id")), F.lit(',"level":'), F.col("level").cast("string"), F.lit(',"name":'), _text(F.col("name")), F.lit(',"result":'), _text(F.col("content")), F.lit("}")
    )
    alone = F.concat(F.lit('{"call_id":'), _text(F.col("call_id")), F.lit(',"result":'), _text(F.col("content")), F.lit("}"))
    odd = odd.select("conv_id", "call_id", F.lit(None).cast("long").alias("level"), "turn", F.lit(None).cast("string").alias("name"), F.lit(False).alias("linked"), F.when(F.col("called"), "repeated_result").otherwise("no_call").alias("errors"), alone.alias("json"))
    return rows.select("conv_id", "call_id", F.col("level").cast("long").alias("level"), "turn", "name", "linked", F.array_join("errors", ",").alias("errors"), whole.alias("json")).unionByName(odd)


def _text(value: F.Column) -> F.Column:
    """A string as JSON; null as null."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(whole.substr(F.lit(6), F.length(whole) - 6))


def canonical_chats(chats: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    return link_calls(*calls_from_turns(chats), schemas)
