"""Chat formatting with linked tool calls, by DataFrame functions only.

Calls and results are joined by their identifier within a conversation. A topological order puts every
result behind its call; arguments are checked against the schema of their tool; each message becomes a
line of canonical JSON (sorted keys, no spare blanks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import fresh

CHUNK = 1024


def json_type(value: Column) -> Column:
    """object, array, string, number, boolean or null of a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )


def link_calls(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Formats messages: one canonical JSON line for each, in topological order.

    messages: conv_id, turn, role, text, call_id, tool, arguments (JSON text); other columns come back
    unchanged. A row with a tool is a call; one with a call_id and no tool is a result; else a plain
    message. schemas: tool, param, type (object, array, string, number, boolean), required.

    Adds position (from 0, in the conversation's topological order: by turn, but a result directly behind its
    call where it would come earlier), link (call: answered or open; result: linked or orphan; else
    null), errors (array: what the arguments violate; empty if nothing or not a call) and line.

    Of calls that share an identifier in a conversation the first by turn, then tool, is linked; further ones are
    calls of their own with link ``repeated``. Rows of a call alike in turn and tool as well are one call that
    the table holds repeatedly: each has the link of that call. Results may be many for a call. All rows with a null
    conv_id are one conversation; a null turn sorts first; null role and text appear as JSON null; an
    identifier that is null links nothing. Arguments that are no JSON object: error ``not an object``;
    a tool without schema: ``unknown tool``; an object that repeats a key is none. Numbers of up to 38 digits
    are kept exactly (trailing zeros of fractions aside); larger ones and those with an exponent are doubles and
    appear as such. Empty tables give no rows. Rows that are alike in all of
    turn, role, call_id and text keep an arbitrary order among themselves.
    """
    names = {c: fresh(messages, c) for c in ("position", "link", "errors", "line")}
    turn = F.col("turn")
    calls = messages.where("tool is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "tool")).alias("call"), F.count(F.lit(1)).alias("calls")
    )
    results = messages.where("tool is null and call_id is not null").groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("results"))
    ties = calls.join(results, ["conv_id", "call_id"], "full")
    ties = ties.select(F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_call"), "call", "results")
    m = messages.join(ties, F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("call_id") == F.col("l_call")), "left").drop("l_conv", "l_call")

    is_call, is_result = F.col("tool").isNotNull(), F.col("tool").isNull() & F.col("call_id").isNotNull()
    first = turn.eqNullSafe(F.col("call.turn")) & F.col("tool").eqNullSafe(F.col("call.tool"))
    link = (
        F.when(is_call & F.col("call_id").isNotNull() & ~first, "repeated").when(is_call, F.when(F.col("results") > 0, "answered").otherwise("open"))
        .when(is_result, F.when(F.col("call").isNotNull(), "linked").otherwise("orphan"))
    )
    m = m.withColumn(names["link"], link)
    late = F.col(names["link"]) == "linked"
    at = F.when(late, F.greatest(turn, F.col("call.turn"))).otherwise(turn)
    m = m.withColumns({"t_at": at, "t_after": F.when(late & (turn.isNull() | (turn <= F.col("call.turn"))), 1).otherwise(0)})

    # Positions: rows before a chunk of turns (summed per chunk) plus the place within the chunk.
    m = m.withColumn("t_chunk", F.floor(F.col("t_at") / CHUNK))
    before = m.groupBy("conv_id", "t_chunk").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("conv_id").orderBy("t_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(F.col("conv_id").alias("b_conv"), F.col("t_chunk").alias("b_chunk"), F.coalesce(F.sum("n").over(running), F.lit(0)).alias("b_n")).where("b_n > 0")
    inside = Window.partitionBy("conv_id", "t_chunk").orderBy("t_at", "t_after", "turn", "role", "call_id", "text")
    m = m.withColumn("t_row", F.row_number().over(inside) - 1)
    m = m.join(before, F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("t_chunk").eqNullSafe(F.col("b_chunk")), "left")
    m = m.withColumn(names["position"], F.coalesce("b_n", F.lit(0)) + F.col("t_row"))

    # Arguments against schemas: a tool's parameters are one short array, joined by the tool's name.
    rules = schemas.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("param", "type", "required"))).alias("s_rules")).withColumnRenamed("tool", "s_tool")
    m = m.join(rules, F.col("tool") == F.col("s_tool"), "left").withColumn("s_args", F.try_parse_json("arguments"))
    entries = F.from_json("arguments", "map<string,variant>")
    given = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    wrong = F.flatten(
        F.transform("s_rules", lambda r: F.when(~F.array_contains(given, r["param"]), F.when(r["required"], F.array(F.concat(F.lit("missing "), r["param"]))).otherwise(F.array().cast("array<string>")))
            .when(json_type(F.element_at(entries, r["param"])) != r["type"], F.array(F.concat(F.lit("type of "), r["param"]))).otherwise(F.array().cast("array<string>")))
    )
    extra = F.transform(F.array_sort(F.array_except(given, F.transform("s_rules", lambda r: r["param"]))), lambda k: F.concat(F.lit("unknown "), k))
    errors = (
        F.when(~is_call, F.array().cast("array<string>")).when(F.col("s_rules").isNull(), F.array(F.lit("unknown tool")))
        .when(F.col("s_args").isNull() | ~F.coalesce(F.schema_of_variant("s_args"), F.lit("")).startswith("OBJECT"), F.array(F.lit("not an object")))
        .otherwise(F.concat(wrong, extra))
    )
    quoted = lambda c: F.coalesce(F.expr(f"substr(to_json(struct({c} as v)), 6, length(to_json(struct({c} as v))) - 6)"), F.lit("null"))
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(quoted(c))
    call = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("s_args"), text("arguments")), F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("tool"), F.lit("}")
    )
    line = F.concat(
        F.lit('{"content":'), text("text"), F.lit(',"role":'), text("role"),
        F.when(is_call, F.concat(F.lit(',"tool_call":'), call)).when(is_result, F.concat(F.lit(',"tool_call_id":'), text("call_id"))).otherwise(""), F.lit("}"),
    )
    m = m.withColumns({names["errors"]: errors, names["line"]: line})
    return m.select(*messages.columns, *names.values())


def calls_of_turns(conversations: DataFrame) -> DataFrame:
    """Messages with calls from plain turns.

    Every user turn calls the tool ``reply`` (``summarise`` in turns that 3 divides), every assistant turn is a result:
    in conversations of even number for the turn before, in the others for the turn behind it, so these results come
    too early. Other roles stay plain messages. Arguments of turns that 7 divides are an array, those of other turns
    that 5 divides give the turn as text.
    """
    text_of, turn = F.col("text"), F.col("turn")
    name = F.when(turn % 3 == 0, "summarise").otherwise("reply")
    object_of = lambda turn: F.to_json(F.struct(turn.alias("turn"), F.substring(text_of, 1, 40).alias("start"), F.length(text_of).alias("length")))
    args = F.when(turn % 7 == 0, F.concat(F.lit("["), turn.cast("string"), F.lit("]"))).when(turn % 5 == 0, object_of(turn.cast("string"))).otherwise(object_of(turn))
    number = F.when(F.col("role") == "user", turn).when(F.col("role") == "assistant", F.when(F.col("conv_id") % 2 == 0, turn - 1).otherwise(turn + 1))
    return conversations.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), number.cast("string")).alias("call_id"),
        F.when(F.col("role") == "user", name).alias("tool"), F.when(F.col("role") == "user", args).alias("arguments"),
    )
