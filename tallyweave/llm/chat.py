"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Messages are rows (conversation, turn, role, text). Three kinds of text are JSON objects:

- of role ``system``, ``{"tools": [{"name": ..., "parameters": <JSON Schema>}]}`` declares the conversation's tools;
- of role ``assistant``, ``{"content": ..., "tool_calls": [{"id": ..., "name": ..., "arguments": {...}}]}`` makes calls;
  an argument that is the string ``$`` and a call's identifier stands for that call's result;
- of role ``tool``, ``{"tool_call_id": ..., "content": ...}`` answers a call.

Every other text is a plain message. The result has one row per event: each message but a tool's answer
is an event ``message`` (a calling message's text is its ``content``), each call an event ``call`` and
each tool's answer an event ``result``. Calls, answers and declarations meet by hash joins on conversation
and identifier; nothing is gathered by conversation, so a conversation of any length is no hot group.

Order: an event's place is (order_turn, order_after, order_index), and the places are a topological order. A
call that stands for no result has its own turn and depth 0. Another one has a depth one above the deepest call it
needs and the latest of its own turn and of those calls' and their answers' turns; depths come from rounds that place the calls
all of whose needs are placed. order_after is twice the depth, and one more for an answer, whose
order_turn is the later of its own and its call's. Calls that need each other in a circle, or need one
that does, are never placed: they keep their own turn and have the status ``cyclic``.

Validation is by JSON Schema, to a depth of ``DEPTH`` objects and arrays below the arguments: ``type`` (a name or a list),
``enum``, ``const``, ``required``, ``properties``, ``additionalProperties`` (a boolean or a schema), ``items`` (a
schema), ``minimum``, ``maximum``, ``minLength``, ``maxLength``, ``minItems``, ``maxItems``, and the schemas ``true`` and
``false``. Other keywords are not read. Complaints are ``keyword path``.

All steps are DataFrame functions of Spark.

Nulls and other cases: a null or malformed text is a plain message; a call without id is never
answered; of calls with equal ids in a conversation the first by (turn, index) is the one answered and needed; all
answers to a call are linked; an answer without a call is ``orphan``, a call without an answer
``pending``; a need of an unknown identifier is a plain string; a call to an undeclared tool, or whose arguments are no object, is invalid; of tools
declared twice the first by (turn, index) counts, and one without parameters takes any; null roles are kept as null; repeated rows give
repeated events; texts of any length are parsed whole; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_TOOLS = "tools array<struct<name string, parameters string>>"
_CALLS = "content string, tool_calls array<struct<id string, name string, arguments string>>"
_RESULT = "tool_call_id string, content string"
_JSON = {"ignoreNullFields": "false"}

#: Levels of objects and arrays below the arguments that are validated.
DEPTH = 5


def canonical_json(column: str) -> Column:
    """A JSON text with its objects' keys sorted and no white space; null where it is no JSON."""
    return F.expr(f"to_json(try_parse_json({column}))")


def _parsed(messages: DataFrame) -> DataFrame:
    """Each message with what its text declares, calls and answers; null where it doesn't."""
    looks = F.col("text").rlike(r"^\s*\{")
    of = lambda role, schema: F.when(looks & (F.col("role") == role) & F.expr("try_parse_json(text)").isNotNull(), F.from_json("text", schema))
    out = messages.withColumns({"tools": of("system", _TOOLS)["tools"], "made": of("assistant", _CALLS), "answer": of("tool", _RESULT)})
    made = F.when(F.col("made.tool_calls").isNotNull(), F.col("made"))
    answer = F.when(F.col("answer.tool_call_id").isNotNull(), F.col("answer"))
    return out.withColumns({"made": made, "answer": answer})


# --- validation; a node is struct(path, s: schema, v: value), both variants ---


def _field(name: str, kind: str = "variant") -> str:
    """A schema's field; null for schemas that are no object."""
    return f"try_variant_get(n.s, '$.{name}', '{kind}')"


_NUMBER = "try_variant_get(n.v, '$', 'double')"
#: JSON Schema's type names by the types of Spark's variants; a number without fraction is an integer.
_TYPE = f"""CASE WHEN schema_of_variant(n.v) = 'VOID' THEN 'null' WHEN schema_of_variant(n.v) = 'STRING' THEN 'string'
 WHEN schema_of_variant(n.v) = 'BOOLEAN' THEN 'boolean' WHEN schema_of_variant(n.v) = 'BIGINT' THEN 'integer'
 WHEN schema_of_variant(n.v) LIKE 'ARRAY%' THEN 'array' WHEN schema_of_variant(n.v) LIKE 'OBJECT%' THEN 'object'
 WHEN {_NUMBER} = floor({_NUMBER}) THEN 'integer' ELSE 'number' END"""
_ALLOWED = f"coalesce(try_variant_get(n.s, '$.type', 'array<string>'), CASE WHEN {_field('type', 'string')} IS NOT NULL THEN array({_field('type', 'string')}) END)"
_OBJECT = "CASE WHEN n.t = 'object' THEN try_variant_get(n.v, '$', 'map<string, variant>') END"
_ARRAY = "CASE WHEN n.t = 'array' THEN try_variant_get(n.v, '$', 'array<variant>') END"
_BELOW = "concat(n.path, CASE WHEN n.path = '' THEN '' ELSE '.' END, {})"


def _complaints() -> str:
    """The complaints about the node ``n``, whose type is n.t."""
    bound = lambda name, kind, size, worse: f"CASE WHEN n.t IN ({kind}) AND {size} {worse} {_field(name, 'double')} THEN '{name}' END"
    numbers, sizes = "'integer', 'number'", {"Length": ("'string'", "length(try_variant_get(n.v, '$', 'string'))"), "Items": ("'array'", f"size({_ARRAY})")}
    found = [
        "CASE WHEN try_variant_get(n.s, '$', 'boolean') = false AND schema_of_variant(n.s) = 'BOOLEAN' THEN 'unknown' END",
        f"CASE WHEN {_ALLOWED} IS NOT NULL AND NOT array_contains({_ALLOWED}, n.t) AND NOT (n.t = 'integer' AND array_contains({_ALLOWED}, 'number')) THEN 'type' END",
        f"CASE WHEN {_field('enum', 'array<variant>')} IS NOT NULL AND NOT exists({_field('enum', 'array<variant>')}, x -> to_json(x) = to_json(n.v)) THEN 'enum' END",
        f"CASE WHEN to_json({_field('const')}) != to_json(n.v) THEN 'const' END",
        bound("minimum", numbers, _NUMBER, "<"),
        bound("maximum", numbers, _NUMBER, ">"),
        *(bound(f"min{k}", kind, size, "<") for k, (kind, size) in sizes.items()),
        *(bound(f"max{k}", kind, size, ">") for k, (kind, size) in sizes.items()),
    ]
    own = f"transform(filter(array({', '.join(found)}), x -> x IS NOT NULL), x -> concat(x, ' ', n.path))"
    missing = f"transform(filter(coalesce(CASE WHEN n.t = 'object' THEN {_field('required', 'array<string>')} END, array()), p -> NOT map_contains_key({_OBJECT}, p)), p -> concat('missing ', {_BELOW.format('p')}))"
    return f"concat({own}, {missing})"


def _children() -> str:
    """The values in the node ``n`` that it has a schema for."""
    properties = f"coalesce({_field('properties', 'map<string, variant>')}, map())"
    of = f"CASE WHEN map_contains_key({properties}, e.key) THEN {properties}[e.key] ELSE {_field('additionalProperties')} END"
    named = f"transform(coalesce(map_entries({_OBJECT}), array()), e -> named_struct('path', {_BELOW.format('e.key')}, 's', {of}, 'v', e.value))"
    listed = f"transform(coalesce({_ARRAY}, array()), (x, i) -> named_struct('path', concat(n.path, '[', i, ']'), 's', {_field('items')}, 'v', x))"
    return f"filter(concat({named}, {listed}), c -> c.s IS NOT NULL AND c.v IS NOT NULL)"


def _judged(calls: DataFrame) -> DataFrame:
    """Calls with their sorted complaints in ``errors``; ``declared``, ``schema`` and ``v`` are a call's tool, its schema and the arguments."""
    typed = f"transform({{}}, n -> named_struct('path', n.path, 's', n.s, 'v', n.v, 't', {_TYPE}))"
    out = calls.withColumn("nodes", F.expr("CASE WHEN schema IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%' THEN array(named_struct('path', '', 's', schema, 'v', v)) ELSE array() END"))
    for level in range(DEPTH + 1):
        out = out.withColumn("nodes", F.expr(typed.format("nodes")))
        found = F.expr(f"flatten(transform(nodes, n -> {_complaints()}))")
        out = out.withColumn("errors", F.concat("errors", found) if level else found)
        if level < DEPTH:
            out = out.withColumn("nodes", F.expr(f"flatten(transform(nodes, n -> {_children()}))"))
    return out.drop("nodes").withColumn("errors", F.expr("CASE WHEN declared IS NULL THEN array('undeclared tool') WHEN schema_of_variant(v) NOT LIKE 'OBJECT%' OR v IS NULL THEN array('arguments') ELSE array_sort(errors) END"))


# --- order ---


def _depths(needs: DataFrame) -> DataFrame:
    """(n_conv, n_turn, n_index, depth, at): the places of the calls that need others; depth is null for those in circles.

    ``needs`` has a row for each call and each call that it needs: conv_id, turn, index, d_turn, d_index and the last turn
    of the latter's answers, d_last. Each round places the calls all of whose needs are placed.
    """
    key = ["conv_id", "turn", "index"]
    needs = common.materialize(needs.distinct(), "needs")
    same = lambda *pairs: [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs]
    meets = same(("conv_id", "n_conv"), ("d_turn", "n_turn"), ("d_index", "n_index"))
    named = lambda df, *more: df.select(F.col("conv_id").alias("n_conv"), F.col("turn").alias("n_turn"), F.col("index").alias("n_index"), *more)
    waits = named(needs.select(*key).distinct(), F.lit(True).alias("waits"))
    known = needs.join(waits, meets, "left").withColumn("d_depth", F.when(F.col("waits").isNull(), F.lit(0))).withColumn("d_at", F.when(F.col("waits").isNull(), F.col("d_turn"))).select(*needs.columns, "d_depth", "d_at")
    placed, before = None, 0
    while True:
        ready = known.groupBy(*key).agg(F.bool_and(F.col("d_depth").isNotNull()).alias("ready"), (F.max("d_depth") + 1).alias("depth"), F.greatest("turn", F.max(F.greatest("d_at", "d_last"))).alias("at")).where("ready")
        placed = common.materialize(named(ready, "depth", "at"), "placed")
        now = placed.count()
        if now == before:
            return waits.drop("waits").join(placed.toDF("p_conv", "p_turn", "p_index", "depth", "at"), same(("n_conv", "p_conv"), ("n_turn", "p_turn"), ("n_index", "p_index")), "left").select("n_conv", "n_turn", "n_index", "depth", "at")
        before = now
        fresh = known.join(placed, meets, "left").select(*needs.columns, F.coalesce("d_depth", "depth").alias("d_depth"), F.coalesce("d_at", "at").alias("d_at"))
        known = common.materialize(fresh, "known")


def chat_events(messages: DataFrame, *, conversation_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per event: conv_id, turn, kind, order_turn, order_after, order_index, call_id, status, valid, event_json."""
    rows = _parsed(messages.select(F.col(conversation_column).cast("long").alias("conv_id"), F.col(turn_column).cast("long").alias("turn"), F.col(role_column).cast("string").alias("role"), F.col(text_column).cast("string").alias("text")))
    order = lambda turn, after, index: [turn.alias("order_turn"), after.cast("long").alias("order_after"), index.cast("long").alias("order_index")]
    no = lambda kind: F.lit(None).cast(kind)

    content = F.when(F.col("made").isNotNull(), F.col("made.content")).otherwise(F.col("text"))
    message_json = F.to_json(F.struct(content.alias("content"), F.col("role"), F.col("turn")), _JSON)
    plain = rows.where(F.col("answer").isNull()).select("conv_id", "turn", F.lit("message").alias("kind"), *order(F.col("turn"), F.lit(0), F.lit(-1)), no("string").alias("call_id"), F.lit("ok").alias("status"), no("boolean").alias("valid"), message_json.alias("event_json"))

    calls = rows.where(F.col("made").isNotNull()).select("conv_id", "turn", F.posexplode("made.tool_calls").alias("index", "call")).select("conv_id", "turn", "index", F.col("call.id").alias("call_id"), "call.name", "call.arguments")
    answers = rows.where(F.col("answer").isNotNull()).select("conv_id", "turn", F.col("answer.tool_call_id").alias("call_id"), F.col("answer.content").alias("content"))
    tools = rows.where(F.col("tools").isNotNull()).select("conv_id", "turn", F.posexplode("tools").alias("index", "tool"))
    tools = tools.groupBy("conv_id", F.col("tool.name").alias("name")).agg(F.min(F.struct("turn", "index", F.col("tool.parameters").alias("parameters"))).alias("tool"))
    tools = tools.select(F.col("conv_id").alias("tool_conv"), F.col("name").alias("declared"), F.expr("coalesce(try_parse_json(tool.parameters), parse_json('true'))").alias("schema"))

    # Who is answered: keys without nulls only, so no rows without an identifier meet in one task.
    called = calls.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "index")).alias("first")).select(F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_id"), "first")
    answered = answers.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_answers"), F.max("turn").alias("last")).select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), "n_answers", "last")
    linked = called.join(answered, F.col("c_conv").eqNullSafe(F.col("r_conv")) & (F.col("c_id") == F.col("r_id")), "left").select("c_conv", "c_id", "first", "n_answers", "last")

    parsed = calls.withColumn("v", F.expr("try_parse_json(coalesce(arguments, '{}'))"))
    values = F.expr("transform(map_values(try_variant_get(v, '$', 'map<string, variant>')), x -> CASE WHEN schema_of_variant(x) = 'STRING' THEN cast(x AS string) END)")
    wanted = parsed.select("conv_id", "turn", "index", F.explode(F.filter(values, lambda x: x.startswith("$"))).alias("need")).withColumn("need", F.expr("substr(need, 2)"))
    needs = wanted.join(linked, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("need") == F.col("c_id"))).select("conv_id", "turn", "index", F.col("first.turn").alias("d_turn"), F.col("first.index").alias("d_index"), F.col("last").alias("d_last"))
    depths = _depths(needs)
    at = lambda turn, index, conv: F.col(conv).eqNullSafe(F.col("n_conv")) & turn.eqNullSafe(F.col("n_turn")) & (index == F.col("n_index"))
    depth, needy = F.coalesce("depth", F.lit(0)), F.col("n_index").isNotNull()

    with_tool = parsed.join(tools, F.col("conv_id").eqNullSafe(F.col("tool_conv")) & (F.col("name") == F.col("declared")), "left")
    with_link = with_tool.join(linked, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("call_id") == F.col("c_id")) & (F.struct("turn", "index") == F.col("first")), "left")
    judged = _judged(with_link.join(depths, at(F.col("turn"), F.col("index"), "conv_id"), "left"))
    quoted = lambda c: F.coalesce(F.expr(f"to_json(named_struct('x', {c}))").substr(F.lit(6), F.length(F.expr(f"to_json(named_struct('x', {c}))")) - 6), F.lit("null"))
    name_or_null = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(quoted(c))
    call_json = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("v"), F.lit("null")), F.lit(',"errors":'), F.to_json("errors"), F.lit(',"id":'), name_or_null("call_id"), F.lit(',"name":'), name_or_null("name"), F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"))
    status = F.when(needy & F.col("depth").isNull(), "cyclic").when(F.col("n_answers") > 0, "answered").otherwise("pending")
    call_events = judged.select("conv_id", "turn", F.lit("call").alias("kind"), *order(F.greatest("turn", "at"), 2 * depth, F.col("index")), "call_id", status.alias("status"), (F.size("errors") == 0).alias("valid"), call_json.alias("event_json"))

    met = answers.join(called, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("call_id") == F.col("c_id")), "left").join(depths, at(F.col("first.turn"), F.col("first.index"), "conv_id"), "left")
    result_json = F.to_json(F.struct(F.col("content"), F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"), F.col("turn")), _JSON)
    results = met.select("conv_id", "turn", F.lit("result").alias("kind"), *order(F.greatest("turn", "first.turn", "at"), 2 * depth + 1, F.coalesce(F.col("first.index"), F.lit(0))), "call_id", F.when(F.col("first").isNull(), "orphan").otherwise("linked").alias("status"), no("boolean").alias("valid"), result_json.alias("event_json"))
    return plain.unionByName(call_events).unionByName(results)
