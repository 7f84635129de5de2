"""Tool calls linked to their results, put in an order that respects references, validated, and serialised."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import running, stage

#: Schema of the `reply` call that an exchange of plain messages stands for.
REPLY = {
    "reply": {
        "type": "object",
        "required": ["message", "turn"],
        "additionalProperties": False,
        "properties": {"message": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    }
}
TURNS_PER_BUCKET = 64

_KINDS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
}


def violations(value, schema: dict, path: str = "") -> list[str]:
    """Where value breaks the schema: `path:keyword`, in schema order. Knows the common keywords."""
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_KINDS[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{path}:type"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}:enum")
    if isinstance(value, str):
        out += [f"{path}:{k}" for k, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value)))) if bad]
    if isinstance(value, int | float) and not isinstance(value, bool):
        out += [f"{path}:{k}" for k, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}/{k}:required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}/{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}/{k}:additionalProperties")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{path}/{i}")
    return out


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, plain letters; floats of whole value as integers."""

    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def tool_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text) that carry JSON.

    A call: an element of `tool_calls` in an assistant's text, {"id", "name", "arguments"}; it
    depends on every call that a string in its arguments, at any depth, names as "$id". A result: a
    message of role tool, {"tool_call_id", "content"}. Texts that aren't such JSON give neither.
    """
    shape = "tool_calls array<struct<id:string,name:string,arguments:string>>"
    spoken = messages.filter((F.col("role") == "assistant") & F.col("text").rlike(r"^\s*\{")).withColumn("_j", F.from_json("text", shape))
    calls = spoken.select("conv_id", "turn", F.posexplode("_j.tool_calls").alias("seq", "c"))
    # Strings that begin with $, but no names of members.
    named = F.regexp_extract_all(F.coalesce("c.arguments", F.lit("")), F.lit(r'(?<!\\)"\$((?:[^"\\]|\\.)*+)"(?!\s*:)'), F.lit(1))
    spelled = F.transform(named, lambda v: F.get(F.from_json(F.concat(F.lit('["'), v, F.lit('"]')), "array<string>"), F.lit(0)))
    calls = calls.select(
        "conv_id", "turn", "seq", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"),
        F.array_compact(spelled).alias("depends"),
    )
    told = messages.filter("role = 'tool'").withColumn("_j", F.from_json("text", "tool_call_id string, content string"))
    return calls, told.select("conv_id", "turn", F.col("_j.tool_call_id").alias("call_id"), F.col("_j.content").alias("content"))


def exchanges(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain messages: a user's turn calls `reply`, the assistant's next turn answers.

    The call is identified by conversation and turn, and depends on the user's turn before the
    last answer, if there is one.
    """
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    said = messages.filter("role = 'user'")
    arguments = F.to_json(F.struct(F.col("text").alias("message"), "turn"), {"ignoreNullFields": "false"})
    calls = said.select(
        "conv_id", "turn", F.lit(0).alias("seq"), name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends"),
    )
    answers = messages.filter("role = 'assistant'")
    return calls, answers.select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))


def _levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, call_id, level for conversations in which a call refers to a later one.

    Rounds take away the calls whose references are all placed; what is left at the end lies on or
    behind a cycle and has a null level. Only such conversations take part.
    """
    odd = stage(edges.filter("not forward").select("conv_id").distinct(), "chat-odd")
    if odd.isEmpty():
        return calls.select("conv_id", "call_id").limit(0).withColumn("level", F.lit(0))
    todo = stage(calls.select("conv_id", "call_id").join(odd, "conv_id", "left_semi"), "chat-todo")
    links = stage(edges.join(odd, "conv_id", "left_semi").select("conv_id", "call_id", "dep"), "chat-links")
    placed, level = None, 0
    while True:
        waiting = todo.join(links.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_semi")
        ready = stage(todo.join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)), "chat-ready")
        if ready.isEmpty():
            return (placed if placed is not None else ready).unionByName(todo.withColumn("level", F.lit(None).cast("int")))
        placed = ready if placed is None else stage(placed.unionByName(ready), "chat-placed")
        gone = ready.select("conv_id", F.col("call_id").alias("dep"))
        links = stage(links.join(gone, ["conv_id", "dep"], "left_anti").select("conv_id", "call_id", "dep"), "chat-links")
        todo = stage(waiting, "chat-todo")
        level += 1


def _emit_lines(schemas: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, lines = [], []
            for r in batch.select(["call_id", "name", "arguments", "position", "status", "content", "is_call"]).to_pylist():
                wrong, arguments = [], None
                if r["is_call"]:
                    try:
                        arguments = json.loads(r["arguments"] or "null")
                        wrong = violations(arguments, schemas[r["name"]]) if r["name"] in schemas else [":unknown_tool"]
                    except ValueError:
                        arguments, wrong = r["arguments"], [":json"]
                errors.append(wrong)
                lines.append(canonical({"arguments": arguments, "call_id": r["call_id"], "errors": wrong, "name": r["name"], "position": r["position"], "result": r["content"], "status": r["status"]}))
            columns = [batch.column(c) for c in ("conv_id", "position", "turn", "call_id", "status")]
            columns += [pa.array([len(e) for e in errors], pa.int64()), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "position", "turn", "call_id", "status", "n_errors", "json"])

    return run


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """conv_id, position, turn, call_id, status, n_errors, json: one row per call, and per result without one.

    calls: conv_id, turn, seq, call_id, name, arguments (JSON), depends (ids it refers to).
    results: conv_id, turn, call_id, content. Both are joined on conversation and id. Of calls or
    results with the same id in a conversation the first counts (by turn, seq, content).
    status: linked, unanswered (no result), early (the result's turn is before the call's), cyclic
    (its references never end), orphan (a result without a call: null position). Calls are numbered
    per conversation in an order that puts each behind those it refers to: their own order where
    it does so already. References to unknown ids don't count. json: keys sorted, no spaces; arguments that break the tool's schema are
    listed as errors, those that aren't JSON are kept as text. Null ids or conversations never
    link: such calls are dropped, such results too. No calls and results: no rows.
    """
    one = F.min(F.struct("turn", "seq", "name", "arguments", "depends")).alias("c")
    calls = calls.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(one).select("conv_id", "call_id", "c.*")
    calls = stage(calls, "chat-calls")
    results = results.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    places = calls.select("conv_id", F.col("call_id").alias("dep"), F.struct("turn", "seq").alias("at"))
    edges = calls.select("conv_id", "call_id", F.struct("turn", "seq").alias("own"), F.explode(F.array_distinct("depends")).alias("dep")).join(places, ["conv_id", "dep"])
    edges = stage(edges.select("conv_id", "call_id", "dep", (F.col("at") < F.col("own")).alias("forward")), "chat-edges")
    levels = stage(_levels(calls, edges), "chat-levels").withColumn("_odd", F.lit(True))
    joined = calls.join(levels, ["conv_id", "call_id"], "left")
    # Regular conversations go by turn; the others by level, cycles last.
    step = F.when(F.col("_odd").isNull(), F.lit(0)).otherwise(F.coalesce("level", F.lit(2**31 - 1)))
    joined = joined.withColumn("_step", step).withColumn("_part", F.when(F.col("_odd").isNull(), F.floor(F.col("turn") / TURNS_PER_BUCKET)).otherwise(F.col("_step")).cast("long"))
    placed = running(joined, ["conv_id"], "_part", [F.col("_step"), F.col("turn"), F.col("seq"), F.col("call_id")], {"_place": F.lit(1)})
    both = placed.join(results, ["conv_id", "call_id"], "full")
    is_call = F.col("_place").isNotNull()
    status = (
        F.when(~is_call, "orphan")
        .when(F.col("_odd").isNotNull() & F.col("level").isNull(), "cyclic")
        .when(F.col("r").isNull(), "unanswered")
        .when(F.col("r.turn") < F.col("turn"), "early")
        .otherwise("linked")
    )
    rows = both.select(
        "conv_id", (F.col("_place") - 1).alias("position"), F.coalesce("turn", "r.turn").cast("long").alias("turn"), "call_id", status.alias("status"),
        "name", "arguments", F.col("r.content").alias("content"), is_call.alias("is_call"),
    )
    kind = calls.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(_emit_lines(schemas), f"conv_id {kind}, position long, turn long, call_id string, status string, n_errors long, json string")
