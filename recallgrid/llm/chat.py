"""Chat formatting: links tool calls to their results, orders them, checks arguments and writes canonical JSON.

The n-th result with an identifier answers the n-th call with it in its conversation; Spark hash-joins both by
(conversation, identifier, n). A linked result takes its place right after its call, whatever its own turn. One that makes
calls itself keeps its own turn, where its results follow it; it is linked only to a call of an earlier turn. So every
result stands behind its call, which is a topological order of chains of any length. Rows stay messages: (conv_id, anchor_turn, slot, turn) sorts a conversation, and
no conversation is ever gathered, however long it is.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CALLS = "array<struct<id:string,name:string,arguments:string>>"
#: Levels of nesting that arguments may have.
DEPTH = 100
_KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
_TYPES = {*_KINDS, "number", "integer"}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces, the shortest numbers and only the escapes that JSON needs (as in RFC 8785).

    All numbers are doubles, whole ones too; one beyond them is an error.
    """
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, int) and not isinstance(value, bool):
        try:
            value = float(value)
        except OverflowError:
            raise ValueError("beyond a double") from None
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a JSON number")
        text = repr(value)
        if value == int(value) and abs(value) < 1e21:
            return format(Decimal(text), "f").removesuffix(".0") if value else "0"
        if "e" in text:
            digits, power = text.split("e")
            if -7 < int(power) < 0:
                return f"{value:.{len(digits.replace('.', '').lstrip('-')) - 1 - int(power)}f}"
            return f"{digits}e{'+' if int(power) > 0 else '-'}{abs(int(power))}"
        return text
    return json.dumps(value, ensure_ascii=False)


def violations(value: Any, schema: dict, at: str = "") -> list[str]:
    """What keeps a value from its JSON schema: type, enum, required, properties, additionalProperties, items and bounds."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = isinstance(value, int | float) and not isinstance(value, bool)
    fits = {"number": number, "integer": number and value == int(value)}
    if kinds and not any(fits[k] if k in fits else isinstance(value, _KINDS[k]) for k in kinds):
        return [f"{at or '/'}: type"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at or '/'}: enum")
    if number:
        out += [f"{at or '/'}: {k}" for k, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    if isinstance(value, str):
        bad = {"minLength": len(value) < schema.get("minLength", 0), "maxLength": len(value) > schema.get("maxLength", len(value))}
        bad["pattern"] = "pattern" in schema and not re.search(schema["pattern"], value)
        out += [f"{at or '/'}: {k}" for k, x in bad.items() if x]
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}/{k}: required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in own:
                out += violations(value[k], own[k], f"{at}/{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}/{k}: additional")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}/{i}")
    return out


def known_schema(schema: dict) -> None:
    """Raises ValueError if a schema names a type that JSON doesn't have, or nests beyond DEPTH."""
    waiting = [(schema, 0)]
    while waiting:
        own, depth = waiting.pop()
        kinds = own.get("type", [])
        unknown = {kinds} - _TYPES if isinstance(kinds, str) else set(kinds) - _TYPES
        if unknown or depth > DEPTH:
            raise ValueError(f"unknown types {sorted(unknown)}" if unknown else "nested too deeply")
        waiting += [(x, depth + 1) for x in (*own.get("properties", {}).values(), *([own["items"]] if "items" in own else []))]


def formatted(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per message, with its place, links, errors and canonical JSON.

    ``messages`` has conv_id, turn, role, content, tool_calls (of type CALLS) and tool_call_id; ``schemas`` the JSON schema
    of each tool's arguments. Returns conv_id, turn, anchor_turn, slot, n_calls, n_answered, linked (null but for tool
    messages: whether its call was found), errors and json.

    A call or result without an identifier, and one without partner, stays in place unlinked. Arguments that are not a
    JSON object are an error and stay a string, and so do those that canonical JSON can't hold: numbers beyond a double,
    lone surrogates, more than DEPTH levels. Arguments of an unknown tool are an error. Keywords of schemas other than
    those of ``violations`` are ignored; an unknown type in one raises ValueError. Null entries of tool_calls don't
    count. Null fields are left out of the JSON;
    null content is written as null. Rows that share (conv_id, turn) are repeats of one turn: each gets its row, with
    counts over all of them. Rows with a null conv_id or turn are never linked.
    """
    for schema in schemas.values():
        known_schema(schema)
    own_calls = F.filter(F.col("tool_calls").cast(CALLS), lambda c: c.isNotNull())
    rows = messages.select("conv_id", "turn", "role", F.col("content").cast("string").alias("content"), own_calls.alias("tool_calls"), "tool_call_id")
    calls = rows.select("conv_id", "turn", F.posexplode("tool_calls").alias("call", "of")).select("conv_id", "turn", "call", F.col("of.id").alias("id"))
    nth = F.row_number().over(W.partitionBy("conv_id", "id").orderBy("turn", "call"))
    calls = calls.where("conv_id is not null and turn is not null and id is not null").withColumn("nth", nth)
    answers = (F.col("role") == "tool") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("tool_call_id").isNotNull()
    results = rows.where(answers).withColumn("nth", F.row_number().over(W.partitionBy("conv_id", "tool_call_id").orderBy("turn")))
    right = calls.select("conv_id", F.col("id").alias("tool_call_id"), "nth", F.col("turn").alias("to_turn"), F.col("call").alias("to_call"))
    linked = results.join(right.hint("shuffle_hash"), ["conv_id", "tool_call_id", "nth"], "left").drop("nth")
    calling = F.coalesce(F.size("tool_calls") > 0, F.lit(False))
    linked = linked.withColumns({c: F.when(~calling | (F.col("to_turn") < F.col("turn")), F.col(c)) for c in ("to_call", "to_turn")})
    answered = linked.where("to_turn is not null").groupBy("conv_id", F.col("to_turn").alias("turn")).agg(F.count("*").alias("n_answered"))
    others = rows.where(~F.coalesce(answers, F.lit(False))).withColumns({"to_turn": F.lit(None).cast("long"), "to_call": F.lit(None).cast("int")})
    whole = linked.unionByName(others).join(answered, ["conv_id", "turn"], "left")
    whole = whole.select(
        "conv_id",
        "turn",
        F.coalesce(F.when(~calling, F.col("to_turn")), "turn").alias("anchor_turn"),
        F.coalesce(F.when(~calling, F.col("to_call") + 1), F.lit(0)).alias("slot"),
        F.greatest(F.size("tool_calls"), F.lit(0)).alias("n_calls"),
        F.coalesce("n_answered", F.lit(0)).alias("n_answered"),
        F.when(F.col("role") == "tool", F.col("to_turn").isNotNull()).alias("linked"),
        "role",
        "content",
        "tool_calls",
        "tool_call_id",
    )
    kept = whole.columns[:7]
    names = [*kept, "errors", "json"]

    def written_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, texts = [], []
            for role, content, tool_calls, call_id in zip(*(batch.column(c).to_pylist() for c in ("role", "content", "tool_calls", "tool_call_id")), strict=True):
                wrong: list[str] = []
                message: dict[str, Any] = {"role": role, "content": content}
                if call_id is not None:
                    message["tool_call_id"] = call_id
                if tool_calls:
                    message["tool_calls"] = [_call(c, schemas, wrong) for c in tool_calls]
                errors.append(wrong)
                texts.append(canonical(message))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())], names)

    schema = whole.select(*kept, F.array().cast("array<string>").alias("errors"), F.lit("").alias("json")).schema
    return whole.mapInArrow(written_out, schema)


def parsed(text: str) -> Any:
    """A JSON text's value; ValueError or RecursionError if it is none, or canonical JSON can't hold it."""
    value = json.loads(text, parse_constant=_refused, parse_float=_finite, parse_int=_whole)
    level = [value] if isinstance(value, dict | list) else []
    for _ in range(DEPTH):
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v) if isinstance(x, dict | list)]
    if level:
        raise RecursionError
    if "\\u" in text:
        canonical(value).encode()  # a lone surrogate is a UnicodeEncodeError
    return value


def _whole(text: str) -> int:
    _finite(text)
    return int(text)


def _finite(text: str) -> float:
    if not math.isfinite(value := float(text)):
        raise ValueError(text)
    return value


def _refused(text: str) -> None:
    raise ValueError(text)


def _call(call: dict, schemas: dict[str, dict], wrong: list[str]) -> dict:
    name, arguments = call["name"], call["arguments"]
    try:
        value = parsed(arguments) if arguments is not None else {}
    except (ValueError, RecursionError):
        value = arguments
    if not isinstance(value, dict):
        wrong.append(f"{call['id']}: arguments are not an object")
        value = arguments
    elif name not in schemas:
        wrong.append(f"{call['id']}: unknown tool")
    else:
        wrong += [f"{call['id']}: {v}" for v in violations(value, schemas[name])]
    function = {k: v for k, v in (("name", name), ("arguments", value)) if v is not None}
    return {k: v for k, v in (("id", call["id"]), ("type", "function"), ("function", function)) if v is not None}


#: The tool of the registered query, and the longest text that it takes.
TOOL, LONGEST = "reply", 1200
SCHEMAS = {
    TOOL: {
        "type": "object",
        "required": ["n_chars", "text"],
        "additionalProperties": False,
        "properties": {"n_chars": {"type": "integer", "minimum": 1, "maximum": LONGEST}, "text": {"type": "string", "minLength": 1}},
    }
}


def tool_traffic(conversations: DataFrame) -> DataFrame:
    """Messages with tool calls from plain conversations: each assistant turn calls TOOL with its text, each user turn
    that follows another turn is a tool message that answers the turn before it."""
    calls = F.array(F.struct(F.concat(F.lit("call-"), "turn").alias("id"), F.lit(TOOL).alias("name"), F.to_json(F.struct(F.char_length("text").alias("n_chars"), "text")).alias("arguments")))
    answers = (F.col("role") == "user") & (F.col("turn") > 0)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(answers, F.lit("tool")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") != "assistant", F.col("text")).alias("content"),
        F.when(F.col("role") == "assistant", calls).alias("tool_calls"),
        F.when(answers, F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string"))).alias("tool_call_id"),
    )


def report(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, anchor_turn, slot, n_calls, n_answered, linked, n_errors, json_sha256) of ``tool_traffic``."""
    out = formatted(tool_traffic(conversations), SCHEMAS)
    return out.select("conv_id", "turn", "anchor_turn", "slot", "n_calls", "n_answered", "linked", F.size("errors").alias("n_errors"), F.sha2("json", 256).alias("json_sha256"))
