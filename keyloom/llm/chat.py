"""Chat formatting: tool calls and their results, linked, ordered, validated, in canonical JSON.

Messages are parsed one by one. Calls and results meet in a hash join on
(conversation, call id); nothing gathers a conversation. Instead of a position
that one task would have to count, each message gets an order key
(order_turn, order_step, turn): a call's result is its only successor in the
graph of messages, so sorting by the key is a topological order, in which every
result follows its call and messages otherwise keep their turns.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _clean(text: str) -> str:
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def canonical(value) -> str:
    """JSON with keys in order of UTF-16 units, no space, and whole numbers without a fraction. Without recursion: values may be deep."""
    out: list[str] = []
    todo: list = [(value, False)]
    while todo:
        x, ready = todo.pop()
        if ready:
            out.append(x)
        elif isinstance(x, dict):
            todo.append(("}", True))
            items = sorted(x.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
            for k, (name, v) in reversed(list(enumerate(items))):
                todo += [(v, False), (("," if k else "") + _scalar(str(name)) + ":", True)]
            out.append("{")
        elif isinstance(x, list):
            todo.append(("]", True))
            for k, v in reversed(list(enumerate(x))):
                todo += [(v, False), ("," if k else "", True)]
            out.append("[")
        else:
            out.append(_scalar(x))
    return "".join(out)


def _scalar(value) -> str:
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        value = int(value)
    if isinstance(value, str):
        value = _clean(value)
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


_KEYWORDS = set("type enum const anyOf oneOf allOf not properties required additionalProperties items minItems maxItems uniqueItems minLength maxLength minimum maximum exclusiveMinimum exclusiveMaximum minProperties maxProperties".split())
_NOTES = set("$schema $id $comment title description default examples deprecated readOnly writeOnly".split())


def check_schema(schema, at: str = "$") -> None:
    """Raise on keywords that violations() doesn't know: they would be passed over in silence."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema is an object or a boolean")
    unknown = sorted(set(schema) - _KEYWORDS - _NOTES)
    if unknown:
        raise ValueError(f"{at}: keywords that aren't supported: {', '.join(unknown)}")
    kinds = schema.get("type", [])
    for kind in kinds if isinstance(kinds, list) else [kinds]:
        if kind not in (*_TYPES, "integer", "number"):
            raise ValueError(f"{at}: no type {kind}")
    for name in ("anyOf", "oneOf", "allOf"):
        for i, s in enumerate(schema.get(name, [])):
            check_schema(s, f"{at}.{name}[{i}]")
    for name in ("not", "items", "additionalProperties"):
        if name in schema:
            check_schema(schema[name], f"{at}.{name}")
    for name, s in schema.get("properties", {}).items():
        check_schema(s, f"{at}.{name}")


def _is_a(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
        return not isinstance(value, bool) and (whole if kind == "integer" else isinstance(value, (int, float)))
    return isinstance(value, _TYPES[kind])


def violations(value, schema, at: str = "$") -> list[str]:
    """How a value breaks a JSON schema of the keywords that check_schema() lets pass. Values are equal if their canonical JSON is: 1 and 1.0, not 1 and true."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    out: list[str] = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(_is_a(value, kind) for kind in kinds):
            return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    if "anyOf" in schema and all(violations(value, s, at) for s in schema["anyOf"]):
        out.append(f"{at}: none of anyOf")
    if "oneOf" in schema and sum(not violations(value, s, at) for s in schema["oneOf"]) != 1:
        out.append(f"{at}: not one of oneOf")
    if "not" in schema and not violations(value, schema["not"], at):
        out.append(f"{at}: what it must not be")
    out += [e for s in schema.get("allOf", []) for e in violations(value, s, at)]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        more = schema.get("additionalProperties", True)
        for k in sorted(value):
            if k in known or more is not True:
                out += violations(value[k], known.get(k, more), f"{at}.{k}")
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", math.inf):
            out.append(f"{at}: wrong number of members")
    elif isinstance(value, list):
        size = len(value)
        if "items" in schema:
            out += [e for i, v in enumerate(value) for e in violations(v, schema["items"], f"{at}[{i}]")]
        if not schema.get("minItems", 0) <= size <= schema.get("maxItems", math.inf):
            out.append(f"{at}: wrong number of items")
        if schema.get("uniqueItems") and len(set(map(canonical, value))) < size:
            out.append(f"{at}: repeated items")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            out.append(f"{at}: wrong length")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        within = schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf)
        if not (within and schema.get("exclusiveMinimum", -math.inf) < value < schema.get("exclusiveMaximum", math.inf)):
            out.append(f"{at}: out of bounds")
    return out


def _refuse(name: str):
    raise ValueError(name)


def _finite(digits: str) -> float:
    value = float(digits)
    return value if math.isfinite(value) else _refuse(digits)


def _json(text: str):
    """The value that a text is; ValueError if it isn't JSON, has a number out of a double's range, or is nested too deeply for the parser."""
    try:
        return json.loads(text, parse_constant=_refuse, parse_float=_finite)
    except RecursionError as error:
        raise ValueError("nested too deeply") from error


def _loaded(text: str | None):
    """The object that a text is, or None: the text is plain then."""
    if text is None or not text.lstrip().startswith("{"):
        return None
    try:
        found = _json(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def parsed(role: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[list[dict], str | None, str]:
    """(calls, id of the call that it answers, canonical JSON) of a message."""
    found = _loaded(text) if role in ("assistant", "tool") else None
    message: dict = {"role": role, "content": text}
    calls: list[dict] = []
    answers = None
    if role == "assistant" and found is not None and isinstance(found.get("tool_calls"), list):
        message["content"] = found.get("content")
        message["tool_calls"] = []
        for raw in found["tool_calls"]:
            own = raw if isinstance(raw, dict) else {}
            body = own.get("function") if isinstance(own.get("function"), dict) else own
            name, arguments, errors = body.get("name"), body.get("arguments", {}), []
            if isinstance(arguments, str):
                try:
                    arguments = _json(arguments)
                except ValueError:
                    errors.append("$: not JSON")
            ident = own.get("id")
            ident = None if ident is None else _clean(ident) if isinstance(ident, str) else canonical(ident)
            if ident is None:
                errors.append("id: missing")
            if not isinstance(name, str) or name not in schemas:
                errors.append("name: unknown tool")
            elif not errors:
                errors += violations(arguments, schemas[name])
            calls.append({"id": ident, "name": name if isinstance(name, str) else None, "arguments": canonical(arguments), "errors": [_clean(e) for e in errors]})
            message["tool_calls"].append({"id": ident, "name": name, "arguments": arguments})
    elif role == "tool" and found is not None and found.get("tool_call_id") is not None:
        ident = found["tool_call_id"]
        answers = _clean(ident) if isinstance(ident, str) else canonical(ident)
        message |= {"content": found.get("content"), "tool_call_id": answers}
    return calls, answers, canonical(message)


_CALL = "struct<id:string,name:string,arguments:string,errors:array<string>>"


def format_chats(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """A row for each message of messages (conv_id, turn, role, text).

    An assistant's text that is a JSON object with the list tool_calls (id,
    name, arguments, or function: {name, arguments}) makes calls; a tool's text
    that is an object with tool_call_id answers one. All else is plain text.

    conv_id, turn, role; json: the message in canonical form; calls (id, name,
    canonical arguments, errors against `schemas` by tool name); n_answered:
    its calls that have a result; answers: the id of the call that a result
    belongs to; call_turn: where that is, null if no call has the id; order_turn
    and order_step: with turn, role and json, a topological order of the
    conversation. Rows that are equal in all of these are equal rows.

    The first call of an id in a conversation counts for links; every result
    links to it. A result before its call moves behind it. Null texts give the
    content null; null roles are plain; with a null conv_id or turn nothing
    links. Repeated rows stay. Other columns are ignored; an empty table gives
    an empty table. A number out of a double's range isn't JSON: the text that
    has it is plain, and arguments that have it aren't valid. Schemas with
    keywords that aren't checked are refused (ValueError).
    """
    schemas = schemas or {}
    for name, schema in schemas.items():
        check_schema(schema, name)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    shared = messages.sparkSession.sparkContext.broadcast(schemas)  # the tools of the caller
    call_type = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("errors", pa.list_(pa.string()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [parsed(r, t, shared.value) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array([m[2] for m in made], pa.string()), pa.array([m[0] for m in made], pa.list_(call_type)), pa.array([m[1] for m in made], pa.string())],
                names=["conv_id", "turn", "role", "json", "calls", "answers"],
            )

    read = stage(rows.mapInArrow(parse, f"conv_id long, turn long, role string, json string, calls array<{_CALL}>, answers string"), "messages")
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    calling, answering = placed & (F.size("calls") > 0), placed & F.col("answers").isNotNull()
    calls = read.where(calling).select("conv_id", "turn", F.explode("calls.id").alias("id")).where("id is not null")
    first = calls.groupBy("conv_id", "id").agg(F.min("turn").alias("call_turn"))
    results = read.where(answering).groupBy("conv_id", F.col("answers").alias("id")).agg(F.count("*").alias("n"))
    answered = first.join(results, ["conv_id", "id"]).select("conv_id", "id", F.col("call_turn").alias("turn"))
    answered = answered.groupBy("conv_id", "turn").agg(F.count("*").alias("n_answered"))

    none = F.lit(None).cast("long")
    plain = read.where(~calling & ~answering).withColumn("n_answered", F.lit(0).cast("long")).withColumn("call_turn", none)
    with_calls = read.where(calling).join(answered, ["conv_id", "turn"], "left").withColumn("n_answered", F.coalesce("n_answered", F.lit(0).cast("long"))).withColumn("call_turn", none)
    linked = read.where(answering).join(first.withColumnRenamed("id", "answers"), ["conv_id", "answers"], "left").withColumn("n_answered", F.lit(0).cast("long"))
    out = plain.unionByName(with_calls).unionByName(linked)
    late = F.coalesce(F.col("call_turn") >= F.col("turn"), F.lit(False))
    return out.select(
        "conv_id", "turn", "role", "json", "calls", "n_answered", "answers", "call_turn", F.when(late, F.col("call_turn")).otherwise(F.col("turn")).alias("order_turn"), late.cast("int").alias("order_step")
    )
