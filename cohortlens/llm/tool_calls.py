"""Chat formatting with linked tool calls (operator 1).

Turns carry calls, results and schemas as tagged JSON in their text:

* ``<tool_call>{"id": .., "name": .., "arguments": {..}}</tool_call>`` in assistant turns;
* ``<tool_result>{"id": .., "content": ..}</tool_result>`` in tool turns;
* ``<tools>[{"name": .., "parameters": {JSON schema}}]</tools>`` in system turns.

Calls and results are hash-joined by conversation and identifier. A call whose arguments hold
``{"$ref": "id"}`` depends on that call: calls get their place in a topological order by levels, found by
joins that stop when nothing changes (calls on a cycle, or that depend on one, get level -1). Chains of calls
with one reference each are shortened by doubling first; a round of joins is left for each level of calls
with several references, however many levels there are. Arguments are
validated against the schema of their name. Every turn is serialised as canonical JSON: sorted keys, no
spaces, UTF-8, shortest numbers.

Turns are rows throughout; no task gathers a conversation, however long. Defined cases: of several calls
(results) with an identifier in a conversation the first by turn and place counts, the others are
``duplicate``; a result without an earlier call is an orphan; a call without a result stays unlinked;
malformed JSON, or JSON nested too deep to read, stays part of the text and counts as malformed; a call
without schema is valid, with ``no_schema`` as its check; a schema that can't be applied makes its calls
invalid, as ``bad_schema``. Null texts and roles serialise as null. Extra columns are ignored. Repeated
rows (equal conversation, turn, role and text) are one turn. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, read_table

_LONE = re.compile("[\ud800-\udfff]")
_TAG = re.compile(r"<(tool_call|tool_result|tools)>(.*?)</\1>", re.S)


def canonical(value: Any) -> str:
    """JSON with sorted keys and nothing between; whole floats as integers."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, float):
            if v != v or v in (float("inf"), float("-inf")):
                return None
            return int(v) if v == int(v) and abs(v) < 2**53 else v
        return v

    out = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", out)  # UTF-8 has no half of a pair


_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def validate(value: Any, schema: Any, path: str = "$", root: Any = None, seen: tuple = ()) -> list[str]:
    """Errors of a value under a JSON schema: type, enum, const, required, properties, additionalProperties, items, bounds, multipleOf, pattern, allOf, anyOf, oneOf, not, and $ref within the schema."""
    root = schema if root is None else root
    if schema is True or not isinstance(schema, dict):
        return [f"{path}: not allowed"] if schema is False else []
    out: list[str] = []
    inner = lambda v, s, at=path: validate(v, s, at, root, seen)
    if isinstance(schema.get("$ref"), str):
        target = root
        for part in schema["$ref"].removeprefix("#").strip("/").split("/"):
            if part:
                target = target[part.replace("~1", "/").replace("~0", "~")]
        if (schema["$ref"], path) not in seen:
            out += validate(value, target, path, root, (*seen, (schema["$ref"], path)))
    wanted = schema.get("type")
    if wanted is not None:
        names = wanted if isinstance(wanted, list) else [wanted]

        def fits(name):
            if name in ("integer", "number"):
                whole = isinstance(value, (int, float)) and not isinstance(value, bool)
                return whole and (name == "number" or value == int(value))
            return isinstance(value, _TYPES.get(name, ()))

        if not any(map(fits, names)):
            return [*out, f"{path}: not of type {'/'.join(map(str, names))}"]
    if "enum" in schema and not any(type(value) is type(x) and value == x or _number(value) and _number(x) and value == x for x in schema["enum"]):
        out.append(f"{path}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{path}: not the constant")
    for part in schema.get("allOf", ()):
        out += inner(value, part)
    if "anyOf" in schema and all(inner(value, part) for part in schema["anyOf"]):
        out.append(f"{path}: none of anyOf")
    if "oneOf" in schema and sum(not inner(value, part) for part in schema["oneOf"]) != 1:
        out.append(f"{path}: not one of oneOf")
    if "not" in schema and not inner(value, schema["not"]):
        out.append(f"{path}: what it must not be")
    if isinstance(value, dict):
        own = schema.get("properties") or {}
        if not isinstance(own, dict):
            raise TypeError("properties")
        out += [f"{path}.{k}: missing" for k in schema.get("required") or [] if k not in value]
        for k in sorted(value):
            if k in own:
                out += inner(value[k], own[k], f"{path}.{k}")
            elif "additionalProperties" in schema:
                out += [f"{path}.{k}: unknown"] if schema["additionalProperties"] is False else inner(value[k], schema["additionalProperties"], f"{path}.{k}")
    elif isinstance(value, list):
        if "items" in schema:
            for k, x in enumerate(value):
                out += inner(x, schema["items"], f"{path}[{k}]")
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            out.append(f"{path}: number of items")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{path}: pattern")
    elif _number(value):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{path}: out of bounds")
        if "multipleOf" in schema and value % schema["multipleOf"]:
            out.append(f"{path}: no multiple")
    return out


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def check(body: str, schema: str | None) -> str:
    """Errors joined by ``; ``. Without a schema ``no_schema``; ``bad_schema`` where the schema itself can't be applied."""
    if schema is None:
        return "no_schema"
    try:
        return "; ".join(validate(json.loads(body), json.loads(schema)))
    except (re.error, TypeError, ValueError, KeyError, IndexError, AttributeError, RecursionError, OverflowError, ZeroDivisionError):
        return "bad_schema"


def references(value: Any) -> list[str]:
    """Identifiers that a value refers to, sorted."""
    found: set[str] = set()
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if set(v) == {"$ref"} and isinstance(v["$ref"], str):
                found.add(v["$ref"])
            stack += v.values()
        elif isinstance(v, list):
            stack += v
    return sorted(found)


def parse_turn(role: str | None, text: str | None) -> tuple[str | None, list[dict], int]:
    """The text without its items, the items (kind, id, name, body, refs), and how many were malformed."""
    if not text or "<tool" not in text:
        return text, [], 0
    items, bad, rest, end = [], 0, [], 0
    allowed = {"tool_call": "assistant", "tool_result": "tool", "tools": "system"}
    for m in _TAG.finditer(text):
        if allowed[m[1]] != role:
            continue
        try:
            body = json.loads(m[2])
            canonical(body)
        except (ValueError, RecursionError):
            bad += 1
            continue
        if m[1] == "tools":
            own = [(None, t["name"], t.get("parameters", {})) for t in body if isinstance(t, dict) and isinstance(t.get("name"), str)] if isinstance(body, list) else []
        else:
            ok = isinstance(body, dict) and isinstance(body.get("id"), str) and (m[1] == "tool_result" or isinstance(body.get("name"), str))
            own = [(body["id"], body.get("name"), body.get("arguments", {}) if m[1] == "tool_call" else body.get("content"))] if ok else []
        if not own:
            bad += 1
            continue
        if any(_LONE.search(f"{ident}{name}") for ident, name, _ in own):
            bad += 1
            continue
        for ident, name, value in own:
            items.append({"kind": m[1], "id": ident, "name": name, "body": canonical(value), "refs": references(value) if m[1] == "tool_call" else []})
        rest.append(text[end : m.start()])
        end = m.end()
    return "".join([*rest, text[end:]]), items, bad


_ITEM = pa.list_(pa.struct([("kind", pa.string()), ("id", pa.string()), ("name", pa.string()), ("body", pa.string()), ("refs", pa.list_(pa.string()))]))
_PARSED = "conv_id long, turn long, role string, row string, content string, items array<struct<kind:string,id:string,name:string,body:string,refs:array<string>>>, malformed int"


def _parse(turns: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_turn(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], _ITEM), pa.array([r[2] for r in rows], pa.int32())], ["conv_id", "turn", "role", "row", "content", "items", "malformed"])

    return turns.mapInArrow(run, _PARSED)


def _heads(edges: DataFrame, work: Workspace) -> DataFrame:
    """conv_id, id, head, steps: where the chain of a call with one reference ends, at a call with none or several.

    Each round doubles the steps. What still moves after as many rounds as the longest chain can need is on or
    behind a cycle, and left out.
    """
    heads = edges.groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("head")).where("n = 1")
    heads = work.keep(heads.select("conv_id", "id", "head", F.lit(1).cast("long").alias("steps")), "heads0")
    most = heads.count().bit_length()
    for k in range(1, most + 2):
        on = heads.select("conv_id", F.col("id").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"))
        joined = heads.join(on, ["conv_id", "head"], "left")
        moved = joined.select("conv_id", "id", F.coalesce("next", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        if k > most or joined.where("next is not null").isEmpty():
            heads = work.keep(joined.where("next is null").select(*heads.columns), "heads")
            work.drop(f"heads{k - 1}")
            return heads
        heads = work.keep(moved, f"heads{k}")
        work.drop(f"heads{k - 1}")
    return heads


def _levels(calls: DataFrame, work: Workspace) -> DataFrame:
    """conv_id, id, level: 0 without references to calls of the conversation, else one more than theirs; -1 on or behind a cycle."""
    nodes = calls.where("not duplicate").select("conv_id", "id")
    edges = calls.where("not duplicate").select("conv_id", "id", F.explode("refs").alias("ref"))
    edges = edges.join(nodes.select("conv_id", F.col("id").alias("ref")), ["conv_id", "ref"]).distinct()
    edges = work.keep(edges, "edges")
    base = nodes.join(edges.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0).cast("long"))
    level = work.keep(base, "level0")
    if not edges.isEmpty():
        heads = _heads(edges, work)
        several = edges.groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id", "id")
        own = edges.join(several, ["conv_id", "id"], "left_semi").join(heads.withColumnRenamed("id", "ref"), ["conv_id", "ref"], "left")
        own = work.keep(own.select("conv_id", "id", F.coalesce("head", "ref").alias("ref"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "several")
        base, left = level, own.count()
        k = 0
        while left:
            k += 1
            known = level.select("conv_id", F.col("id").alias("ref"), F.col("level").alias("ref_level"))
            grown = own.join(known, ["conv_id", "ref"], "left").groupBy("conv_id", "id").agg(F.count_if(F.col("ref_level").isNull()).alias("open"), F.max(F.col("ref_level") + F.col("steps")).alias("level"))
            level = work.keep(base.unionByName(grown.where("open = 0").select("conv_id", "id", "level")), f"level{k}")
            if k > 1:
                work.drop(f"level{k - 1}")
            now = own.join(level.select("conv_id", "id"), ["conv_id", "id"], "left_anti").count()
            if now == left:
                break
            left = now
        ends = level.select("conv_id", F.col("id").alias("head"), F.col("level").alias("end"))
        chained = heads.join(ends, ["conv_id", "head"]).select("conv_id", "id", (F.col("end") + F.col("steps")).alias("level"))
        level = level.unionByName(chained)
    return nodes.join(level, ["conv_id", "id"], "left").withColumn("level", F.coalesce("level", F.lit(-1)).cast("int"))


def link(turns: DataFrame) -> dict[str, DataFrame]:
    """``messages`` (a row a turn), ``calls`` (a row a call) and ``orphans`` (results without a call)."""
    work = Workspace(turns.sparkSession, "tool-calls")
    source = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # Rows of one conversation and turn are told apart by what they say.
    row = F.sha2(F.to_json(F.struct("role", "text")), 256).alias("row")
    parsed = work.keep(_parse(source.dropDuplicates().select("conv_id", "turn", "role", row, "text")), "parsed")
    items = parsed.select("conv_id", "turn", "row", F.posexplode("items").alias("place", "x")).select("conv_id", "turn", "row", "place", "x.*")

    def first(kind: str, key: str) -> DataFrame:
        own = Window.partitionBy("conv_id", key).orderBy("turn", "row", "place")
        return items.where(F.col("kind") == kind).withColumn("duplicate", F.row_number().over(own) > 1)

    calls, results = first("tool_call", "id"), first("tool_result", "id")
    schemas = first("tools", "name").where("not duplicate").select("conv_id", "name", F.col("body").alias("schema"))
    answer = results.where("not duplicate").select("conv_id", "id", F.col("turn").alias("result_turn"), F.col("body").alias("result"))
    linked = calls.join(answer.hint("shuffle_hash"), ["conv_id", "id"], "left")
    later = ~F.col("duplicate") & (F.col("result_turn") > F.col("turn"))
    linked = linked.withColumn("result", F.when(later, F.col("result"))).withColumn("result_turn", F.when(later, F.col("result_turn")))
    checked = F.pandas_udf(lambda bodies, own: pd.Series([check(b, s) for b, s in zip(bodies, own)], dtype=object), "string")
    linked = linked.join(schemas, ["conv_id", "name"], "left").withColumn("errors", checked("body", "schema"))
    linked = linked.join(_levels(calls, work), ["conv_id", "id"], "left")
    linked = linked.select("conv_id", "turn", "row", "place", "id", "name", F.col("body").alias("arguments"), "duplicate", F.coalesce("level", F.lit(-1)).alias("level"), (F.col("result_turn").isNotNull()).alias("linked"), "result_turn", "result", "errors", F.col("errors").isin("", "no_schema").alias("valid"))
    linked = work.keep(linked, "calls")

    # A turn's calls in topological order; bounded by the turn's own text.
    of_turn = linked.groupBy("conv_id", "turn", "row").agg(
        F.array_sort(F.collect_list(F.struct("level", "place", "id", "name", "arguments", "valid", "linked"))).alias("calls"),
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if("linked").alias("n_linked"),
        F.count_if(~F.col("valid")).alias("n_invalid"),
    )
    answered = linked.where("linked").select("conv_id", "id", F.col("turn").alias("call_turn"))
    orphans = work.keep(results.join(answered, ["conv_id", "id"], "left").where(F.col("call_turn").isNull() | F.col("duplicate")).select("conv_id", "turn", "row", "place", "id", "body", "duplicate"), "orphans")

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for role, content, own, found in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                message: dict[str, Any] = {"content": content, "role": role}
                if own:
                    message["tool_calls"] = [{"arguments": json.loads(c["arguments"]), "id": c["id"], "name": c["name"]} for c in own]
                answers = [x for x in found or () if x["kind"] == "tool_result"]
                if answers:
                    message["results"] = [{"content": json.loads(x["body"]), "id": x["id"]} for x in answers]
                out.append(canonical(message))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *batch.columns[6:], pa.array(out, pa.string())], ["conv_id", "turn", "role", "n_calls", "n_linked", "n_invalid", "malformed", "message"])

    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    same = [parsed[c].eqNullSafe(of_turn[c]) for c in ("conv_id", "turn", "row")]
    joined = parsed.join(of_turn, same[0] & same[1] & same[2], "left")
    joined = joined.select(parsed["conv_id"], parsed["turn"], "role", "content", "calls", "items", zero("n_calls"), zero("n_linked"), zero("n_invalid"), F.col("malformed").cast("long"))
    messages = joined.mapInArrow(serialise, "conv_id long, turn long, role string, n_calls long, n_linked long, n_invalid long, malformed long, message string")
    return {"messages": messages, "calls": linked, "orphans": orphans}


def with_calls(conversations: DataFrame) -> DataFrame:
    """Turns with calls, by a stated rule, for conversations that hold none.

    Each assistant turn calls ``reply`` with its number of words and a reference to the call of the turn two
    before; turn + 1 brings a tool row with the result, its length, unless that is a multiple of seven; and
    each conversation begins with the schema, which allows up to 40 words.
    """
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    says = own.where((F.col("role") == "assistant") & F.col("text").isNotNull())
    words = F.size(F.filter(F.split("text", " ", -1), lambda x: x != ""))
    body = F.format_string('{"id":"c%d","name":"reply","arguments":{"words":%d,"after":{"$ref":"c%d"}}}', "turn", words, F.col("turn") - 2)
    calls = says.select("conv_id", "turn", "role", F.concat("text", F.lit("<tool_call>"), body, F.lit("</tool_call>")).alias("text"))
    rest = own.where(~((F.col("role") == "assistant") & F.col("text").isNotNull()) | F.col("role").isNull())
    result = F.format_string('<tool_result>{"id":"c%d","content":%d}</tool_result>', "turn", F.length("text"))
    results = says.where(F.length("text") % 7 != 0).select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("tool").alias("role"), result.alias("text"))
    schema = '<tools>[{"name":"reply","parameters":{"type":"object","required":["words"],"properties":{"words":{"type":"integer","maximum":40}}}}]</tools>'
    first = own.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit(schema).alias("text"))
    return calls.unionByName(rest).unionByName(results).unionByName(first)


def op1_tool_calls(spark, sf_dir):
    """Every turn of ``conversations`` as canonical JSON, with its calls linked; the table holds no calls, so turns get them by the rule of ``with_calls``."""
    out = link(with_calls(read_table(spark, sf_dir, "conversations")))["messages"]
    return out.withColumn("message_sha256", F.sha2("message", 256))


ORACLE = """
WITH own AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
says AS (SELECT *, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS words FROM own WHERE role = 'assistant' AND text IS NOT NULL),
told AS (SELECT s.*, length(text) % 7 <> 0 AS linked, EXISTS (SELECT 1 FROM says b WHERE b.conv_id = s.conv_id AND b.turn = s.turn - 2) AS chained FROM says s),
rows AS (
  SELECT conv_id, turn, role, 1 AS n_calls, CAST(linked AS INTEGER) AS n_linked, CAST(words > 40 AS INTEGER) AS n_invalid,
    '{"content":' || to_json(text) || ',"role":"assistant","tool_calls":[{"arguments":{"after":{"$ref":"c' || (turn - 2) || '"},"words":' || words || '},"id":"c' || turn || '","name":"reply"}]}' AS message
  FROM told
  UNION ALL
  SELECT conv_id, turn, role, 0, 0, 0, '{"content":' || coalesce(to_json(text), 'null') || ',"role":' || coalesce(to_json(role), 'null') || '}' FROM own
  WHERE NOT coalesce(role = 'assistant' AND text IS NOT NULL, false)
  UNION ALL
  SELECT DISTINCT conv_id, turn + 1, 'tool', 0, 0, 0, '{"content":"","results":[{"content":' || length(text) || ',"id":"c' || turn || '"}],"role":"tool"}' FROM told WHERE linked
  UNION ALL
  SELECT DISTINCT conv_id, -1, 'system', 0, 0, 0, '{"content":"","role":"system"}' FROM own
)
SELECT conv_id, turn, role, CAST(n_calls AS BIGINT) AS n_calls, CAST(n_linked AS BIGINT) AS n_linked, CAST(n_invalid AS BIGINT) AS n_invalid,
  CAST(0 AS BIGINT) AS malformed, message, sha256(message) AS message_sha256 FROM rows
"""
