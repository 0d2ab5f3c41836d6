"""Chat formatting: tool calls linked to their results, ordered and written as canonical JSON.

Messages are rows (conv_id, turn, role, text).  A text that is a JSON object may
hold ``tools`` (schemas by name), ``tool_calls`` (a list of {id, name,
arguments, depends_on?}) or ``tool_call_id`` with ``content`` (a result); all
other texts are plain messages.

Every message becomes one or more *items*: itself, and each of its calls.
Results are joined to calls by (conv_id, id) with a hash join; a call id given
twice belongs to its first turn, and a result to its call wherever it stands.
The order is topological: an item's position is the largest of its own turn
and the positions of what it needs (a result its call, a call the results of
the calls in ``depends_on``), found by passing positions along the links until
none changes; among equal positions, ``depth`` (the links passed) orders, then
the turn.  Items on a cycle are marked and keep their own turn.  Sorting by
(conv_id, position, depth, turn, item) gives the transcript, so that no
conversation is gathered in one task.

Arguments are validated against the tool's schema (the conversation's own, else
the ``tools`` given) by the keywords in ``_FORMS``.  Where a schema
has any other keyword that may refuse a value, or one of these in a form that JSON
schema does not know, that keyword is passed over and arguments without a problem are
neither valid nor not: null.

Edge cases: a null text is an empty message; null conv_id, turn or role are
carried; text that begins like JSON but isn't, or is nested deeper than ``NESTED``,
is a plain message; a lone surrogate stays the escape that it was; bytes that are no UTF-8 are
replaced; numbers too large for a double are null; repeated rows
give repeated items; a result without a call is ``orphan``, a call without a
result ``open``; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, stage

#: Levels of a JSON text that is read as more than a plain message.
NESTED = 200


def _number(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and math.isfinite(v)


# JSON schema's names of types.
_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": _number,
    "integer": lambda v: _number(v) and (isinstance(v, int) or v.is_integer()),
}
# JSON schema's keywords that are checked, with the form that each must have.
_FORMS = {
    "type": lambda v: isinstance(v, str) and v in _TYPES or isinstance(v, list) and v != [] and all(isinstance(k, str) and k in _TYPES for k in v),
    "enum": lambda v: isinstance(v, list),
    "const": lambda v: True,
    "allOf": lambda v: isinstance(v, list),
    "properties": lambda v: isinstance(v, dict),
    "required": lambda v: isinstance(v, list) and all(isinstance(k, str) for k in v),
    "additionalProperties": lambda v: isinstance(v, (bool, dict)),
    "items": lambda v: isinstance(v, (bool, dict)),
    "uniqueItems": lambda v: isinstance(v, bool),
    "multipleOf": lambda v: _number(v) and v > 0,
} | dict.fromkeys(("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "minItems", "maxItems"), _number)
# Keywords that refuse nothing.
_NOTES = {"title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment", "$defs", "definitions", "format"}
#: Rules on a value alone: what kind of value each is for, and when it is broken.
_BREAKS = {
    "enum": (lambda v: True, lambda v, b: canonical(v) not in [canonical(x) for x in b]),
    "const": (lambda v: True, lambda v, b: canonical(v) != canonical(b)),
    "minimum": (_number, lambda v, b: v < b),
    "maximum": (_number, lambda v, b: v > b),
    "exclusiveMinimum": (_number, lambda v, b: v <= b),
    "exclusiveMaximum": (_number, lambda v, b: v >= b),
    "multipleOf": (_number, lambda v, b: Fraction(str(v)) % Fraction(str(b)) != 0),
    "minLength": (_TYPES["string"], lambda v, b: len(v) < b),
    "maxLength": (_TYPES["string"], lambda v, b: len(v) > b),
    "minItems": (_TYPES["array"], lambda v, b: len(v) < b),
    "maxItems": (_TYPES["array"], lambda v, b: len(v) > b),
    "uniqueItems": (_TYPES["array"], lambda v, b: b and len({canonical(x) for x in v}) < len(v)),
}
_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """Sorted keys, no spaces, characters as they are but for lone surrogates; whole floats as integers; no NaN."""

    def whole(v):
        if isinstance(v, dict):
            return {k: whole(x) for k, x in v.items()}
        if isinstance(v, list):
            return [whole(x) for x in v]
        if isinstance(v, float):
            if not math.isfinite(v):
                return None
            return int(v) if v.is_integer() and abs(v) < 2**53 else v
        return v

    text = json.dumps(whole(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def problems(value, schema, at: str = "$") -> list[str]:
    """How a value breaks a schema, as paths with the rule's name."""
    if schema is False:
        return [f"{at}: false"]
    if not isinstance(schema, dict):
        return []
    rules = {k: v for k, v in schema.items() if k in _FORMS and _FORMS[k](v)}
    kinds = rules.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{at}: type"]
    out = [f"{at}: {rule}" for rule, (concerns, broken) in _BREAKS.items() if rule in rules and concerns(value) and broken(value, rules[rule])]
    for one in rules.get("allOf", []):
        out += problems(value, one, at)
    if isinstance(value, list):
        for k, v in enumerate(value):
            out += problems(v, rules.get("items"), f"{at}[{k}]")
    if isinstance(value, dict):
        known, others = rules.get("properties", {}), rules.get("additionalProperties")
        out += [_plain(f"{at}.{k}: required") for k in rules.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                out += problems(v, known[k], _plain(f"{at}.{k}"))
            elif "patternProperties" in schema:
                continue  # whether a pattern takes it is not checked
            elif others is False:
                out.append(_plain(f"{at}.{k}: additionalProperties"))
            else:
                out += problems(v, others, _plain(f"{at}.{k}"))
    return out


def _plain(text: str) -> str:
    return _SURROGATE.sub("\ufffd", text)


def undecided(schema) -> bool:
    """Whether a schema, or one inside it, has a keyword that is not checked."""
    if not isinstance(schema, dict):
        return not isinstance(schema, (bool, type(None)))
    if any(k not in _NOTES and not (k in _FORMS and _FORMS[k](v)) for k, v in schema.items()):
        return True
    inner = [schema.get("items"), schema.get("additionalProperties"), *schema.get("properties", {}).values(), *schema.get("allOf", [])]
    return any(undecided(x) for x in inner)


def _no_constant(name: str):
    raise ValueError(name)


def _object(text: str | None) -> dict | None:
    if not text or not text.lstrip(" \t\n\r").startswith("{"):
        return None
    try:
        value = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    level, depth = [value], 0
    while level:
        level, depth = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)], depth + 1
        if depth > NESTED:
            return None
    return value if isinstance(value, dict) else None


def items(text: str | None, role: str | None) -> list[dict]:
    """A message's own item (number 0), one for each schema it brings, and one for each of its calls.

    An item's id is the JSON of the id, so that any two ids differ; ``json`` is what the item is written as.
    """
    value, of = _object(text), canonical(role)
    message = lambda content: f'{{"content":{canonical(content)},"role":{of}}}'
    written = lambda content, none: content if isinstance(content, str) else none if content is None else canonical(content)
    if value is None:
        return [{"item": 0, "kind": "message", "json": message(text or "")}]
    if isinstance(value.get("tool_call_id"), str):
        own = canonical(value["tool_call_id"])
        return [{"item": 0, "kind": "result", "id": own, "json": f'{{"content":{canonical(written(value.get("content"), "null"))},"role":{of},"tool_call_id":{own}}}'}]
    out = [{"item": 0, "kind": "message", "json": message(text)}]
    calls = value.get("tool_calls")
    if isinstance(calls, list) and all(isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str) for c in calls):
        out = [out[0] | {"json": message(written(value.get("content"), ""))}]
        for k, call in enumerate(calls, 1):
            arguments = call.get("arguments")
            if isinstance(arguments, str):
                arguments = _object(arguments) if _object(arguments) is not None else arguments
            needs = call.get("depends_on")
            own, name, given = canonical(call["id"]), canonical(call["name"]), canonical(arguments)
            needs = [canonical(n) for n in needs if isinstance(n, str)] if isinstance(needs, list) else []
            out.append({"item": k, "kind": "call", "id": own, "name": name, "arguments": given, "needs": needs, "json": f'{{"arguments":{given},"id":{own},"name":{name},"role":{of}}}'})
    tools = value.get("tools")
    if isinstance(tools, dict):
        out += [{"item": -k, "kind": "schema", "name": canonical(name), "json": canonical(schema)} for k, (name, schema) in enumerate(sorted(tools.items()), 1)]
    return out


_FIELDS = [("item", pa.int32()), ("kind", pa.string()), ("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("needs", pa.list_(pa.string())), ("json", pa.string())]
_SQL = "item int, kind string, id string, name string, arguments string, needs array<string>, json string"


def _parsed(batches):
    kind = pa.list_(pa.struct(_FIELDS))
    for batch in batches:
        text, role = ([x if x is None else x.decode(errors="replace") for x in batch.column(k).cast(pa.binary()).to_pylist()] for k in (3, 2))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([items(t, r) for t, r in zip(text, role)], kind)], ["conv_id", "turn", "role", "items"])


def _valid(batches):
    """The problems of each call's arguments; null without a schema, or where none is found but not all is checked."""
    for batch in batches:
        found = []
        for given, schema in zip(batch.column("arguments").to_pylist(), batch.column("schema").to_pylist()):
            schema = None if schema is None else (json.loads(schema),)
            found.append(None if schema is None else problems(json.loads(given), *schema) or (None if undecided(*schema) else []))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item"), pa.array(found, pa.list_(pa.string()))], ["row", "item", "problems"])


def format_chat(messages: DataFrame, tools: dict | None = None) -> DataFrame:
    """One row for each item with its place in the order, its link, its validity and its canonical JSON."""
    kinds = {c: messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role")}
    parsed = messages.select("conv_id", "turn", "role", "text").transform(in_arrow, _parsed, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, items array<struct<{', '.join(f.replace(' ', ':', 1) for f in _SQL.split(', '))}>>")
    each = stage(parsed.withColumn("row", F.monotonically_increasing_id()).select("conv_id", "turn", "role", "row", F.explode("items").alias("x")).select("conv_id", "turn", "role", "row", "x.*"), "items")

    calls = each.where("kind = 'call'")
    first = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row", "item")).alias("at"))
    results = each.where("kind = 'result'")
    schemas = each.where("kind = 'schema'").groupBy("conv_id", "name").agg(F.max(F.struct("turn", "row", "json"))["json"].alias("schema"))
    given = [(canonical(k), canonical(v)) for k, v in sorted((tools or {}).items())]
    fallback = F.element_at(F.create_map(*(F.lit(x) for pair in given for x in pair)), F.col("name")) if given else F.lit(None).cast("string")
    asked = calls.alias("c").join(schemas.alias("s"), F.col("c.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("c.name") == F.col("s.name")), "left").select("c.row", "c.item", "c.arguments", "c.name", "schema")
    valid = asked.select("row", "item", "arguments", F.coalesce("schema", fallback).alias("schema")).transform(in_arrow, _valid, "row long, item int, problems array<string>")

    linked = results.alias("r").join(first.alias("f"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.id") == F.col("f.id")), "left").select("r.row", "r.item", F.col("f.at.row").alias("to_row"), F.col("f.at.item").alias("to_item"), F.col("f.at.turn").alias("to_turn"))
    answered = results.select("conv_id", "id").distinct()
    needs = calls.select("conv_id", "row", "item", F.explode("needs").alias("need"))
    waits = needs.alias("n").join(results.alias("r"), F.col("n.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("n.need") == F.col("r.id"))).select("n.row", "n.item", F.col("r.row").alias("to_row"), F.col("r.item").alias("to_item"))
    edges = stage(linked.where("to_row is not null").select("row", "item", "to_row", "to_item").union(waits).distinct(), "edges")
    placed = _order(each.where("kind != 'schema'").select("row", "item", "turn"), edges)

    status = linked.select("row", "item", F.when(F.col("to_row").isNull(), "orphan").otherwise("linked").alias("link"))
    state = calls.alias("c").join(answered.alias("a"), F.col("c.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("c.id") == F.col("a.id")), "left").select("c.row", "c.item", F.when(F.col("a.id").isNull(), "open").otherwise("linked").alias("link"))
    shown = each.where("kind != 'schema'")
    # only calls and results have links, so plain messages pass these joins by
    special = shown.where("kind != 'message'").join(status.union(state), ["row", "item"], "left").join(valid, ["row", "item"], "left").join(placed, ["row", "item"], "left")
    plain = shown.where("kind = 'message'").select("*", F.lit(None).cast("string").alias("link"), F.lit(None).cast("array<string>").alias("problems"), F.col("turn").cast("long").alias("position"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("cyclic"))
    columns = ["conv_id", "turn", "item", "kind", "json", "link", "problems", "position", "depth", "cyclic"]
    return special.select(columns).unionByName(plain.select(columns)).select(
        "conv_id", "turn", "item", "kind", F.coalesce("position", F.col("turn").cast("long")).alias("position"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"), "link", F.when(F.col("problems").isNotNull(), F.size("problems") == 0).alias("valid"), "problems", "json",
    )


def _order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(row, item, position, depth, cyclic) of every item with a link.

    Kahn's algorithm in rounds: an item whose needs are all placed is placed
    after them; what is left when a round places nothing lies on or behind a
    cycle.  There are as many rounds as the longest chain of links, and a round
    rewrites only the links of items that still wait.
    """
    turns = nodes.select("row", "item", F.col("turn").cast("long").alias("turn"))
    none = F.lit(None).cast("long")
    waiting = stage(edges.join(turns, ["row", "item"]).select("row", "item", "turn", "to_row", "to_item", none.alias("position"), none.alias("depth")), "waiting")
    targets = edges.select(F.col("to_row").alias("row"), F.col("to_item").alias("item")).distinct()
    free = targets.join(edges.select("row", "item").distinct(), ["row", "item"], "left_anti").join(turns, ["row", "item"])
    free = stage(free.select("row", "item", F.col("turn").alias("position"), F.lit(0).cast("long").alias("depth")), "placed")
    done = [(0, free)]
    while True:
        met = waiting.join(free.select(F.col("row").alias("to_row"), F.col("item").alias("to_item"), F.col("position").alias("p"), F.col("depth").alias("d")), ["to_row", "to_item"], "left")
        met = stage(met.select("row", "item", "turn", "to_row", "to_item", F.coalesce("position", "p").alias("position"), F.coalesce("depth", "d").alias("depth")), "waiting")
        # a need without a turn has no position, but a depth
        ready = met.groupBy("row", "item").agg(F.max("turn").alias("turn"), F.max("position").alias("p"), F.max("depth").alias("d"), F.bool_and(F.col("depth").isNotNull()).alias("all")).where("all")
        free = stage(ready.select("row", "item", F.greatest("turn", "p").alias("position"), (F.col("d") + 1).alias("depth")), "placed")
        if not free.limit(1).count():
            break
        waiting, level = met.join(free, ["row", "item"], "left_anti"), 0
        # tables of like size are put together, so that no row is written more than a few times
        while done and done[-1][0] == level:
            free_before, level = done.pop()[1], level + 1
            free_all = stage((free if level == 1 else free_all).union(free_before), "placed")
        done.append((level, free if level == 0 else free_all))
    out = None
    for _, one in done:
        out = one if out is None else out.union(one)
    left = met.select("row", "item", F.col("turn").alias("position")).distinct().withColumn("depth", F.lit(0).cast("long")).withColumn("cyclic", F.lit(True))
    return out.withColumn("cyclic", F.lit(False)).unionByName(left)
