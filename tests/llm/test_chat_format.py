import json
import random

import pytest
from pyspark.sql import functions as F

from tracefold.llm import chat_format as C

MESSAGES = "conv_id long, turn int, role string, text string"
SCHEMA = {"type": "object", "required": ["city"], "additionalProperties": False, "properties": {"city": {"type": "string", "minLength": 2}, "days": {"type": "integer", "minimum": 1}}}


def call(*calls, **more):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, **({"depends_on": d} if d else {})} for i, n, a, d in calls]} | more)


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


@pytest.fixture(scope="module")
def rows(spark):
    messages = [
        (1, 0, "system", json.dumps({"tools": {"weather": SCHEMA}})),
        (1, 1, "user", 'Wie ist "das" Wetter?\n'),
        (1, 2, "tool", result("b", {"z": 1.0, "a": "é"})),  # before its call
        (1, 3, "assistant", call(("a", "weather", {"days": 2, "city": "Bonn"}, None), ("b", "weather", '{"city": "X", "x": 1}', ["a"]), content="one moment")),
        (1, 4, "tool", result("a", "sun")),
        (1, 5, "tool", result("lost", "?")),
        (2, 0, "assistant", call(("a", "other", {}, None), ("c", "other", [1], ["d"]), ("d", "other", 1, ["c"]))),
        (2, 1, "tool", result("c", 1)),
        (2, 2, "tool", result("d", 2)),
        (2, 3, "assistant", call(("a", "other", {"again": True}, None))),
        (3, 0, "user", '{"not json'),
        (3, 1, None, None),
        (None, 2, "user", "no conversation"),
        (None, None, "tool", result("q", None)),
        (3, 1, None, None),
    ]
    return [r.asDict() for r in C.format_chat(spark.createDataFrame(messages, MESSAGES).repartition(3), {"other": {"type": "object"}}).collect()]


def of(rows, conv, **want):
    return [r for r in rows if r["conv_id"] == conv and all(r[k] == v for k, v in want.items())]


def test_links_and_validation(rows):
    a, b = of(rows, 1, kind="call")[0], of(rows, 1, kind="call")[1]
    if json.loads(a["json"])["id"] != "a":
        a, b = b, a
    assert (a["link"], a["valid"], b["link"], b["valid"]) == ("linked", True, "linked", False)
    assert sorted(b["problems"]) == ["$.city: minLength", "$.x: additionalProperties"]
    assert [r["link"] for r in of(rows, 1, turn=5)] == ["orphan"]
    assert {(json.loads(r["json"])["id"], r["turn"]): (r["link"], r["valid"]) for r in of(rows, 2, kind="call")} == {("a", 0): ("open", True), ("c", 0): ("linked", False), ("d", 0): ("linked", False), ("a", 3): ("open", True)}


def test_topological_order(rows):
    mine = sorted(of(rows, 1), key=lambda r: (r["position"], r["depth"], r["turn"], r["item"]))
    where = {}
    for k, r in enumerate(mine):
        value = json.loads(r["json"])
        where[(r["kind"], value.get("id") or value.get("tool_call_id") or r["turn"])] = k
    assert where["call", "a"] < where["result", "a"] < where["call", "b"] < where["result", "b"]
    assert where["message", 1] < where["call", "a"]
    assert not any(r["cyclic"] for r in mine)
    cyclic = {json.loads(r["json"]).get("id") or json.loads(r["json"]).get("tool_call_id") for r in of(rows, 2) if r["cyclic"]}
    assert cyclic == {"c", "d"}


def test_canonical_json(rows):
    for r in rows:
        assert r["json"] == json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert of(rows, 1, turn=2)[0]["json"] == '{"content":"{\\"a\\":\\"é\\",\\"z\\":1}","role":"tool","tool_call_id":"b"}'
    assert of(rows, 1, turn=3, kind="message")[0]["json"] == '{"content":"one moment","role":"assistant"}'
    assert of(rows, 3, turn=0)[0]["json"] == '{"content":"{\\"not json","role":"user"}'
    assert [r["json"] for r in of(rows, 3, turn=1)] == ['{"content":"","role":null}'] * 2
    assert C.canonical({"b": [1.0, float("nan"), 1e300], "a": None}) == '{"a":null,"b":[1,null,1e+300]}'
    assert len(of(rows, None)) == 2


def test_schema_rules():
    assert C.problems({"a": [1, "x"], "c": 5}, {"type": "object", "required": ["b"], "properties": {"a": {"type": "array", "items": {"type": "integer"}}, "c": {"maximum": 4, "enum": [1, 5]}}}) == ["$.b: required", "$.a[1]: type", "$.c: maximum"]
    assert C.problems(True, {"type": "integer"}) == ["$: type"]
    assert C.problems(3.0, {"type": ["null", "integer"]}) == []


def test_sample_and_empty(spark):
    messages = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = C.format_chat(messages.withColumn("item", F.lit("clash")).withColumn("kind", F.lit(1)))
    assert got.count() == messages.count()
    want = {(r.conv_id, r.turn, json.dumps({"content": r.text, "role": r.role}, separators=(",", ":"), ensure_ascii=False)) for r in messages.collect()}
    assert {(r.conv_id, r.turn, r.json) for r in got.collect()} == want
    assert C.format_chat(messages.limit(0)).count() == 0


def test_no_keyword_is_passed_over():
    for schema, good, bad in (({"const": 1}, 1, True), ({"allOf": [{"minimum": 2}]}, 2, 1), ({"exclusiveMinimum": 2}, 3, 2), ({"exclusiveMaximum": 2}, 1, 2), ({"multipleOf": 0.1}, 0.3, 0.25), ({"minItems": 1}, [1], []), ({"maxItems": 1}, [1], [1, 2]), ({"uniqueItems": True}, [1, True], [1, 1.0])):
        assert C.problems(good, schema) == [] and len(C.problems(bad, schema)) == 1
        assert not C.undecided(schema)
    for key in ("pattern", "anyOf", "oneOf", "not", "$ref"):
        assert C.undecided({"properties": {"a": {"items": {key: 1}}}})


def transcripts(seed):
    """Random conversations with cycles, orphans, repeats, nulls, odd strings, deep nesting and broken JSON."""
    rng = random.Random(seed)
    names, rows = ["f", "g", "unknown"], []
    odd = ["\\ud800", "é\\u001f", "a\\\"b", "", "\\u0000", "x" * 50]
    deep = "[" * 3000 + "]" * 3000
    for conv in [None, *range(25)]:
        ids = [f"c{k}" for k in range(rng.randint(1, 6))] + ["\\ud83d"]
        for turn in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.35:
                calls = ",".join(
                    '{"id":"%s","name":"%s","arguments":%s,"depends_on":[%s]}'
                    % (rng.choice(ids), rng.choice(names), rng.choice(['{"n": 3}', '{"n": "x"}', '"{\\"n\\": 1}"', "null", "1" * 400, '{"n": %s}' % ("9" * 400), "1e999"]), ",".join(f'"{i}"' for i in rng.sample(ids, rng.randint(0, 2))))
                    for _ in range(rng.randint(0, 3))
                )
                text = '{"tool_calls":[%s],"content":"%s"}' % (calls, rng.choice(odd))
            elif kind < 0.7:
                text = '{"tool_call_id":"%s","content":"%s"}' % (rng.choice([*ids, "lost"]), rng.choice(odd))
            else:
                text = rng.choice([None, "", "{", "plain", '{"tool_call_id": NaN}', '{"tool_calls": [{"id": 1}]}', '{"tool_call_id": "c0", "content": %s}' % deep, '{"a": %s}' % deep])
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "tool", None, "rôle\u0007"]), text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def brute(rows, tools):
    """Links, order and validity by plain loops."""
    every = [{"conv": c, "turn": t, "row": k, **i} for k, (c, t, r, x) in enumerate(rows) for i in C.items(x, r)]
    calls = [i for i in every if i["kind"] == "call"]
    results = [i for i in every if i["kind"] == "result"]
    needs = {}
    least = lambda i: (i["turn"] is not None, i["turn"] or 0, i["row"], i["item"])
    for r in results:
        mine = [c for c in calls if (c["conv"], c["id"]) == (r["conv"], r["id"])]
        r["link"] = "linked" if mine else "orphan"
        needs[id(r)] = [min(mine, key=least)] if mine else []
    for c in calls:
        c["link"] = "linked" if any((c["conv"], c["id"]) == (r["conv"], r["id"]) for r in results) else "open"
        needs[id(c)] = [r for r in results if r["conv"] == c["conv"] and r["id"] in c["needs"]]
        schema = tools.get(json.loads(c["name"]))
        found = None if schema is None else C.problems(json.loads(c["arguments"]), schema) or (None if C.undecided(schema) else [])
        c["valid"] = None if found is None else not found
    place = {}
    while True:
        free = [i for i in calls + results if id(i) not in place and all(id(n) in place for n in needs[id(i)])]
        if not free:
            break
        now = {}
        for i in free:
            before = [place[id(n)] for n in needs[id(i)]]
            some = [p for p in (i["turn"], *(b[0] for b in before)) if p is not None]
            now[id(i)] = (max(some) if some else None, max((b[1] + 1 for b in before), default=0))
        place |= now
    out = []
    for i in every:
        if i["kind"] != "schema":
            linked = i["kind"] != "message"
            position, depth = place.get(id(i), (i["turn"], 0)) if linked else (i["turn"], 0)
            out.append((i["conv"], i["turn"], i["item"], i["kind"], position, depth, linked and id(i) not in place, i.get("link"), i.get("valid"), i["json"]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = transcripts(seed)
    tools = {"f": {"type": "object", "properties": {"n": {"type": "integer"}}}, "g": {"type": {"bad": 1}, "enum": 5, "required": [["x"]], "properties": {"n": {"maximum": 4}}}}
    got = C.format_chat(spark.createDataFrame(rows, MESSAGES).repartition(3), tools).drop("problems").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, tools)
    assert any(r.cyclic for r in got) and {r.link for r in got} == {None, "linked", "orphan", "open"}
    for r in got:
        json.loads(r.json)


def test_schemas_of_any_form():
    for schema in ({"enum": 5}, {"type": {"a": 1}}, {"type": ["x"]}, {"required": [["a"]]}, {"properties": 3}, {"items": 3}, {"allOf": {}}, {"multipleOf": 0}, {"minimum": "1"}, {"uniqueItems": 1}, 5, "x", [1]):
        assert C.problems({"a": [1, 2]}, schema) == [] and C.undecided(schema)
    assert C.problems({"a": 1}, {"properties": {"a": False}}) == ["$.a: false"] and not C.undecided({"properties": {"a": False, "b": True}})
    assert C.problems(10**400, {"type": "integer", "minimum": 1.5, "multipleOf": 10}) == []
    assert C.problems(float("inf"), {"type": "number"}) == ["$: type"] and C.problems(float("inf"), {"multipleOf": 2}) == []
    assert C.problems(True, {"enum": [1]}) == ["$: enum"] and C.problems(1.0, {"enum": [1]}) == []
    assert C.canonical({"\ud800": "\x1f"}) == '{"\\ud800":"\\u001f"}'


def test_long_chain(spark):
    """A call waits for the result of the one before: order follows the chain though the turns run backwards."""
    rows = []
    for k in range(12):
        rows.append((1, 100 - 2 * k, "assistant", call((f"c{k}", "f", {}, [f"c{k - 1}"] if k else None))))
        rows.append((1, 99 - 2 * k, "tool", result(f"c{k}", str(k))))
    got = [r for r in C.format_chat(spark.createDataFrame(rows, MESSAGES)).collect() if r.kind != "message"]
    order = [(json.loads(r.json).get("id") or json.loads(r.json)["tool_call_id"], r.kind) for r in sorted(got, key=lambda r: (r.position, r.depth, r.turn, r.item))]
    assert order == [(f"c{k}", kind) for k in range(12) for kind in ("call", "result")]
