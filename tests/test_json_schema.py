"""The JSON Schema compiler: one broken rule per document, and keywords that it can't honour."""

import json

import pytest

from lakeloom.functions.json_schema import SchemaError, schema_errors

SCHEMA = {
    "type": "object", "required": ["id"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^[a-z]+\\d$", "minLength": 2, "maxLength": 4}, "n": {"type": "integer", "minimum": 0, "maximum": 9},
        "k": {"enum": ["a", "it's", 1]}, "o": {"$ref": "#/definitions/o"}, "tags": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "string"}},
        "m": {"type": "object", "additionalProperties": {"$ref": "#/definitions/o"}}, "either": {"anyOf": [{"type": "string"}, {"type": "null"}]},
        "one": {"oneOf": [{"type": "number"}, {"type": "integer"}]}, "all": {"allOf": [{"minimum": 1}, {"maximum": 2}]}, "c": {"const": True}},
    "definitions": {"o": {"type": "object", "required": ["x"], "properties": {"x": {"type": ["boolean", "null"]}}}}}
CASES = [
    ({"id": "ab1"}, []), ({}, ["$: missing id"]), ({"id": 3}, ["$.id: must be of type string"]), ({"id": None}, ["$.id: must be of type string"]),
    ({"id": "A"}, ["$.id: does not match ^[a-z]+\\d$", "$.id: shorter than 2 characters"]), ({"id": "abcd1"}, ["$.id: longer than 4 characters"]),
    ({"n": -1}, ["$.n: less than 0"]), ({"n": 10}, ["$.n: more than 9"]), ({"n": 1.5}, ["$.n: must be of type integer"]), ({"n": 2.0}, []),
    ({"k": "it's"}, []), ({"k": 1}, []), ({"k": "1"}, ["$.k: not one of the allowed values"]), ({"o": {"x": True}}, []), ({"o": {"x": None}}, []),
    ({"o": {}}, ["$.o: missing x"]), ({"o": {"x": 1}}, ["$.o.x: must be of type boolean or null"]), ({"o": [1]}, ["$.o: must be of type object"]),
    ({"tags": []}, ["$.tags: fewer than 1 elements"]), ({"tags": list("abcd")}, ["$.tags: more than 3 elements"]),
    ({"tags": ["q", 2, None]}, ["$.tags[1]: must be of type string", "$.tags[2]: must be of type string"]),
    ({"m": {"q": {}, "p": {"x": 1}, "r": {"x": False}}}, ["$.m.p.x: must be of type boolean or null", "$.m.q: missing x"]), ({"m": {}}, []),
    ({"either": None}, []), ({"either": 2}, ["$.either: fits none of the alternatives"]), ({"one": 1.5}, []), ({"one": 1}, ["$.one: fits not exactly one alternative"]),
    ({"all": 3}, ["$.all: more than 2"]), ({"c": False}, ["$.c: not one of the allowed values"]), ({"zz": 1, "yy": 2}, ["$: unknown key yy", "$: unknown key zz"])]
#: Texts with something after a first value, or a key twice.
BROKEN = ['{"id":"a1"}]', '{"id":"a1"}}', '{"id":"a1"} x', '{"id":"a1"},{}', '{"id":"a1"},0]', '{"id":"a1","id":"a1"}']


def test_each_rule(spark):
    docs = [json.dumps({"id": "a1", **d} if d and "id" not in d else d) for d, _ in CASES] + ["[1]", "{", "", None, *BROKEN]
    want = [e for _, e in CASES] + [["$: must be of type object"], ["$: not JSON"], ["$: not JSON"], ["$: not JSON"], *[["$: not JSON"]] * len(BROKEN)]
    rows = spark.createDataFrame(list(enumerate(docs)), "i long, raw string").select("i", schema_errors("raw", SCHEMA).alias("e")).orderBy("i").collect()
    assert [(docs[r.i], r.e) for r in rows] == list(zip(docs, want, strict=True))


def test_one_parse_per_text(spark):
    plan = spark.createDataFrame([("{}",)], "raw string").select(schema_errors("raw", SCHEMA).alias("e"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") <= 1


@pytest.mark.parametrize("schema", [{"if": {}}, {"$ref": "#/definitions/none"}, {"$ref": "other.json"}, {"type": "text"},
                                    {"$ref": "#/definitions/a", "definitions": {"a": {"properties": {"b": {"$ref": "#/definitions/a"}}}}},
                                    {"properties": {"it's": {"type": "string"}}}])
def test_schemas_that_cannot_be_honoured(schema):
    with pytest.raises(SchemaError):
        schema_errors("raw", schema)
