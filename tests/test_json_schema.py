"""Each keyword of a schema document broken once, and kept once."""

import json

import pytest
from pyspark.sql import functions as F

from rollcall.functions.json_schema import failures, valid

CASES = [  # (schema, document or text, failures)
    ({"type": "string"}, "a", []), ({"type": "string"}, 1, [("", "type")]), ({"type": ["string", "null"]}, None, []), ({"type": "null"}, 0, [("", "type")]),
    ({"type": "integer"}, 3, []), ({"type": "integer"}, 3.0, []), ({"type": "integer"}, 3.5, [("", "type")]), ({"type": "number"}, 1e300, []), ({"type": "number"}, True, [("", "type")]),
    ({"type": "boolean"}, False, []), ({"type": "array"}, {}, [("", "type")]), ({"type": "object"}, [], [("", "type")]),
    ({"enum": ["a", 1, None, {"y": 1, "x": [2]}]}, {"x": [2], "y": 1}, []), ({"enum": ["a", 1]}, 1.0, []), ({"enum": ["a", 1]}, "1", [("", "enum")]), ({"enum": ["é"]}, "é", []), ({"const": True}, False, [("", "const")]),
    ({"pattern": "^b"}, "abc", [("", "pattern")]), ({"pattern": "b"}, "abc", []), ({"pattern": "b"}, 7, []),
    ({"minLength": 2}, "é", [("", "minLength")]), ({"maxLength": 2}, "abc", [("", "maxLength")]),
    ({"minimum": 2}, 1, [("", "minimum")]), ({"maximum": 2}, 2.5, [("", "maximum")]), ({"minimum": 2, "maximum": 2}, 2, []), ({"exclusiveMinimum": 2}, 2, [("", "exclusiveMinimum")]), ({"exclusiveMaximum": 2}, 2, [("", "exclusiveMaximum")]), ({"multipleOf": 3}, 7, [("", "multipleOf")]), ({"multipleOf": 0.5}, 2.5, []),
    ({"items": {"type": "string"}}, ["a", 1, "b", None], [("/1", "type"), ("/3", "type")]), ({"minItems": 1}, [], [("", "minItems")]), ({"maxItems": 1}, [1, 2], [("", "maxItems")]), ({"uniqueItems": True}, [1, 2, 1], [("", "uniqueItems")]), ({"uniqueItems": True}, [1, "1"], []), ({"uniqueItems": False}, [1, 1], []),
    ({"required": ["a", "b/c"]}, {"a": None}, [("/b~1c", "required")]), ({"required": []}, {}, []), ({"required": ["a"]}, [], []),
    ({"minProperties": 1}, {}, [("", "minProperties")]), ({"maxProperties": 1}, {"a": 1, "b": 2}, [("", "maxProperties")]), ({"propertyNames": {"pattern": "^[a-z\"]+$"}}, {"A": 1, "b\"": 2}, [("/A", "pattern")]),
    ({"properties": {"a": {"type": "string"}, "b": {"properties": {"c": {"minimum": 3}}}}}, {"a": 1, "b": {"c": 2}, "z": 0}, [("/a", "type"), ("/b/c", "minimum")]),
    ({"patternProperties": {"^P_": {"type": "object", "required": ["n"]}, "x$": {"maxProperties": 0}}, "additionalProperties": False}, {"P_1": {}, "P_x": {"n": 1}, "q": 1}, [("/P_1/n", "required"), ("/P_x", "maxProperties"), ("/q", "additionalProperties")]),
    ({"properties": {"a": True, "b": False}, "additionalProperties": {"type": "integer"}}, {"a": 1, "b": 1, "c": "x"}, [("/b", "false"), ("/c", "type")]), ({"additionalProperties": False}, {"a": 1}, [("/a", "additionalProperties")]),
    ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, 5, [("", "maximum")]), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 2, [("", "anyOf")]), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 4, []),
    ({"oneOf": [{"minimum": 1}, {"minimum": 3}]}, 4, [("", "oneOf")]), ({"oneOf": [{"minimum": 1}, {"minimum": 3}]}, 2, []), ({"not": {"type": "string"}}, "a", [("", "not")]),
    ({"definitions": {"y": {"type": "integer", "minimum": 1700}}, "properties": {"born": {"$ref": "#/definitions/y"}}, "title": "t"}, {"born": 1200}, [("/born", "minimum")]),
    (True, 1, []), (False, 1, [("", "false")]), ({}, {"a": 1}, []),
]


@pytest.mark.parametrize("at", range(0, len(CASES), 14))
def test_keywords(spark, at):
    one = spark.createDataFrame([(1,)], "id int")
    few = CASES[at:at + 14]
    got = one.select(*[failures(s, F.lit(json.dumps(v))).alias(f"c{i}") for i, (s, v, _) in enumerate(few)]).first()
    for i, (s, v, want) in enumerate(few):
        assert sorted((x.path, x.rule) for x in got[i]) == sorted(want), (s, v)


def test_texts_that_are_no_documents(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, '{"a":1,"a":2}'), (5, '{"a": 1}'), (6, "[1]")], "id int, doc string")
    rules = {"type": "object", "properties": {"a": {"type": "integer"}}}
    got = {r.id: [(x.path, x.rule) for x in r.f] for r in df.select("id", failures(rules, "doc").alias("f")).collect()}
    assert got == {1: [], 2: [("", "json")], 3: [("", "json")], 4: [("", "json")], 5: [], 6: [("", "type")]}
    assert [r.id for r in df.where(valid(rules, "doc")).collect()] == [1, 5]
    assert df.limit(0).select(failures(rules, "doc").alias("f")).count() == 0


@pytest.mark.parametrize("schema", [{"if": {}}, {"$ref": "#"}, {"items": [{}]}, {"type": "text"}, {"$ref": "other.json"}])
def test_no_rule_is_lost(schema):
    with pytest.raises(ValueError):
        failures(schema, "x")
