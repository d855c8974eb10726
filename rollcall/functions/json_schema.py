"""JSON Schema as one Column: a schema document compiled to the list of its failures.

The document is parsed once, to a variant; every keyword becomes an expression over it, so a
table is validated in one scan, in the JVM, and failures come back as (path, rule).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FAILURES = "array<struct<path: string, rule: string>>"
#: Keywords that say nothing about validity.
NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format", "definitions", "$defs", "readOnly", "writeOnly", "deprecated"}

Value = Column  # of type variant


def failures(schema: dict | bool, text: Column | str) -> Column:
    """(path, rule) of everything in a JSON text that the schema forbids; empty if it is valid.

    ``path`` is a JSON pointer, ``rule`` the keyword. A null text has nothing to fail; one that
    is no JSON, or names a key twice in an object, fails ``json`` at the root. Known keywords:
    those of draft 7 but ``dependencies``, ``contains``, ``if`` and tuple ``items``; an unknown
    one, and a reference that leads back to itself, is an error, so that no rule is lost.
    """
    text = F.col(text) if isinstance(text, str) else text
    parsed = F.try_parse_json(text)
    found = _Compiler(schema).check(schema, parsed, F.lit(""), ())
    return F.when(text.isNull(), _none()).when(parsed.isNull(), _fail(F.lit(""), "json")).otherwise(found)


def valid(schema: dict | bool, text: Column | str) -> Column:
    return F.size(failures(schema, text)) == 0


def _none() -> Column:
    return F.expr(f"cast(array() as {FAILURES})")


def _fail(path: Column, rule: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))


def _step(path: Column, key: Column) -> Column:
    """The pointer one key further, with its two escapes."""
    return F.concat(path, F.lit("/"), F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def _kind(v: Value) -> Column:
    return F.schema_of_variant(v)


def _is(v: Value, name: str) -> Column:
    kind, number = _kind(v), F.try_variant_get(v, "$", "double")
    one_of = {"object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID",
              "number": kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT"), "integer": (kind == "BIGINT") | ((kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (number == F.floor(number)))}
    if name not in one_of:
        raise ValueError(f"unknown type {name!r}")
    return one_of[name]


def _equals(v: Value, wanted: object) -> Column:
    """Numbers by value, all else by canonical text: a variant holds keys sorted."""
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return F.coalesce(_is(v, "number") & (F.try_variant_get(v, "$", "double") == float(wanted)), F.lit(False))
    if wanted is None:
        return _is(v, "null")
    return F.to_json(v) == json.dumps(wanted, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _entries(v: Value) -> Column:
    return F.map_entries(v.try_cast("map<string, variant>"))


class _Compiler:
    def __init__(self, root: dict | bool) -> None:
        self.root = root

    def check(self, schema: dict | bool, v: Value, path: Column, through: tuple[str, ...]) -> Column:
        """Failures of a value that is there."""
        if schema is True or schema == {}:
            return _none()
        if schema is False:
            return _fail(path, "false")
        if "$ref" in schema:  # in draft 7 it stands alone
            return self.follow(schema["$ref"], v, path, through)
        parts = []
        for word, rule in schema.items():
            if word in NOTES:
                continue
            build = getattr(self, "do_" + word, None)
            if build is None:
                raise ValueError(f"unknown keyword {word!r}")
            made = build(rule, v, path, through, schema)
            if made is not None:
                parts.append(made)
        return reduce(F.concat, parts) if parts else _none()

    def follow(self, ref: str, v: Value, path: Column, through: tuple[str, ...]) -> Column:
        if ref in through or not ref.startswith("#"):
            raise ValueError(f"reference {ref!r} leads back to itself or out of the document")
        target = self.root
        for key in ref[1:].split("/")[1:]:
            target = target[key.replace("~1", "/").replace("~0", "~")]
        return self.check(target, v, path, (*through, ref))

    @staticmethod
    def when(applies: Column, holds: Column, path: Column, rule: str) -> Column:
        return F.when(applies & ~F.coalesce(holds, F.lit(False)), _fail(path, rule)).otherwise(_none())

    # any value

    def do_type(self, rule, v, path, *_):
        names = [rule] if isinstance(rule, str) else rule
        return self.when(F.lit(True), reduce(lambda a, b: a | b, [_is(v, n) for n in names]), path, "type")

    def do_enum(self, rule, v, path, *_):
        return self.when(F.lit(True), reduce(lambda a, b: a | b, [_equals(v, x) for x in rule], F.lit(False)), path, "enum")

    def do_const(self, rule, v, path, *_):
        return self.when(F.lit(True), _equals(v, rule), path, "const")

    def do_allOf(self, rule, v, path, through, _):
        return reduce(F.concat, [self.check(s, v, path, through) for s in rule])

    def _held(self, rule, v, path, through) -> Column:
        """How many of the schemas the value meets."""
        return reduce(lambda a, b: a + b, [F.when(F.size(self.check(s, v, path, through)) == 0, 1).otherwise(0) for s in rule])

    def do_anyOf(self, rule, v, path, through, _):
        return self.when(F.lit(True), self._held(rule, v, path, through) > 0, path, "anyOf")

    def do_oneOf(self, rule, v, path, through, _):
        return self.when(F.lit(True), self._held(rule, v, path, through) == 1, path, "oneOf")

    def do_not(self, rule, v, path, through, _):
        return self.when(F.lit(True), self._held([rule], v, path, through) == 0, path, "not")

    # strings

    def _text(self, v, path, rule: str, holds: Callable[[Column], Column]) -> Column:
        return self.when(_is(v, "string"), holds(F.try_variant_get(v, "$", "string")), path, rule)

    def do_pattern(self, rule, v, path, *_):
        return self._text(v, path, "pattern", lambda s: s.rlike(rule))

    def do_minLength(self, rule, v, path, *_):
        return self._text(v, path, "minLength", lambda s: F.char_length(s) >= rule)

    def do_maxLength(self, rule, v, path, *_):
        return self._text(v, path, "maxLength", lambda s: F.char_length(s) <= rule)

    # numbers

    def _number(self, v, path, rule: str, holds: Callable[[Column], Column]) -> Column:
        return self.when(_is(v, "number"), holds(F.try_variant_get(v, "$", "double")), path, rule)

    def do_minimum(self, rule, v, path, *_):
        return self._number(v, path, "minimum", lambda n: n >= float(rule))

    def do_maximum(self, rule, v, path, *_):
        return self._number(v, path, "maximum", lambda n: n <= float(rule))

    def do_exclusiveMinimum(self, rule, v, path, *_):
        return self._number(v, path, "exclusiveMinimum", lambda n: n > float(rule))

    def do_exclusiveMaximum(self, rule, v, path, *_):
        return self._number(v, path, "exclusiveMaximum", lambda n: n < float(rule))

    def do_multipleOf(self, rule, v, path, *_):
        return self._number(v, path, "multipleOf", lambda n: n / float(rule) == F.round(n / float(rule)))

    # arrays

    def _list(self, v, path, rule: str, holds: Callable[[Column], Column]) -> Column:
        return self.when(_is(v, "array"), holds(v.try_cast("array<variant>")), path, rule)

    def do_items(self, rule, v, path, through, _):
        if isinstance(rule, list):
            raise ValueError("items as a list of schemas is not known")
        each = F.transform(v.try_cast("array<variant>"), lambda x, i: self.check(rule, x, F.concat(path, F.lit("/"), i.cast("string")), through))
        return F.when(_is(v, "array"), F.flatten(each)).otherwise(_none())

    def do_minItems(self, rule, v, path, *_):
        return self._list(v, path, "minItems", lambda a: F.size(a) >= rule)

    def do_maxItems(self, rule, v, path, *_):
        return self._list(v, path, "maxItems", lambda a: F.size(a) <= rule)

    def do_uniqueItems(self, rule, v, path, *_):
        if rule:
            return self._list(v, path, "uniqueItems", lambda a: F.size(F.array_distinct(F.transform(a, lambda x: F.to_json(x)))) == F.size(a))

    # objects

    def do_required(self, rule, v, path, *_):
        lacking = F.array_except(F.array(*map(F.lit, rule)), F.map_keys(v.try_cast("map<string, variant>")))
        each = F.transform(lacking, lambda k: F.struct(_step(path, k).alias("path"), F.lit("required").alias("rule")))
        return F.when(_is(v, "object"), each).otherwise(_none()) if rule else None

    def do_minProperties(self, rule, v, path, *_):
        return self.when(_is(v, "object"), F.size(_entries(v)) >= rule, path, "minProperties")

    def do_maxProperties(self, rule, v, path, *_):
        return self.when(_is(v, "object"), F.size(_entries(v)) <= rule, path, "maxProperties")

    def do_propertyNames(self, rule, v, path, through, _):
        each = F.transform(_entries(v), lambda e: self.check(rule, F.parse_json(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2)), _step(path, e["key"]), through))
        return F.when(_is(v, "object"), F.flatten(each)).otherwise(_none())

    def do_properties(self, rule, v, path, through, schema):
        return self._members(v, path, through, schema)

    def do_patternProperties(self, rule, v, path, through, schema):
        return None if "properties" in schema else self._members(v, path, through, schema)

    def do_additionalProperties(self, rule, v, path, through, schema):
        return None if {"properties", "patternProperties"} & schema.keys() else self._members(v, path, through, schema)

    def _members(self, v, path, through, schema):
        """All three keywords in one pass over the members of an object."""
        named, like, rest = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)

        def member(e: Column) -> Column:
            key, at = e["key"], _step(path, e["key"])
            parts = [F.when(key == k, self.check(s, e["value"], at, through)).otherwise(_none()) for k, s in named.items()]
            parts += [F.when(key.rlike(p), self.check(s, e["value"], at, through)).otherwise(_none()) for p, s in like.items()]
            if rest is not True:
                known = reduce(lambda a, b: a | b, [key.rlike(p) for p in like], key.isin(*named) if named else F.lit(False))
                other = _fail(at, "additionalProperties") if rest is False else self.check(rest, e["value"], at, through)
                parts.append(F.when(known, _none()).otherwise(other))
            return reduce(F.concat, parts) if parts else _none()

        return F.when(_is(v, "object"), F.flatten(F.transform(_entries(v), member))).otherwise(_none())
