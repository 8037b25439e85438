"""JSON Schema documents compiled to one Column expression over one parse of the text (VAL-3).

A schema is turned into a SQL expression before planning; at run time the text
is parsed once into a variant, and every rule reads that.  Supported are ``$ref``
to the schema's own definitions, ``type``, ``properties``, ``required``,
``additionalProperties``, ``items``, ``minItems``, ``maxItems``, ``enum``,
``const``, ``pattern``, ``minLength``, ``maxLength``, ``minimum``, ``maximum``,
``allOf``, ``anyOf`` and ``oneOf``.  Another keyword that would restrict a
document raises ``SchemaError``, so that no rule is left out silently; so does a
``$ref`` that leads back to itself, since the expression would have no end.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "cast(array() as array<string>)"
ANNOTATIONS = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
RULES = {"$ref", "type", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "enum", "const", "pattern",
         "minLength", "maxLength", "minimum", "maximum", "allOf", "anyOf", "oneOf"}


class SchemaError(ValueError):
    pass


def text(value: str) -> str:
    """A SQL string literal, whatever the session's rules for escapes are."""
    return "decode(X'" + value.encode("utf-8").hex().upper() + "', 'UTF-8')" if any(c in value for c in "\\'\n\r") else f"'{value}'"


def member(v: str, name: str) -> str:
    if any(c in name for c in "'\\\"]"):
        raise SchemaError(f"property names with quotes, brackets or backslashes are not supported: {name}")
    return f"try_variant_get({v}, \"$['{name}']\", 'variant')"


class Compiler:
    def __init__(self, root: Mapping):
        self.root, self.numbers = root, count()

    def resolved(self, ref: str) -> Mapping | bool:
        if not ref.startswith("#"):
            raise SchemaError(f"only references within the document are supported: {ref}")
        found = self.root
        for step in ref[1:].split("/")[1:]:
            step = step.replace("~1", "/").replace("~0", "~")
            if not isinstance(found, Mapping) or step not in found:
                raise SchemaError(f"reference without a target: {ref}")
            found = found[step]
        return found

    def name(self) -> str:
        return f"x{next(self.numbers)}"

    def messages(self, schema: Mapping | bool, v: str, where: str, open_refs: tuple[str, ...] = ()) -> str:
        """SQL of the violations (array<string>) of the value ``v``, a name, found at the path ``where``."""
        if isinstance(schema, bool):
            return NONE if schema else f"array(concat({where}, ': not allowed'))"
        if unknown := sorted(set(schema) - ANNOTATIONS - RULES):
            raise SchemaError(f"unsupported keywords: {', '.join(unknown)}")
        lists, own = [], []

        def rule(broken: str, message: str) -> None:
            own.append(f"CASE WHEN {broken} THEN concat({where}, {text(': ' + message)}) END")

        if (ref := schema.get("$ref")) is not None:
            if ref in open_refs:
                raise SchemaError(f"recursive reference: {ref}")
            lists.append(self.messages(self.resolved(ref), v, where, (*open_refs, ref)))
        if "enum" in schema or "const" in schema:
            values = schema["enum"] if "enum" in schema else [schema["const"]]
            allowed = ", ".join(text(json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True)) for x in values)
            rule(f"to_json({v}) NOT IN ({allowed})", "not one of the allowed values")
        string = f"try_variant_get({v}, '$', 'string')"
        is_string = f"schema_of_variant({v}) = 'STRING'"
        if "pattern" in schema:
            rule(f"{is_string} AND NOT rlike({string}, {text(schema['pattern'])})", f"does not match {schema['pattern']}")
        if "minLength" in schema:
            rule(f"{is_string} AND char_length({string}) < {int(schema['minLength'])}", f"shorter than {int(schema['minLength'])} characters")
        if "maxLength" in schema:
            rule(f"{is_string} AND char_length({string}) > {int(schema['maxLength'])}", f"longer than {int(schema['maxLength'])} characters")
        for word, sign, says in (("minimum", "<", "less than"), ("maximum", ">", "more than")):
            if word in schema:
                rule(f"{self.is_kind(v, 'number')} AND try_variant_get({v}, '$', 'double') {sign} {float(schema[word])!r}D", f"{says} {schema[word]}")
        lists += self.object_rules(schema, v, where, open_refs, rule) + self.array_rules(schema, v, where, open_refs, rule)
        lists += [self.messages(s, v, where, open_refs) for s in schema.get("allOf", ())]
        for word in ("anyOf", "oneOf"):
            if word in schema:
                fits = " + ".join(f"CAST(size({self.messages(s, v, where, open_refs)}) = 0 AS INT)" for s in schema[word])
                rule(f"({fits}) {'= 0' if word == 'anyOf' else '<> 1'}", "fits none of the alternatives" if word == "anyOf" else "fits not exactly one alternative")
        found = f"filter(array({', '.join(own)}), m -> m IS NOT NULL)" if own else None
        parts = [p for p in (found, *lists) if p and p != NONE]
        whole = NONE if not parts else parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
        if "type" not in schema:
            return whole
        kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        fit = " OR ".join(self.is_kind(v, k) for k in kinds)
        return f"CASE WHEN {fit} THEN {whole} ELSE array(concat({where}, {text(': must be of type ' + ' or '.join(kinds))})) END"

    def is_kind(self, v: str, kind: str) -> str:
        found, number = f"schema_of_variant({v})", f"try_variant_get({v}, '$', 'double')"
        numeric = f"(schema_of_variant({v}) IN ('BIGINT', 'DOUBLE', 'FLOAT') OR schema_of_variant({v}) LIKE 'DECIMAL%')"
        try:
            return {"string": f"{found} = 'STRING'", "boolean": f"{found} = 'BOOLEAN'", "null": f"{found} = 'VOID'", "object": f"{found} LIKE 'OBJECT<%'",
                    "array": f"{found} LIKE 'ARRAY<%'", "number": numeric, "integer": f"({numeric} AND {number} = floor({number}))"}[kind]
        except KeyError:
            raise SchemaError(f"unknown type: {kind}") from None

    def object_rules(self, schema: Mapping, v: str, where: str, open_refs: tuple[str, ...], rule) -> list[str]:
        known, rest, lists = schema.get("properties", {}), schema.get("additionalProperties", True), []
        is_object = self.is_kind(v, "object")
        for name in schema.get("required", ()):
            rule(f"{is_object} AND {member(v, name)} IS NULL", f"missing {name}")
        if rest is not True:
            fields, k = f"try_variant_get({v}, '$', 'map<string,variant>')", self.name()
            own = f"array({', '.join(map(text, known))})" if known else NONE
            keys = f"array_sort(array_except(coalesce(map_keys({fields}), {NONE}), {own}))"
            if rest is False:
                lists.append(f"transform({keys}, {k} -> concat({where}, ': unknown key ', {k}))")
            else:
                m, x = self.name(), self.name()
                inner = self.messages(rest, x, f"concat({where}, '.', {k})", open_refs)
                each = f"transform({keys.replace(fields, m)}, {k} -> transform(array({m}[{k}]), {x} -> {inner})[0])"
                lists.append(f"coalesce(transform(array({fields}), {m} -> flatten({each}))[0], {NONE})")
        for name, sub in known.items():
            x = self.name()
            inner = self.messages(sub, x, f"concat({where}, {text('.' + name)})", open_refs)
            if inner != NONE:
                lists.append(f"coalesce(transform(array({member(v, name)}), {x} -> CASE WHEN {x} IS NOT NULL THEN {inner} END)[0], {NONE})")
        return lists

    def array_rules(self, schema: Mapping, v: str, where: str, open_refs: tuple[str, ...], rule) -> list[str]:
        elements = f"try_variant_get({v}, '$', 'array<variant>')"
        if "minItems" in schema:
            rule(f"{self.is_kind(v, 'array')} AND size({elements}) < {int(schema['minItems'])}", f"fewer than {int(schema['minItems'])} elements")
        if "maxItems" in schema:
            rule(f"{self.is_kind(v, 'array')} AND size({elements}) > {int(schema['maxItems'])}", f"more than {int(schema['maxItems'])} elements")
        if "items" not in schema:
            return []
        x, i = self.name(), self.name()
        inner = self.messages(schema["items"], x, f"concat({where}, '[', cast({i} as string), ']')", open_refs)
        return [] if inner == NONE else [f"coalesce(flatten(transform({elements}, ({x}, {i}) -> {inner})), {NONE})"]


def schema_errors(raw: Column | str, schema: Mapping) -> Column:
    """Violations of a JSON Schema document, ``path: message`` each, in the order of the schema.

    A null, malformed or ambiguous text (a repeated key, something after the
    value) gives ``$: not JSON`` alone; a valid document gives an empty array.  A value of a wrong type is not
    looked into further.
    """
    compiler = Compiler(schema)
    v = compiler.name()
    checks = compiler.messages(schema, v, "'$'")
    whole = F.expr(f"{v} -> CASE WHEN {v} IS NULL THEN array('$: not JSON') ELSE {checks} END")
    return F.call_function("transform", parsed(F.col(raw) if isinstance(raw, str) else raw), whole)[0]


def parsed(raw: Column) -> Column:
    """One-element array of the whole text as a variant, null if it isn't one JSON value.

    Spark's parser stops after the first value.  The text is therefore parsed as
    the first of two elements, the second being the text's hash: whatever follows
    a first value within the text puts something else in that place.
    """
    mark = F.xxhash64(raw).cast("string")
    pair = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"'), mark, F.lit('"]')))
    return F.transform(F.array(pair), lambda p: F.when(F.try_variant_get(p, "$[1]", "string") == mark, F.try_variant_get(p, "$[0]", "variant")))
