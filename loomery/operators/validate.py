"""Schema rules compiled to column checks."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, doc: str, rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """(doc, path, rule) for each check that fails. ``rules``: by name, the path and the condition that must hold; a null
    condition fails. One projection, whatever the number of rules."""
    failed = F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.struct(F.lit(path).alias("path"), F.lit(name).alias("rule"))) for name, (path, ok) in rules.items()]), lambda x: x.isNotNull())
    return df.select(doc, F.explode(failed).alias("x")).select(doc, "x.path", "x.rule")


def valid(df: DataFrame, doc: str, rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """(doc, valid): whether all rows of a document satisfy all rules."""
    ok = F.lit(True)
    for _, condition in rules.values():
        ok = ok & F.coalesce(condition, F.lit(False))
    return df.groupBy(doc).agg(F.bool_and(ok).alias("valid"))


def one_of(value: Column, allowed: Sequence[str]) -> Column:
    return value.isin(*allowed)


def only_keys(json: Column, allowed: Sequence[str]) -> Column:
    """No key of a JSON object beside the allowed ones."""
    return F.size(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))) == 0


def wrapped(json: Column, key: str) -> Column:
    """A bare array put under the only list field."""
    return F.when(F.startswith(F.ltrim(json), F.lit("[")), F.concat(F.lit(f'{{"{key}":'), json, F.lit("}"))).otherwise(json)


#: Keywords of JSON Schema (draft 7) that are understood, and those that say nothing about validity.
_CHECKED = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "anyOf", "oneOf", "allOf", "$ref"}
#: Those of them that ask for a value's kind.
_BY_KIND = {"type", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern"}
_SILENT = {"title", "description", "default", "examples", "format", "$schema", "$id", "$comment", "$defs", "definitions"}
_FAILS = "array<struct<path:string,rule:string>>"


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the value, which is worked out once however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def schema_failures(v: Column, schema: Mapping[str, Any] | bool) -> Column:
    """An array of (path, rule) with all that a VARIANT breaks of a JSON schema, list indices as they are in the record:
    ``lines[2].note``. The schema is compiled to one expression of built-in functions. ``$ref`` into the schema's own
    definitions is resolved; one that comes back to itself, and keywords that are not understood, raise a ValueError rather
    than let a record pass. A whole number written 1.0 is an integer."""
    none = F.array().cast(_FAILS)
    fail = lambda path, rule, wrong: F.when(F.coalesce(wrong, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"))).cast(_FAILS)).otherwise(none)
    below = lambda path, key: F.concat(path, F.when(path == "", "").otherwise("."), key)

    def resolved(ref: str) -> Mapping[str, Any]:
        at: Any = schema
        for step in ref.removeprefix("#").split("/")[1:]:
            name = step.replace("~1", "/").replace("~0", "~")
            if not isinstance(at, Mapping) or name not in at:
                raise ValueError(f"{ref} is not in the schema")
            at = at[name]
        return at

    def asks_kind(s: Mapping[str, Any]) -> bool:
        return bool(set(s) & _BY_KIND) or any(map(_is_number, [*s.get("enum", []), s.get("const")]))

    def check(v: Column, s: Mapping[str, Any] | bool, path: Column, above: tuple[str, ...]) -> Column:
        if isinstance(s, bool):
            return none if s else fail(path, "never", F.lit(True))
        if unknown := set(s) - _CHECKED - _SILENT:
            raise ValueError(f"keywords that are not understood: {sorted(unknown)}")
        if "$ref" in s:
            if s["$ref"] in above:
                raise ValueError(f"{s['$ref']} refers to itself")
            return check(v, resolved(s["$ref"]), path, (*above, s["$ref"]))
        # Only what the schema asks is worked out: parts of objects and lists for some, a kind for others.
        named = [s["type"]] if isinstance(s.get("type"), str) else s.get("type", [])
        of = {"members": ("object", "map<string,variant>", {"required", "properties", "additionalProperties"}), "items": ("array", "array<variant>", {"items", "minItems", "maxItems"})}
        parts = {name: F.try_variant_get(v, "$", kind) for name, (shape, kind, words) in of.items() if shape in named or words & set(s)}
        if not parts:
            return scalar(v, s, path, above)
        return _bound(F.struct(*[p.alias(name) for name, p in parts.items()], v.alias("v")), lambda x: shaped({n: x[n] for n in parts}, x["v"], s, path, above))

    def scalar(v: Column, s: Mapping[str, Any], path: Column, above: tuple[str, ...]) -> Column:
        if not asks_kind(s):
            return inside({"v": v}, s, path, above)
        kind = F.when(F.is_variant_null(v), "null").otherwise(F.schema_of_variant(v))
        return _bound(F.struct(kind.alias("kind"), v.alias("v")), lambda x: inside({"shape": F.when(F.startswith(x["kind"], F.lit("OBJECT")), "object").when(F.startswith(x["kind"], F.lit("ARRAY")), "array").otherwise(x["kind"]), "v": x["v"]}, s, path, above))

    def shaped(parts: dict[str, Column], v: Column, s: Mapping[str, Any], path: Column, above: tuple[str, ...]) -> Column:
        if not asks_kind(s):
            return inside({**parts, "v": v}, s, path, above)
        shape = F.when(F.is_variant_null(v), "null")
        for name, label in (("members", "object"), ("items", "array")):
            if name in parts:
                shape = shape.when(parts[name].isNotNull(), label)
        rest = F.schema_of_variant(v)
        for label in ("OBJECT", "ARRAY"):
            if {"OBJECT": "members", "ARRAY": "items"}[label] not in parts:
                shape = shape.when(F.startswith(rest, F.lit(label)), label.lower())
        return _bound(shape.otherwise(rest), lambda told: inside({**parts, "shape": told, "v": v}, s, path, above))

    def inside(x: dict[str, Column], s: Mapping[str, Any], path: Column, above: tuple[str, ...]) -> Column:
        shape, v, out = x.get("shape", F.lit(None).cast("string")), x["v"], []
        is_number = shape.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(shape, F.lit("DECIMAL"))
        number, text = F.when(is_number, F.try_variant_get(v, "$", "double")), F.when(shape == "STRING", F.try_variant_get(v, "$", "string"))
        kinds = {"string": shape == "STRING", "number": is_number, "integer": (shape == "BIGINT") | is_number & (number == F.floor(number)), "boolean": shape == "BOOLEAN", "null": shape == "null", "object": shape == "object", "array": shape == "array"}
        if "type" in s:
            named = [s["type"]] if isinstance(s["type"], str) else s["type"]
            fits = F.lit(False)
            for name in named:
                fits = fits | kinds[name]
            out.append(fail(path, "type", ~fits))
        for rule, allowed in (("enum", s.get("enum")), ("const", [s["const"]] if "const" in s else None)):
            if allowed is not None:
                numbers, others = [x for x in allowed if _is_number(x)], [F.to_json(F.parse_json(F.lit(json.dumps(x)))) for x in allowed if not _is_number(x)]
                same = F.to_json(v).isin(*others) if others else F.lit(False)  # as VARIANT, so that spelling and the order of keys do not matter
                if numbers:
                    same = F.coalesce(number.isin(*map(float, numbers)), F.lit(False)) | same
                out.append(fail(path, rule, ~F.coalesce(same, F.lit(False))))
        for rule, wrong in (("minimum", lambda m: number < m), ("maximum", lambda m: number > m), ("exclusiveMinimum", lambda m: number <= m), ("exclusiveMaximum", lambda m: number >= m), ("minLength", lambda m: F.length(text) < m), ("maxLength", lambda m: F.length(text) > m), ("pattern", lambda m: ~text.rlike(m)), ("minItems", lambda m: F.size(x["items"]) < m), ("maxItems", lambda m: F.size(x["items"]) > m)):
            if rule in s:
                out.append(fail(path, rule, wrong(s[rule])))
        for name in s.get("required", ()):
            out.append(fail(below(path, F.lit(name)), "required", ~F.map_contains_key(x["members"], F.lit(name))))
        known = s.get("properties", {})
        for name, inner in known.items():
            out.append(F.when(F.map_contains_key(x["members"], F.lit(name)), check(F.element_at(x["members"], F.lit(name)), inner, below(path, F.lit(name)), above)).otherwise(none))
        extra = s.get("additionalProperties", True)
        if extra is not True:
            others = F.filter(F.map_entries(x["members"]), lambda e: ~e.key.isin(*known)) if known else F.map_entries(x["members"])
            rule = lambda e: F.array(F.struct(below(path, e.key).alias("path"), F.lit("extra").alias("rule"))).cast(_FAILS)
            each = rule if extra is False else lambda e: check(e.value, extra, below(path, e.key), above)
            out.append(F.coalesce(F.flatten(F.transform(others, each)), none))
        if "items" in s:
            if not isinstance(s["items"], (Mapping, bool)):
                raise ValueError("items must be one schema")
            at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            out.append(F.coalesce(F.flatten(F.transform(x["items"], lambda y, i: check(y, s["items"], at(i), above))), none))
        for inner in s.get("allOf", ()):
            out.append(check(v, inner, path, above))
        passes = lambda inner: F.size(check(v, inner, path, above)) == 0
        if "anyOf" in s:  # the first that passes is the last that is looked at
            out.append(fail(path, "anyOf", ~reduce(or_, map(passes, s["anyOf"]), F.lit(False))))
        if "oneOf" in s:
            out.append(fail(path, "oneOf", sum((F.when(passes(inner), 1).otherwise(0) for inner in s["oneOf"]), F.lit(0)) != 1))
        return F.concat(none, *out)

    return check(v, schema, F.lit(""), ())


def schema_violations(df: DataFrame, doc: str, col: str, schema: Mapping[str, Any]) -> DataFrame:
    """(doc, path, rule) for each record, JSON text or VARIANT, and each rule of the schema that it breaks. Text that is no
    JSON breaks "json"; so does a null."""
    text = df.schema[col].dataType.typeName() == "string"
    v = F.try_parse_json(col) if text else F.col(col)
    bad = F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("rule"))).cast(_FAILS)
    rows = df.select(doc, v.alias("__v")).select(doc, F.explode(F.when(F.col("__v").isNull(), bad).otherwise(schema_failures(F.col("__v"), schema))).alias("x"))
    return rows.select(doc, "x.path", "x.rule")


def schema_valid(df: DataFrame, doc: str, col: str, schema: Mapping[str, Any]) -> DataFrame:
    """(doc, valid): whether all records of a document satisfy the schema."""
    v = F.try_parse_json(col) if df.schema[col].dataType.typeName() == "string" else F.col(col)
    rows = df.select(doc, v.alias("__v"))
    ok = F.col("__v").isNotNull() & F.coalesce(F.size(schema_failures(F.col("__v"), schema)) == 0, F.lit(False))
    return rows.groupBy(doc).agg(F.bool_and(ok).alias("valid"))
