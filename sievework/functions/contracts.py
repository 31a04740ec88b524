"""Contracts of JSON documents as columns: a schema becomes expressions over a variant, one row a document.

Known keywords are those of ``KEYWORDS``, with ``$ref`` to the schema's own definitions; another one is an error when
the expressions are made, so nothing goes unchecked. A schema that refers to itself is one too.

Defined cases: a null or unreadable document has the one problem ``$: json``; NaN and Infinity are unreadable; a missing
field is a problem only where it is required; a whole number such as 1.0 is an integer, a boolean is no number; the checks of a
kind (patterns of texts, bounds of numbers, items of arrays) pass over values of other kinds, which ``type`` reports.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import text as X

KEYWORDS = frozenset(
    "type const enum pattern minLength maxLength minimum maximum exclusiveMinimum exclusiveMaximum multipleOf required properties additionalProperties propertyNames minProperties maxProperties "
    "items prefixItems minItems maxItems uniqueItems allOf anyOf oneOf not if then else".split()
)
#: Keywords that state nothing to check, formats among them; fixed values.
REMARKS = frozenset("$schema $id $defs title description default examples format $comment".split())


class ContractError(Exception):
    """A schema that can't be made into checks."""


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _is(value: Column, kind: str) -> Column:
    found = X.json_type(value)
    if kind == "number":
        return found.isin("integer", "number")
    if kind == "integer":
        return (found == "integer") | ((found == "number") & (_number(value) == F.floor(_number(value))))
    return found == kind


def _same(value: Column, wanted: object) -> Column:
    if isinstance(wanted, bool) or wanted is None or isinstance(wanted, (dict, list)):
        return F.to_json(value) == json.dumps(wanted, ensure_ascii=False, separators=(",", ":"))
    if isinstance(wanted, str):
        return _is(value, "string") & (F.try_variant_get(value, "$", "string") == wanted)
    return _is(value, "number") & (_number(value) == float(wanted))


def _resolved(schema: Mapping, root: Mapping, trail: tuple[str, ...]) -> tuple[Mapping, tuple[str, ...]]:
    while "$ref" in schema:
        name = schema["$ref"]
        if name in trail or not name.startswith("#/"):
            raise ContractError(f"reference: {name}")
        trail += (name,)
        found: object = root
        for part in name[2:].split("/"):
            if not isinstance(found, Mapping) or part not in found:
                raise ContractError(f"reference: {name}")
            found = found[part]
        schema = {**found, **{k: v for k, v in schema.items() if k != "$ref"}}
    return schema, trail


def _checks(value: Column, schema: Mapping | bool, root: Mapping, place: Column, trail: tuple[str, ...] = ()) -> list[Column]:
    """Arrays of problems of one value, which is there; in the order of keywords, then of properties."""
    if isinstance(schema, bool):
        return [] if schema else [F.array(F.concat(place, F.lit(": false")))]
    schema, trail = _resolved(schema, root, trail)
    if unknown := set(schema) - KEYWORDS - REMARKS:
        raise ContractError(f"keywords: {','.join(sorted(unknown))}")
    none = F.array().cast("array<string>")
    out: list[Column] = []

    def check(keyword: str, sound: Column, where: Column = place) -> None:
        out.append(F.when(~F.coalesce(sound, F.lit(False)), F.array(F.concat(where, F.lit(f": {keyword}")))).otherwise(none))

    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        sound = F.lit(False)
        for kind in kinds:
            sound = sound | _is(value, kind)
        check("type", sound)
    if "const" in schema:
        check("const", _same(value, schema["const"]))
    if "enum" in schema:
        sound = F.lit(False)
        for wanted in schema["enum"]:
            sound = sound | F.coalesce(_same(value, wanted), F.lit(False))
        check("enum", sound)
    text, string = F.try_variant_get(value, "$", "string"), _is(value, "string")
    if "pattern" in schema:
        check("pattern", ~string | text.rlike(schema["pattern"]))
    if "minLength" in schema:
        check("minLength", ~string | (F.length(text) >= schema["minLength"]))
    if "maxLength" in schema:
        check("maxLength", ~string | (F.length(text) <= schema["maxLength"]))
    for keyword, sound in (("minimum", lambda n, b: n >= b), ("maximum", lambda n, b: n <= b), ("exclusiveMinimum", lambda n, b: n > b), ("exclusiveMaximum", lambda n, b: n < b), ("multipleOf", lambda n, b: F.floor(n / b) == n / b)):
        if keyword in schema:
            check(keyword, ~_is(value, "number") | sound(_number(value), F.lit(float(schema[keyword]))))
    items, many = F.try_variant_get(value, "$", "array<variant>"), _is(value, "array")
    if "minItems" in schema:
        check("minItems", ~many | (F.size(items) >= schema["minItems"]))
    if "maxItems" in schema:
        check("maxItems", ~many | (F.size(items) <= schema["maxItems"]))
    if schema.get("uniqueItems"):
        texts = F.transform(items, lambda x: F.to_json(x))
        check("uniqueItems", ~many | (F.size(F.array_distinct(texts)) == F.size(texts)))
    properties = schema.get("properties", {})
    fields = F.coalesce(F.json_object_keys(F.to_json(value)), none)
    for name in schema.get("required", ()):
        check("required", (X.json_type(value) != "object") | F.array_contains(fields, name), F.concat(place, F.lit(f".{name}")))
    for keyword, sound in (("minProperties", lambda n, b: n >= b), ("maxProperties", lambda n, b: n <= b)):
        if keyword in schema:
            check(keyword, (X.json_type(value) != "object") | sound(F.size(fields), F.lit(schema[keyword])))
    if "propertyNames" in schema:
        # A name as a value of its own: what the contract says of texts holds for it.
        name = lambda x: F.to_variant_object(F.array(x))
        out.append(F.flatten(F.transform(fields, lambda x: F.concat(none, *_checks(F.try_variant_get(name(x), "$[0]", "variant"), schema["propertyNames"], root, F.concat(place, F.lit("."), x), trail)))))
    known = F.array(*map(F.lit, properties)) if properties else none
    others = F.array_sort(F.array_except(fields, known))
    extra = schema.get("additionalProperties", True)
    if extra is False:
        out.append(F.transform(others, lambda x: F.concat(place, F.lit("."), x, F.lit(": additionalProperties"))))
    elif extra is not True:
        values = F.try_variant_get(value, "$", "map<string,variant>")
        out.append(F.flatten(F.transform(others, lambda x: F.concat(none, *_checks(F.try_element_at(values, x), extra, root, F.concat(place, F.lit("."), x), trail)))))
    for name, child in properties.items():
        # A path has no way to escape a quote.
        mark = "'" if "'" not in name else '"'
        if mark in name:
            raise ContractError(f"property: {name}")
        inner = F.try_variant_get(value, f"$[{mark}{name}{mark}]", "variant")
        if found := _checks(inner, child, root, F.concat(place, F.lit(f".{name}")), trail):
            out.append(F.when(inner.isNotNull(), F.concat(*found)).otherwise(none))
    first = schema.get("prefixItems", [])
    for i, child in enumerate(first):
        inner = F.try_variant_get(value, f"$[{i}]", "variant")
        out.append(F.when(inner.isNotNull(), F.concat(none, *_checks(inner, child, root, F.concat(place, F.lit(f"[{i}]")), trail))).otherwise(none))
    if "items" in schema:

        def element(x: Column, i: Column) -> Column:
            found = F.concat(none, *_checks(x, schema["items"], root, F.concat(place, F.lit("["), i.cast("string"), F.lit("]")), trail))
            return F.when(i >= len(first), found).otherwise(none) if first else found

        out.append(F.when(many, F.flatten(F.transform(items, element))).otherwise(none))
    part = lambda child: F.concat(none, *_checks(value, child, root, place, trail))
    out += [part(child) for child in schema.get("allOf", ())]
    for keyword in ("anyOf", "oneOf"):
        if keyword in schema:
            kept = sum((F.when(F.size(part(child)) == 0, 1).otherwise(0) for child in schema[keyword]), F.lit(0))
            check(keyword, kept >= 1 if keyword == "anyOf" else kept == 1)
    if "not" in schema:
        check("not", F.size(part(schema["not"])) > 0)
    if "if" in schema:
        out.append(F.when(F.size(part(schema["if"])) == 0, part(schema.get("then", True))).otherwise(part(schema.get("else", True))))
    return out


def problems(document: Column, schema: Mapping) -> Column:
    """All problems of a variant column, as ``place: keyword`` texts; empty where it keeps to the schema."""
    found = _checks(document, schema, schema, F.lit("$"))
    sound = F.concat(*found) if found else F.array().cast("array<string>")
    return F.when(document.isNull(), F.array(F.lit("$: json"))).otherwise(sound)
