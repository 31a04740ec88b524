"""Contracts of JSON documents as columns."""

import json

import pytest

from sievework.functions import contracts
from sievework.sources import documents

SCHEMA = {
    "type": "object",
    "required": ["a"],
    "additionalProperties": False,
    "properties": {
        "a": {"$ref": "#/$defs/whole"},
        "b": {"type": ["string", "null"], "pattern": "^x", "maxLength": 3},
        "c": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "prefixItems": [{"const": "h"}], "items": {"$ref": "#/$defs/whole"}},
        "d": {"enum": [1, "1", True, None]},
        "e": {"type": "object", "additionalProperties": {"type": "number", "exclusiveMaximum": 2}, "propertyNames": {"pattern": "^k"}, "minProperties": 1},
        "f": {"anyOf": [{"type": "string"}, {"type": "integer"}], "not": {"const": 7}},
        "g": {"oneOf": [{"type": "number"}, {"type": "integer"}]},
        "h": {"allOf": [{"type": "integer"}, {"multipleOf": 3}], "if": {"minimum": 10}, "then": {"maximum": 12}, "else": {"exclusiveMinimum": 0}},
        "it's": {"const": {"z": [1, None]}},
    },
    "$defs": {"whole": {"type": "integer", "minimum": 0}},
}
CASES = [
    ('{"a": 1}', []),
    ("{}", ["$.a: required"]),
    ("[]", ["$: type"]),
    ('{"a": 1.0}', []),
    ('{"a": 1.5}', ["$.a: type"]),
    ('{"a": true}', ["$.a: type"]),
    ('{"a": -1, "z": 1, "y": 2}', ["$.y: additionalProperties", "$.z: additionalProperties", "$.a: minimum"]),
    ('{"a": 1, "b": null}', []),
    ('{"a": 1, "b": "xüü"}', []),
    ('{"a": 1, "b": "yxxx"}', ["$.b: pattern", "$.b: maxLength"]),
    ('{"a": 1, "c": []}', ["$.c: minItems"]),
    ('{"a": 1, "c": ["h", 2, 3]}', []),
    ('{"a": 1, "c": ["g", -2, -2, "q"]}', ["$.c: maxItems", "$.c: uniqueItems", "$.c[0]: const", "$.c[1]: minimum", "$.c[2]: minimum", "$.c[3]: type"]),
    ('{"a": 1, "d": "1"}', []),
    ('{"a": 1, "d": true}', []),
    ('{"a": 1, "d": false}', ["$.d: enum"]),
    ('{"a": 1, "d": null}', []),
    ('{"a": 1, "e": {"k1": 1.5, "k2": 2, "j": "s"}}', ["$.e.j: pattern", "$.e.j: type", "$.e.k2: exclusiveMaximum"]),
    ('{"a": 1, "e": {}}', ["$.e: minProperties"]),
    ('{"a": 1, "f": 7}', ["$.f: not"]),
    ('{"a": 1, "f": 7.5}', ["$.f: anyOf"]),
    ('{"a": 1, "g": 1}', ["$.g: oneOf"]),
    ('{"a": 1, "g": 1.5}', []),
    ('{"a": 1, "h": 12}', []),
    ('{"a": 1, "h": 15}', ["$.h: maximum"]),
    ('{"a": 1, "h": -3}', ["$.h: exclusiveMinimum"]),
    ('{"a": 1, "h": 4}', ["$.h: multipleOf"]),
    ('{"a": 1, "it\'s": {"z": [1, null]}}', []),
    ('{"a": 1, "it\'s": {"z": [2, null]}}', ["$.it's: const"]),
    ('{"a": NaN}', ["$: json"]),
    ("", ["$: json"]),
    (None, ["$: json"]),
]


def test_problems_by_keyword(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, document string")
    got = {r.id: r for r in documents.contract_problems(rows, SCHEMA).collect()}
    for i, (text, expected) in enumerate(CASES):
        assert sorted(got[i].problems) == sorted(expected), text
        assert got[i].first_problem == (got[i].problems[0] if expected else None)
    assert documents.contract_problems(rows.limit(0), SCHEMA).count() == 0


def test_schemas_that_cannot_be_checked():
    for schema in ({"contains": {}}, {"$ref": "#/$defs/gone"}, {"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"x": {"$ref": "#/$defs/a"}}}}}):
        with pytest.raises(contracts.ContractError):
            contracts._resolved(schema, schema, ()) if "properties" in schema else contracts.problems(contracts.F.lit(None), schema)


def test_a_manifest_names_its_first_problem(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"a": 3, "b": "x"}))
    (tmp_path / "bad.json").write_text(json.dumps({"a": "secret value"}))
    assert documents.read_contracted(spark, "good.json", str(tmp_path), SCHEMA) == {"a": 3, "b": "x"}
    with pytest.raises(documents.SourceError) as error:
        documents.read_contracted(spark, "bad.json", str(tmp_path), SCHEMA)
    assert error.value.details == {"fields": "$.a: type"} and "secret" not in json.dumps(error.value.report())
