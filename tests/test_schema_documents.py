"""Schema documents: every planted defect is found, and nothing else."""

import copy
import json

from tidemark.operators import schema_documents as S

EXPECTED = S.Expected(["version", "record_type"], {"provenance": ["RAW", "MODEL"], "recordType": ["EVENT", "GAP"]}, ["version", "cause"], {("provenance", "MODEL"): ["model"], ("record_type", "GAP"): ["cause", "first"]})


def good():
    rule = lambda d, c, r: {"if": {"properties": {d: {"const": c}}, "required": [d]}, "then": {"required": r}}
    return {
        "$schema": S.DRAFT, "type": "object", "additionalProperties": False, "required": ["version", "record_type"], "$defs": {"provenance": {"enum": ["RAW", "MODEL"]}, "recordType": {"enum": ["EVENT", "GAP"], "deep": {"a": [{"b": [[1, {"c": None}]]}]}}},
        "properties": {"version": {"type": "string"}, "cause": {}, "more": {}}, "allOf": [rule("provenance", "MODEL", ["model"]), {"note": 1}, rule("record_type", "GAP", ["cause", "first"])],
    }


def put(*keys, value=None, drop=False):
    doc = good()
    at = doc
    for k in keys[:-1]:
        at = at[k]
    if drop:
        del at[keys[-1]]
    else:
        at[keys[-1]] = value
    return doc


def test_defects(spark):
    extra = copy.deepcopy(good())
    extra["allOf"].append({"if": {"properties": {"record_type": {"const": "EVENT"}}, "required": ["record_type"]}, "then": {"required": []}})
    later = copy.deepcopy(good())
    later["allOf"].append({"if": {"properties": {"record_type": {"const": "GAP"}}, "required": ["record_type"]}, "then": {"required": ["x"]}})
    cases = {
        "good": (good(), set()), "draft": (put("$schema", value="x"), {"schema draft URI mismatch"}), "type": (put("type", drop=True), {"schema root type must be object"}),
        "additional": (put("additionalProperties", value="false"), {"schema root must set additionalProperties to false"}), "order": (put("required", value=["record_type", "version"]), {"schema root required fields mismatch"}),
        "nodefs": (put("$defs", value=[]), {"schema defs must be an object"}), "enum": (put("$defs", "provenance", "enum", value=["RAW", 1]), {"provenance enum mismatch"}), "noenum": (put("$defs", "recordType", drop=True), {"recordType enum mismatch"}),
        "noprops": (put("properties", value=3), {"schema properties must be an object"}), "missing": (put("properties", "cause", drop=True), {"missing property definition for cause"}), "noall": (put("allOf", value={}), {"conditional structure invalid"}),
        "ifreq": (put("allOf", 0, "if", "required", value=["provenance", "x"]), {"conditional structure invalid"}), "then": (put("allOf", 2, "then", "required", value="x"), {"conditional structure invalid"}),
        "set": (put("allOf", 0, value={"if": {}}), {"conditional set mismatch", "conditional required mismatch for provenance=MODEL"}), "extra": (extra, {"conditional set mismatch"}), "later": (later, {"conditional required mismatch for record_type=GAP"}),
        "required": (put("allOf", 2, "then", "required", value=["first", "cause"]), {"conditional required mismatch for record_type=GAP"}), "array": ([], {"schema root must be an object"}),
    }
    rows = [(k, json.dumps(d)) for k, (d, _) in cases.items()] + [("broken", "{"), ("null", None), (None, json.dumps(good()))]
    want = {(k, e) for k, (_, es) in cases.items() for e in es} | {(k, "schema root must be an object") for k in ("broken", "null")}
    got = S.errors(spark.createDataFrame(rows, "doc string, text string").repartition(3), "doc", "text", EXPECTED)
    assert {tuple(r) for r in got.collect()} == want


def test_paths(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "x"}], "d": []}, "e": null}')], "id long, text string")
    got = {r["path"]: (r["kind"], r["value"]) for r in S.paths(df, "id", "text").collect()}
    assert got["$.a.b[1].c"] == ("STRING", "x") and got["$.a.b[0]"][1] == "1" and got["$.a.d"][0] == "ARRAY" and len(got) == 8
    assert S.errors(df.where("id > 5"), "id", "text", EXPECTED).count() == 0
