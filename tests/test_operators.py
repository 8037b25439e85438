"""Operator behaviour not reached by the registered queries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions import documents, status
from lakeloom.operators import access, relational as rel
from lakeloom.operators.schedule import missed_runs
from lakeloom.sources import sinks, tables


def test_nested_role_rules_first_path_permission_only(spark):
    schema = ("name string, decisionRules array<struct<effect:string, permission:array<struct<"
              "attributeName:string, attributeValueIncludedIn:array<string>>>>>, "
              "members struct<microsoftEntraMembers:array<struct<objectId:string>>>")
    roles = spark.createDataFrame([
        ("r1", [("Permit", [("Path", ["/Tables/a", "/Files"]), ("Path", ["/ignored"]), ("Action", ["Read"])])],
         ([("u1",)],)),
        ("r2", [("Permit", [("Action", ["Read", "Write"]), ("Path", ["*"])])], ([("u2",)],)),
    ], schema)
    rows = sorted((r.role, r.path, r.action) for r in access.rule_rows(roles).collect())
    assert rows == [("r1", "/Files", "Read"), ("r1", "/Tables/a", "Read"), ("r2", "*", "Read"), ("r2", "*", "Write")]
    assert [r.name for r in access.roles_with_member(roles, "u2").collect()] == ["r2"]


def test_read_role_builders(spark):
    names = spark.createDataFrame([("table", "t1"), ("folder", "a/b\\c"), ("default", None)], ["kind", "name"])
    rows = sorted((r.role, r.path) for r in access.read_role_rows(names, "kind", "name").collect())
    assert rows == [("DefaultReader", "*"), ("a_b_cReader", "/a/b\\c"), ("a_b_cReader", "/a/b\\c/*"),
                    ("t1Reader", "/Tables/t1")]


def test_register_policies_raise(spark):
    cat = spark.createDataFrame([("p", "a", "x")], ["path", "name", "target"])
    new = spark.createDataFrame([("p", "a", "y")], ["path", "name", "target"])
    with pytest.raises(Exception, match="entry exists"):
        sinks.register(new, cat, "Abort").collect()
    missing = spark.createDataFrame([("p", "b", "y")], ["path", "name", "target"])
    with pytest.raises(Exception, match="no entry to overwrite"):
        sinks.register(missing, cat, "OverwriteOnly").collect()
    out = sorted(tuple(r) for r in sinks.register(new, cat, "OverwriteOnly").collect())
    assert out == [("p", "a", "y")]
    cat2 = spark.createDataFrame([("p", "a", "x"), ("p", "a_1", "x")], ["path", "name", "target"])
    two = spark.createDataFrame([("p", "a", "y"), ("p", "a", "z")], ["path", "name", "target"])
    names = sorted(r.name for r in sinks.register(two, cat2, "GenerateUniqueName").collect())
    assert names == ["a", "a_1", "a_2", "a_3"]


def test_validate_package_and_defaults(spark):
    df = spark.createDataFrame([("not json",), ('{"id": "ok-1", "displayName": "x", "foo": 1}',)], ["raw"])
    errs = [r[0] for r in df.select(documents.validate_package("raw")).collect()]
    assert errs == [["not a JSON object"], ["unknown key: foo"]]
    cfg = spark.createDataFrame([("Bogus", None, None)], "type string, location string, suffixItemNames boolean")
    with pytest.raises(Exception, match="Unsupported deployment type"):
        cfg.select(documents.apply_defaults(F.struct("type", "location", "suffixItemNames"))).collect()


def test_decode_definition_and_pick_output(spark):
    parts = spark.createDataFrame([([("a.json", "e30=")],), ([("b.json", "bm90IGpzb24=")],)],
                                  "parts array<struct<path:string,payload:string>>")
    out = [r[0] for r in parts.select(documents.decode_definition("parts", "b.json", "x int")).collect()]
    assert out == [None, None]
    data = spark.createDataFrame([('{"text/plain": "hi"}',), ('{"application/json": {"a": 1}}',), ('{"b": 2}',)],
                                 ["d"])
    assert [r[0] for r in data.select(documents.pick_output("d")).collect()] == ["hi", '{"a":1}', '{"b": 2}']


def test_resolve_payload_unknown_type_fails(spark):
    parts = spark.createDataFrame([("p", "Ftp", "x")], ["path", "payloadType", "payload"])
    files = spark.createDataFrame([], "path string, content_base64 string")
    with pytest.raises(Exception, match="Unsupported payload type"):
        tables.resolve_payload(parts, files).collect()


def test_flatten_pages_shapes(spark):
    pages = spark.createDataFrame([('{"value": [{"a": 1}, {"a": 2}], "continuationToken": "t"}',),
                                   ('[{"a": 3}]',), ('{"a": 4}',)], ["body"])
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert sorted(r.a for r in tables.flatten_pages(pages, "body", schema).collect()) == [1, 2, 3, 4]


def test_link_parents_with_shortcut_contents(spark):
    listing = spark.createDataFrame([("sc", True), ("sc/old", False), ("d", True), ("d/f", False), ("x/y", False)],
                                    ["path", "isDirectory"])
    contents = spark.createDataFrame([("sc", "new", False)], ["shortcut", "path", "isDirectory"])
    out = {r.path: r.parent for r in rel.link_parents(listing, shortcut_contents=contents).collect()}
    assert out == {"sc": None, "sc/new": "sc", "d": None, "d/f": "d", "x/y": None}


def test_missed_runs_and_schedule_text(spark):
    exp = spark.createDataFrame([("j", dt.datetime(2024, 1, 1, h)) for h in range(3)], "k string, fire timestamp_ntz")
    act = spark.createDataFrame([("j", dt.datetime(2024, 1, 1, 1, 30))], "k string, ts timestamp_ntz")
    assert sorted(r.fire.hour for r in missed_runs(exp, act, "k", "fire", "ts").collect()) == [0, 2]
    cfg = spark.createDataFrame([("Weekly", None, ["09:00"], ["Monday", "Friday"], False)],
                                "type string, interval int, times array<string>, weekdays array<string>, en boolean")
    text = cfg.select(status.describe_schedule(F.lit("Run"), F.struct("type", "interval", "times", "weekdays"),
                                               "en")).first()[0]
    assert text == "Run - Weekly on Monday, Friday at 09:00 (Disabled)"


def test_ancestor_path_cycle_is_truncated(spark):
    nodes = spark.createDataFrame([("a", "b", "A"), ("b", "a", "B"), ("c", None, "C")], ["id", "parent", "name"])
    out = {r.id: (r.truncated, r.path) for r in rel.ancestor_path(nodes, "id", "parent", "name", max_depth=4)
           .collect()}
    assert out["c"] == (False, "C") and out["a"][0] and out["b"][0]


def test_scan_text_keeps_files_without_text(spark, tmp_dir):
    import os
    os.makedirs(f"{tmp_dir}/t/sub")
    with open(f"{tmp_dir}/t/a.txt", "w") as f:
        f.write("line 1\nline 2\n")
    open(f"{tmp_dir}/t/sub/empty.txt", "w").close()
    out = {os.path.basename(r.path): r.content for r in tables.scan_text(spark, f"{tmp_dir}/t").collect()}
    assert out == {"a.txt": "line 1\nline 2\n", "empty.txt": ""}
    listing = {r.name: r.isDirectory for r in tables.list_paths(spark, f"{tmp_dir}/t").collect()}
    assert listing == {"a.txt": False, "sub/empty.txt": False, "sub": True}
