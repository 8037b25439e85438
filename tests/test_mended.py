"""Inputs that the registered queries do not contain: literal cases and random ones against plain Python."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions.documents import pick_output
from lakeloom.operators import access, project, relational
from lakeloom.sources import sinks, tables
from lakeloom.streaming import tracking


@pytest.mark.parametrize("seed", range(3))
def test_remap_is_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    word = lambda lo, hi: "".join(rng.choice("abx.") for _ in range(rng.randint(lo, hi)))
    docs = [(i, word(0, 40)) for i in range(40)]
    maps = [(s, word(1, 4), word(0, 4)) for s in range(12)]
    got = {r.i: r.t for r in relational.ordered_remap(spark.createDataFrame(docs, "i long, t string"),
           spark.createDataFrame(maps, "seq long, old_id string, new_id string"), "i", "t").collect()}
    for i, t in docs:
        for s, a, b in maps:
            if s < i:
                t = t.replace(a, b)
        assert got[i] == t


def test_remap_across_an_edge(spark):
    docs = spark.createDataFrame([(9, "zz xabcdy zz")], "i long, t string")
    maps = spark.createDataFrame([(1, "abcd", "12"), (2, "x12y", "Z")], "seq long, old_id string, new_id string")
    assert relational.ordered_remap(docs, maps, "i", "t").first().t == "zz Z zz"


def test_deep_and_cyclic_ancestors(spark):
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(100)] + [(200, 201, "a"), (201, 200, "b"), (202, 200, "c"), (300, 999, "orphan")]
    got = {r.id: r for r in relational.ancestor_path(spark.createDataFrame(rows, "id long, parent long, name string"), "id", "parent", "name").collect()}
    assert got[99].depth == 100 and got[99].path == "/".join(f"n{i}" for i in range(100)) and not got[99].truncated
    assert got[200].truncated and got[202].truncated and not got[300].truncated and got[300].path == "orphan"


def test_many_rule_lengths(spark):
    rules = spark.createDataFrame([("r", "p" * n) for n in range(1, 4200, 7)] + [("w", "*")], "role string, path string")
    targets = spark.createDataFrame([("p" * 50 + "/x",), ("q",)], "target string")
    got = access.path_access(rules, targets, "target")
    assert got.filter("role = 'r'").count() == 8 and got.filter("role = 'w'").count() == 2


def test_replaced_shortcuts_leave_no_descendants(spark):
    listing = spark.createDataFrame([("root", True), ("root/sc", True), ("root/sc/old", True), ("root/sc/old/deep.txt", False)], "path string, isDirectory boolean")
    new = spark.createDataFrame([("root/sc", "n.txt", False)], "shortcut string, path string, isDirectory boolean")
    got = {r.path: r.parent for r in relational.link_parents(listing, shortcut_contents=new).collect()}
    assert got == {"root": None, "root/sc": "root", "root/sc/n.txt": "root/sc"}


def test_small_cases(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert project.merge_metadata(base, spark.createDataFrame([(1, "x"), (1, None), (1, "y")], "k long, v string"), "k", ["v"]).count() == 2
    d = spark.createDataFrame([('{"text/plain":"","application/json":{"b":1,"a":2}}',), ('{"application/json":"s"}',), ('{"text/plain":"t"}',), ('{"c":1}',)], "d string")
    assert [r[0] for r in d.select(pick_output("d")).collect()] == ['{"b":1,"a":2}', '"s"', "t", '{"c":1}']
    a = spark.createDataFrame([(None,), (1,), (1,), (2,)], "k long")
    b = spark.createDataFrame([(None,), (2,)], "k long")
    assert [r.k for r in relational.difference(a, b).collect()] == [1, 1] and [r.k for r in relational.difference(a, b, keep_duplicates=False).collect()] == [1]
    pages = spark.createDataFrame([("garbage",), ('{"value":null}',), ('{"value":[{"a":1}]}',), ('[{"a":2}]',), ('{"a":3}',), ("{bad",)], "body string")
    assert sorted(r.a for r in tables.flatten_pages(pages, "body", T.StructType([T.StructField("a", T.LongType())])).collect()) == [1, 2, 3]


def test_missing_and_repeated_payload_files(spark):
    parts = spark.createDataFrame([("AssetLink", "p")], "payloadType string, payload string")
    files = spark.createDataFrame([("p", "YQ=="), ("p", "YQ==")], "path string, content_base64 string")
    assert tables.resolve_payload(parts, files).count() == 1
    with pytest.raises(Exception, match="No content"):
        tables.resolve_payload(parts, files.limit(0)).collect()


def test_repeated_requests(spark):
    cat = spark.createDataFrame([("p", "a", 0), ("p", "x_20240131120000", 0)], "path string, name string, v int")
    new = spark.createDataFrame([("p", "n", 1), ("p", "n", 2), ("p", "a", 3), ("p", "a_1", 4)], cat.schema)
    names = sorted(r.name for r in sinks.register(new, cat, "GenerateUniqueName").collect())
    assert len(names) == len(set(names)) == 6 and {"n", "n_1", "a", "a_1", "a_2"} <= set(names)
    over = {r.name: r.v for r in sinks.register(new, cat, "CreateOrOverwrite").collect()}
    assert over == {"n": 2, "a": 3, "a_1": 4, "x_20240131120000": 0}
    with pytest.raises(Exception, match="entry exists"):
        sinks.register(new.filter("name = 'n'"), cat, "Abort").collect()


def test_csv_columns_by_name(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "f.csv"), "w") as f:
        f.write("name,city,n\nann,rome,3\n")
    schema = T.StructType([T.StructField("city", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("more", T.StringType())])
    one = tables.csv_to_table(spark, tmp_dir, schema)
    two = tables.csv_to_table(spark, tmp_dir)
    assert one.first() == ("rome", 3, "ann", None) and two.first() == ("ann", "rome", "3")


def test_tracking_in_batches(spark, tmp_dir):
    """Back-to-back batches, late terminal events, events after the outcome, sub-second deadlines."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    batches = [[(1, at(0), "Running"), (2, at(0), "Running"), (4, at(0), "Running")],
               [(2, at(100), "Failed"), (2, at(50), "Succeeded"), (4, at(300.0004), "Succeeded"), (3, at(2000), "Running")],
               [(1, at(2100), "Succeeded"), (2, at(2100), "Failed"), (3, at(2050), "Cancelled"), (9, at(4000), "Running")],
               [(1, at(9000), "Succeeded"), (9, at(90000), "x")], [(9, at(99000), "x")]]
    schema = "k long, ts timestamp_ntz, s string"
    src, out, ckpt = (os.path.join(tmp_dir, x) for x in ("s", "o", "c"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = tracking.track_until_terminal(spark.readStream.schema(schema).parquet(src), "k", "ts", "s", 300, "10 seconds") \
            .writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.k, r.final_status) for r in spark.read.parquet(out).collect())
    assert got == [(1, "TimedOut"), (2, "Succeeded"), (3, "TimedOut"), (4, "TimedOut"), (9, "TimedOut")]


def test_late_updates_do_not_win(spark):
    base = spark.createDataFrame([(1, "Pending", dt.datetime(2024, 1, 2))], "k long, s string, ts timestamp_ntz")
    late = spark.createDataFrame([(1, "InProgress", dt.datetime(2024, 1, 1))], base.schema)
    assert tracking.refresh_status_batch(base, late, "k", "s", "ts", ["Pending", "InProgress"]).first().s == "Pending"


def test_caller_settings_are_kept(spark):
    from lakeloom.session import apply_sql_defaults
    key = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "7MB")
    apply_sql_defaults(spark)
    assert spark.conf.get(key) == "7MB"
    spark.conf.set(key, before)
    assert F is not None


def test_package_rules(spark):
    import json
    from lakeloom.functions.documents import validate_package
    item = {"type": "N", "displayName": "x", "description": ""}
    good = {"id": "ab", "displayName": "d", "deploymentConfig": {"globalInterceptors": {"g": {"type": "StringReplacement", "config": {"replacements": {"a": "b"}}}}},
            "items": [{**item, "installType": "Default", "definition": {"creationMode": "WithDefinition", "parts": [{"path": "p", "payload": "x", "payloadType": "Link"}],
                       "interceptor": {"type": "Reference", "config": {"id": "g"}}}, "schedules": [{"enabled": True, "jobType": "j", "configuration": {}}]}], "data": [{"files": []}]}
    bad = [{**good, "deploymentConfig": {"nope": 1}}, {**good, "items": [{**item, "installType": "Later"}]}, {**good, "items": [{**item, "definition": {"creationMode": "x"}}]},
           {**good, "items": [{**item, "definition": {"parts": [{"payload": "x", "payloadType": "Link"}]}}]}, {**good, "items": [{**item, "definition": {"interceptor": {"type": "Reference", "config": {"id": "z"}}}}]},
           {**good, "items": "none"}, {**good, "items": [{**item, "definition": {"interceptor": {"type": "StringReplacement", "config": {"replacements": {"a": 1}}}}}]},
           {**good, "items": [{**item, "shortcuts": [{}]}]}, {**good, "items": [{**item, "what": 1}]}, {**good, "data": [{"files": [{"path": "p"}]}]},
           {**good, "deploymentConfig": {"onFinishJobs": [{"itemId": "i", "jobType": "j", "deploymentPolicy": "Maybe"}]}}, {**good, "deploymentConfig": {"parameters": {"p": {}}}}]
    got = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate([good, *bad])], "i long, raw string").select("i", validate_package("raw").alias("m")).orderBy("i").collect()
    assert got[0].m == [] and all(r.m for r in got[1:]), [(r.i, r.m) for r in got]


def test_names_with_spaces_and_signs(spark, tmp_dir):
    names = {"x dir/a b.txt": "one", "x dir/c%20d+e.txt": "two", "\u00e9/f.txt": ""}
    for n, t in names.items():
        os.makedirs(os.path.dirname(os.path.join(tmp_dir, "r", n)), exist_ok=True)
        with open(os.path.join(tmp_dir, "r", n), "w") as f:
            f.write(t)
    got = {r.path.split("/r/", 1)[1]: r.content for r in tables.scan_text(spark, f"{tmp_dir}/r").collect()}
    assert got == names
    assert {r.name for r in tables.list_paths(spark, f"{tmp_dir}/r").collect()} == {*names, "x dir", "\u00e9"}


def test_custom_roles(spark):
    roles = spark.createDataFrame([("r", ["/a", "/b"], ["Read", "Write"]), ("none", [], ["Read"])], "role string, paths array<string>, actions array<string>")
    assert access.custom_role_rows(roles).count() == 4
