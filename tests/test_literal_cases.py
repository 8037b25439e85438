"""Literal cases from FIXTURES.md part C and rules R1-R4."""

import base64
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions import dates, documents, status, text, validate
from lakeloom.operators import access, project, relational as rel
from lakeloom.operators.schedule import expand_schedule
from lakeloom.sources.tables import csv_to_table


def one(spark, col, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys())) if cols else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def test_replace_many_cases(spark):
    df = spark.createDataFrame([("Connect to {{H}}:{{P}}",), ("a",), ("a.b",)], ["t"])
    rows = df.select(
        text.replace_many("t", {"{{H}}": "host", "{{P}}": "5432"}).alias("v1"),
        text.replace_many("t", [("a", "b"), ("b", "c")]).alias("v2"),
        text.replace_many("t", {".": "$&"}).alias("v3")).collect()
    assert rows[0]["v1"] == "Connect to host:5432"
    assert rows[1]["v2"] == "c"
    assert rows[2]["v3"] == "a$&b"


def test_replace_many_empty_is_error(spark):
    df = spark.createDataFrame([("",)], ["t"])
    with pytest.raises(Exception, match="cannot be empty"):
        df.select(text.replace_many("t", {"a": "b"})).collect()


def test_replace_many_variables_and_key_order(spark):
    assert text.js_object_order(["b", "10", "a", "2"]) == ["2", "10", "b", "a"]
    df = spark.createDataFrame([("x {{WS}}",)], ["t"])
    v = df.select(text.replace_many("t", {"{{WS}}": "{{WORKSPACE_ID}}"}, {"{{WORKSPACE_ID}}": "ws1"})).first()[0]
    assert v == "x ws1"
    # a variable with an empty value leaves the literal value
    v = df.select(text.replace_many("t", {"{{WS}}": "{{WORKSPACE_ID}}"}, {"{{WORKSPACE_ID}}": ""})).first()[0]
    assert v == "x {{WORKSPACE_ID}}"


def test_substitute_values(spark):
    df = spark.createDataFrame([("{{U}}", ("x{{U}}",))], "u string, s struct<o:string>")
    out = documents.substitute_values(df, {"{{U}}": "1"}).first()
    assert out["u"] == "1" and out["s"]["o"] == "x{{U}}"


def test_sanitize_name(spark):
    df = spark.createDataFrame([(" a<b>  c__d_ ",)], ["s"])
    assert df.select(text.sanitize_name("s")).first()[0] == "a_b_c_d"


def test_parse_lake_path(spark):
    df = spark.createDataFrame([("i/Tables/s/t/_delta_log",), ("i/Tables/t/_delta_log",)], ["p"])
    rows = df.select(text.parse_lake_path("p").alias("t")).select("t.*").collect()
    assert (rows[0]["name"], rows[0]["schema"], rows[0]["path"]) == ("t", "s", "i/Tables/s/t/")
    assert (rows[1]["name"], rows[1]["schema"]) == ("t", None)


@pytest.mark.parametrize("rule,target,compatible,normalized", [
    ("Tables/T1", "Tables/T10", True, False),
    ("/Tables/t", "Tables/t", False, True),
    ("*", "anything/at/all", True, True),
    ("/f/*", "f/x/y", False, True),
])
def test_path_access(spark, rule, target, compatible, normalized):
    rules = spark.createDataFrame([("r", rule)], ["role", "path"])
    targets = spark.createDataFrame([(target,)], ["t"])
    assert (access.path_access(rules, targets, "t").count() > 0) == compatible
    assert (access.path_access(rules, targets, "t", normalize=True).count() > 0) == normalized


NOW = dt.datetime(2024, 1, 1, 12, 0, 0)


def fold(spark, jobs, deployed, expected, end, keep_cancelled=False):
    j = spark.createDataFrame([("d", s, i, p) for i, (s, p) in enumerate(jobs)] or [("d", "Completed", 0, "x")],
                              "k string, status string, seq int, policy string")
    if not jobs:
        j = j.limit(0)
    d = spark.createDataFrame([("d", expected, deployed, end)], "k string, e int, n int, end timestamp_ntz")
    return rel.status_fold(j, "k", "status", "seq", "policy", d, "e", "n", "end", F.lit(NOW).cast("timestamp_ntz"),
                           keep_cancelled=keep_cancelled).first()["status"]


def test_status_fold_rules(spark):
    ff = "FailOnError"
    assert fold(spark, [("Failed", ff), ("Cancelled", ff)], 3, 3, None) == "Failed"
    assert fold(spark, [("InProgress", ff)], 3, 3, NOW - dt.timedelta(minutes=5)) == "InProgress"
    assert fold(spark, [("Completed", ff), ("Completed", ff)], 3, 3, None) == "Succeeded"
    assert fold(spark, [("Completed", ff)], 2, 3, NOW - dt.timedelta(minutes=11)) == "Failed"
    assert fold(spark, [("Failed", "IgnoreErrors")], 3, 3, None) == "Succeeded"
    assert fold(spark, [("Failed", ff), ("Cancelled", ff)], 3, 3, None, keep_cancelled=True) == "Cancelled"


def test_format_duration(spark):
    df = spark.createDataFrame([((1, 0, 3, 4, 9),), ((None, None, None, None, None),)],
                               "d struct<days:int,hours:int,minutes:int,seconds:int,milliseconds:int>")
    assert [r[0] for r in df.select(dates.format_duration("d")).collect()] == ["1d 3m 4s", "0s"]


def test_lookup_names(spark):
    req = spark.createDataFrame([("X",), ("x",), ("zz",)], ["name"])
    cat = spark.createDataFrame([("x", 1, 1), ("X", 2, 2)], ["cname", "id", "seq"])
    found, missing = rel.lookup_names(req, cat, "name", "cname", ["seq"])
    assert sorted(r["id"] for r in found.collect()) == [2, 2]
    assert [r["name"] for r in missing.collect()] == ["zz"]


def test_filter_expired(spark):
    df = spark.createDataFrame([(1, None), (2, NOW), (3, NOW - dt.timedelta(seconds=1))],
                               "id int, exp timestamp_ntz")
    out = project.filter_expired(df, "exp", F.lit(NOW).cast("timestamp_ntz"))
    assert [r["id"] for r in out.collect()] == [3]


def test_state_flags_read_error(spark):
    df = spark.createDataFrame([("Running", True)], ["s", "err"])
    r = df.select(status.state_flags("s", "err").alias("f")).select("f.*").first()
    assert (r.is_running, r.is_complete, r.is_succeeded, r.is_failed) == (False, True, False, False)


def test_intercept_base64_non_latin1_is_error(spark):
    df = spark.createDataFrame([(base64.b64encode(b"abc").decode(),)], ["b"])
    with pytest.raises(Exception):
        df.select(text.intercept_base64("b", lambda s: F.replace(s, F.lit("a"), F.lit("€")))).collect()
    ok = df.select(text.intercept_base64("b", lambda s: F.replace(s, F.lit("a"), F.lit("z")))).first()[0]
    assert base64.b64decode(ok) == b"zbc"


def test_base64_no_line_breaks(spark):
    df = spark.createDataFrame([("a" * 300,)], ["t"])
    v = df.select(text.text_to_base64("t")).first()[0]
    assert len(v) == 400 and "\r" not in v and "\n" not in v


def test_expand_schedule_cron(spark):
    s = spark.createDataFrame([(1, True, "Cron", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 4), "UTC", 60,
                                None, None)],
                              "id int, enabled boolean, type string, start timestamp_ntz, end timestamp_ntz, "
                              "tz string, interval int, times array<string>, weekdays array<string>")
    assert expand_schedule(s, "id").count() == 5


def test_expand_schedule_weekly_timezone(spark):
    s = spark.createDataFrame([(1, True, "Weekly", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 14, 23), "Central Standard Time",
                                None, ["10:00"], ["Monday"])],
                              "id int, enabled boolean, type string, start timestamp_ntz, end timestamp_ntz, "
                              "tz string, interval int, times array<string>, weekdays array<string>")
    rows = sorted(r["fire_utc"] for r in expand_schedule(s, "id").collect())
    assert rows == [dt.datetime(2024, 1, 1, 16), dt.datetime(2024, 1, 8, 16)]


def test_ordered_remap_fixture(spark):
    docs = spark.createDataFrame([(1, "B"), (2, "A")], ["seq", "text"])
    mp = spark.createDataFrame([(1, "A", "1"), (2, "B", "2")], ["seq", "old_id", "new_id"])
    out = {r["seq"]: r["text"] for r in rel.ordered_remap(docs, mp, "seq", "text").collect()}
    assert out == {1: "B", 2: "1"}


def test_ordered_remap_chain(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "A")], ["seq", "text"])
    mp = spark.createDataFrame([(1, "A", "Bq"), (2, "Bq", "C")], ["seq", "old_id", "new_id"])
    out = {r["seq"]: r["text"] for r in rel.ordered_remap(docs, mp, "seq", "text").collect()}
    assert out[3] == "C"


def test_csv_to_table_skips_bad_files(spark, tmp_dir):
    import os
    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/ok.csv", "w") as f:
        f.write("id,n\n1,a\n2,b\n")
    with open(f"{tmp_dir}/in/bad.csv", "w") as f:
        f.write("id,n\n3,c\nxx,d\n4,e,f\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("n", T.StringType())])
    out = csv_to_table(spark, f"{tmp_dir}/in", schema, staging=f"{tmp_dir}/stage")
    assert sorted((r.id, r.n) for r in out.collect()) == [(1, "a"), (2, "b")]


def test_require_columns_and_drop(spark):
    df = spark.createDataFrame([(1, "x")], ["a", "b"])
    with pytest.raises(project.MissingColumnError):
        project.require_columns(df, ["c"])
    assert project.drop_if_exists(df, "c").columns == ["a", "b"]


def test_valid_name_and_range_errors(spark):
    df = spark.createDataFrame([("Starter Pool",), ("ok name-1",), ("bad#",), ("   ",)], ["n"])
    assert [r[0] for r in df.select(validate.valid_name("n")).collect()] == [False, True, False, False]
    d2 = spark.createDataFrame([(0, 5), (3, 2)], ["a", "b"])
    errs = [r[0] for r in d2.select(validate.range_errors(F.col("a"), F.col("b"))).collect()]
    assert errs == [["Minimum node count must be at least 1"],
                    ["Minimum node count cannot be greater than maximum node count"]]


def test_interceptor_registry(spark):
    g = {"g1": {"type": "StringReplacement", "config": {"replacements": {"a": "b"}}},
         "loop": {"type": "Reference", "config": {"id": "loop"}}}
    f = documents.build_interceptor({"type": "Reference", "config": {"id": "g1"}}, g)
    df = spark.createDataFrame([("aa",)], ["t"])
    assert df.select(f(F.col("t"))).first()[0] == "bb"
    with pytest.raises(documents.InterceptorError):
        documents.build_interceptor({"type": "Reference", "config": {"id": "loop"}}, g)
    with pytest.raises(documents.InterceptorError):
        documents.build_interceptor({"type": "Nope"}, g)


def test_expand_schedule_window_clips_cron(spark):
    s = spark.createDataFrame([(1, True, "Cron", dt.datetime(2000, 1, 1), dt.datetime(2100, 1, 1), "UTC", 90,
                                None, None)],
                              "id int, enabled boolean, type string, start timestamp_ntz, end timestamp_ntz, "
                              "tz string, interval int, times array<string>, weekdays array<string>")
    out = sorted(r.fire_local for r in expand_schedule(s, "id", "2024-01-01 00:00:00", "2024-01-01 06:00:00")
                 .collect())
    # 2000-01-01 00:00 + k * 90 min is on the grid at 2024-01-01 00:00, then every 90 minutes
    assert out == [dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=90 * i) for i in range(5)]


def test_zone_names(spark):
    from lakeloom.functions.dates import known_zone
    z = spark.createDataFrame([("Cen. Australia Standard Time",), ("Asia/Tokyo",), ("Nowhere",), (None,)], "z string")
    assert [r[0] for r in z.select(known_zone(F.col("z"))).collect()] == ["Australia/Adelaide", "Asia/Tokyo", None, "UTC"]
