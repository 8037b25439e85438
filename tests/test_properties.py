
import base64

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.functions import text
from lakeloom.operators import relational as rel

texts = st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x2FF), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_replace_with_empty_map_is_identity(spark, values):
    df = spark.createDataFrame([(v,) for v in values], ["t"])
    assert [r[0] for r in df.select(text.replace_many("t", {})).collect()] == values


@settings(max_examples=15, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_base64_round_trip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], ["t"])
    out = df.select(text.text_to_base64("t").alias("b"))
    assert [base64.b64decode(r[0]).decode("utf-8") for r in out.collect()] == values
    back = out.select(F.decode(F.unbase64("b"), "UTF-8")).collect()
    assert [r[0] for r in back] == values


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet='ab _<>:"/|?*', max_size=30), min_size=1, max_size=5))
def test_sanitize_twice_is_once(spark, values):
    df = spark.createDataFrame([(v,) for v in values], ["t"])
    once = df.select(text.sanitize_name("t").alias("s"))
    twice = once.select(text.sanitize_name("s"))
    assert [r[0] for r in once.collect()] == [r[0] for r in twice.collect()]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "c", "Dd", "zz"]), min_size=1, max_size=8))
def test_found_plus_missing_is_requested(spark, names):
    req = spark.createDataFrame([(i, n) for i, n in enumerate(names)], ["i", "name"])
    cat = spark.createDataFrame([("A", 1, 1), ("b", 2, 2), ("C", 3, 3)], ["cname", "id", "seq"])
    found, missing = rel.lookup_names(req, cat, "name", "cname", ["seq"])
    assert found.count() + missing.count() == len(names)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["k1", "k2", "k3"]), st.integers(0, 1000)), min_size=1, max_size=30,
                unique_by=lambda x: x[1]))
def test_skew_safe_rank_matches_window(spark, rows):
    from pyspark.sql import Window as W
    df = spark.createDataFrame(rows, ["k", "o"])
    a = {(r.k, r.o): r.rn for r in rel.rank_within_groups(df, ["k"], ["o"], num_partitions=3).collect()}
    b = {(r.k, r.o): r.rn for r in df.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("o")))
         .collect()}
    assert a == b
