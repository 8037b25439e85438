"""Remapping ids: few ids are replaced where the texts are, many are joined with few of the texts' grams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import grams, relational

MAPS = "seq long, old_id string, new_id string"


@pytest.mark.parametrize("seed, limit", [(0, None), (1, None), (2, 0)])
def test_ids_apart_from_new_ids(spark, monkeypatch, seed, limit):
    """Overlapping ids of 1 to 20 bytes, some several times, in texts with nulls, empty ones and long characters."""
    if limit is not None:
        monkeypatch.setattr(relational, "ID_BROADCAST_ROWS", limit)
    monkeypatch.setattr(grams, "WINDOW", 16)
    monkeypatch.setattr(grams, "CALL_BYTES", 50)
    rng = random.Random(seed)
    word = lambda lo, hi: "".join(rng.choice("abé𝄞") for _ in range(rng.randint(lo, hi)))
    docs = [(None if i == 5 else i, None if i == 7 else word(0, 60), {"kept": str(i)}) for i in range(60)]
    maps = [(rng.randint(0, 50), word(1, 3) if i % 2 else word(4, 12), f"#{i}#") for i in range(40)]
    maps = list({m[0]: m for m in maps}.values())
    long = next(t for _, t, _ in docs[40:] if t and len(t) > 20)
    maps.append((30, long[3:15], "#long#")) if 30 not in [m[0] for m in maps] else None
    frame = spark.createDataFrame(docs, "i long, t string, m map<string,string>").repartition(3)
    got = relational.ordered_remap(frame, spark.createDataFrame(maps, MAPS), "i", "t")
    assert got.columns == ["i", "t", "m"]
    seen = {r.m["kept"]: r.t for r in got.collect()}
    assert len(seen) == len(docs)
    for n, (i, t, _) in enumerate(docs):
        for s, a, b in sorted(maps):
            if i is not None and t is not None and s < i:
                t = t.replace(a, b)
        assert seen[str(n)] == t


def test_few_ids_shuffle_no_text(spark):
    docs = spark.range(2000).select("id", F.lit("see abcd and efgh").alias("t")).repartition(8)
    maps = spark.createDataFrame([(1, "abcd", "#1#"), (2, "efgh", "#2#")], MAPS)
    out = relational.ordered_remap(docs, maps, "id", "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Aggregate" not in plan
    assert out.where("t = 'see #1# and #2#'").count() == 1997


def test_texts_are_read_for_their_grams_once(spark, monkeypatch):
    """Mappings of one place in order replace nothing that another brought: no round follows the first."""
    calls = []
    own = grams.Known.found
    monkeypatch.setattr(grams.Known, "found", lambda *a: calls.append(1) or own(*a))
    docs = spark.createDataFrame([(i, f"owner cust-{i:08d}.") for i in range(300)], "i long, t string")
    maps = spark.range(300).select(F.lit(1).alias("seq"), F.format_string("cust-%08d", "id").alias("old_id"), F.format_string("{{Customer#%09d}}", "id").alias("new_id"))
    got = relational.ordered_remap(docs, maps, "i", "t", ordered=False)
    assert sorted(r.t for r in got.collect()) == [f"owner {{{{Customer#{i:09d}}}}}." for i in range(300)] and len(calls) == 1


def test_filter_drops_other_grams(spark):
    index = spark.range(5000).select(F.xxhash64("id").alias("__g"))
    known = grams.Known.of(index, "__g", 5000, [4])
    have = index.toArrow().column("__g").to_numpy().view(np.uint64)
    low = lambda k: k & np.uint64((1 << known.power) - 1)
    both = lambda k: known._has(k >> np.uint64(64 - known.power)) & known._has(low(k))
    assert both(have).all() and both(np.random.default_rng(0).integers(0, 1 << 63, 100_000, dtype=np.uint64) * np.uint64(2)).mean() < 0.03


def test_ids_grams_are_not_joined(spark, monkeypatch):
    """An id's gram is chosen where the id is read: no row for each gram of an id, and no join of them with their counts."""
    seen, own = [], relational.cut_lineage

    def cut(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        seen.append((plan, own(df)))
        return seen[-1][1]

    monkeypatch.setattr(relational, "cut_lineage", cut)
    docs = spark.createDataFrame([(i, f"owner cust-{i:08d}.") for i in range(300)], "i long, t string")
    maps = spark.range(300).select(F.lit(1).alias("seq"), F.format_string("cust-%08d", "id").alias("old_id"), F.format_string("{{Customer#%09d}}", "id").alias("new_id"))
    got = relational.ordered_remap(docs, maps, "i", "t", ordered=False)
    assert sorted(r.t for r in got.collect()) == [f"owner {{{{Customer#{i:09d}}}}}." for i in range(300)]
    index = next(d for _, d in seen if "__g" in d.columns)
    assert not any("Join" in plan for plan, d in seen if "__g" in d.columns)
    # the prefix that all ids share is nobody's gram
    assert index.count() == 300 and index.groupBy("__g").count().agg(F.max("count")).first()[0] == 1


def test_rarest_gram_of_an_id(spark):
    """First places in bytes, ids of all lengths, a gram twice in an id, counts that are shared by few counters."""
    ids = ["a", "é", "abcabcabcabc", "xxxxxxxxxxxx", "common-000001", "common-000002", "𝄞𝄞𝄞"]
    df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "o string, n int")
    sizes = sorted({min(len(i.encode()), 8) for i in ids})
    counts = grams.counted(df.select("o"), "o", len(ids), sizes)
    assert counts.sum() == sum(len(i.encode()) - min(len(i.encode()), 8) + 1 for i in ids)
    for table in (counts, np.zeros(4096, np.int32)):
        got = {r.o: r for r in grams.rarest(df, "o", table, sizes).collect()}
        assert sorted(got) == sorted(ids) and all(ids[r.n] == o for o, r in got.items())
        for o, r in got.items():
            data, k = np.frombuffer(o.encode(), np.uint8), min(len(o.encode()), 8)
            keys = next(v for _, size, v in grams._runs(data, [k]) if size == k)[: len(data) - k + 1].view(np.int64)
            assert r["__at"] == int(np.flatnonzero(keys == r["__g"])[0])
    got = {r.o: r["__at"] for r in grams.rarest(df, "o", counts, sizes).collect()}
    assert got["common-000001"] == 5 and got["common-000002"] == 5
    assert grams.rarest(df.limit(0), "o", counts, sizes).count() == 0
