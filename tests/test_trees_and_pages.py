"""Whole-tree order, page chains and slices on literal cases and against plain loops."""

import random

from pyspark.sql import functions as F

from lakeloom.operators import relational as rel
from lakeloom.sources import tables


def test_tree_order_against_a_walk(spark):
    rng = random.Random(3)
    nodes = [(i, None if i % 9 == 0 else (0 if i % 3 else rng.randrange(i)), f"n{rng.randrange(30):02d}", rng.random() < 0.5) for i in range(300)]
    nodes += [(1000, 1001, "a", True), (1001, 1000, "b", True), (1002, 1001, "c", False), (1003, 5000, "orphan", False), (None, 0, "x", False)]
    below = {}
    for n in nodes:
        if n[0] is not None and n[0] not in (1000, 1001, 1002):
            below.setdefault(n[1] if n[1] != 5000 else None, []).append(n)
    want, size = [], {}

    def walk(parent, depth):
        first = len(want)
        for n in sorted(below.get(parent, []), key=lambda n: (not n[3], n[2], n[0])):
            at = len(want)
            want.append([n[0], depth, 0, at + 1])
            walk(n[0], depth + 1)
            want[at][2] = len(want) - at
        return len(want) - first

    walk(None, 1)
    df = spark.createDataFrame(nodes, "id long, parent long, name string, dir boolean")
    got = rel.tree_order(df, "id", "parent", "name", "dir").orderBy("position").collect()
    assert [[r.id, r.depth, r.size, r.position] for r in got] == want and not size
    assert rel.tree_order(df.limit(0), "id", "parent", "name", "dir").count() == 0


def test_page_chains(spark):
    pages = [("a", "b", 2), ("b", "c", 3), ("c", None, 1), ("c", None, 1),  # a page sent twice
             ("p", "q", 5), ("q", "lost", 1),  # leads nowhere
             ("x", "y", 1), ("y", "x", 1), ("z", "z", 1),  # circles
             ("one", "", 4), (None, "a", 9)]
    pages += [(f"l{i:03d}", f"l{i + 1:03d}" if i < 199 else None, i % 4) for i in range(200)]
    df = spark.createDataFrame(pages, "token string, following string, n long").repartition(5)
    got = {r.token: (r.chain, r.page_no, r.offset, r.chain_state) for r in tables.chain_pages(df, "token", "following", "n").collect()}
    want = {"a": ("a", 0, 0, "complete"), "b": ("a", 1, 2, "complete"), "c": ("a", 2, 5, "complete"), "p": ("p", 0, 0, "broken"), "q": ("p", 1, 5, "broken"),
            "x": (None, None, None, "circular"), "y": (None, None, None, "circular"), "z": (None, None, None, "circular"), "one": ("one", 0, 0, "complete")}
    want |= {f"l{i:03d}": ("l000", i, sum(j % 4 for j in range(i)), "complete") for i in range(200)}
    assert got == want
    assert tables.chain_pages(df.limit(0), "token", "following", "n").count() == 0


def test_slice_without_size_is_not_gathered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(1).alias("one"))
    out = rel.slice_rows(df, ["k"], 990, None)
    assert sorted(r.k for r in out.collect()) == list(range(990, 1000))
    assert rel.slice_rows(df, ["k"], 0, None).count() == 1000 and rel.slice_rows(df, ["k"], 5000, None).count() == 0
    assert [r.k for r in rel.slice_rows(df, ["k"], 3, 2).collect()] == [3, 4]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset" not in plan and "GlobalLimit" not in plan
