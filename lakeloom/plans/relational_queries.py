"""Registered queries for filters, joins, aggregates, windows, sorts, limits,
set operations and access rules (PRJ, FLT, JN, AGG, WIN, SRT, LIM, SET, ACL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import status, text
from ..operators import access, project, relational as rel
from .registry import query, table
from .scalar_queries import EVENT_JOB_STATUS, host_col, upath_col
from .sqlfrag import DEPLOYMENT_STATUS, HOST, JOB_STATUS, UPATH

NOW = "2024-01-30 12:00:00"

# ---------------------------------------------------------------- PRJ-2 / PRJ-4 / PRJ-5


@query("drop_result", sql="SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def q_drop_result(spark, sf):
    o = table(spark, sf, "orders")
    return project.drop_if_exists(project.drop_if_exists(o, "o_orderpriority"), "not_there")


@query("append_result", sql="""
SELECT doc_id, lang, source, CAST(length(text) AS INTEGER) AS result FROM documents
""")
def q_append_result(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    scored = d.withColumn("result", F.length("text"))
    return project.append_result(scored, ["doc_id", "lang", "source"], "result")


@query("merge_metadata", sql="""
SELECT d.doc_id, COALESCE(CASE WHEN l.quality = 1 THEN 'good' END, d.lang) AS lang,
       COALESCE(CASE WHEN l.toxic = 1 THEN 'flagged' END, d.source) AS source
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def q_merge_metadata(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    lab = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "good").alias("lang"),
        F.when(F.col("toxic") == 1, "flagged").alias("source"))
    return project.merge_metadata(d, lab, "doc_id", ["lang", "source"])


# ---------------------------------------------------------------- FLT-1 .. FLT-9
@query("filter_eq", sql="SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def q_filter_eq(spark, sf):
    return project.filter_eq(table(spark, sf, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name")


@query("filter_eq_ci", sql="SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = 'building'")
def q_filter_eq_ci(spark, sf):
    return project.filter_eq(table(spark, sf, "customer"), "c_mktsegment", "Building", ignore_case=True) \
        .select("c_custkey", "c_name")


@query("search_name", sql="SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def q_search_name(spark, sf):
    return project.search_name(table(spark, sf, "part"), "p_name", "RING").select("p_partkey", "p_name")


@query("search_any", sql="""
SELECT p_partkey FROM part
WHERE contains(lower(p_name), 'gear') OR contains(lower(COALESCE(p_brand, CAST(p_partkey AS VARCHAR), '')), 'gear')
   OR contains(lower(p_type), 'gear')
""")
def q_search_any(spark, sf):
    p = table(spark, sf, "part")
    return project.search_any(p, ["p_name", F.coalesce("p_brand", F.col("p_partkey").cast("string"), F.lit("")),
                                  "p_type"], "Gear").select("p_partkey")


@query("filter_variant", sql="""
SELECT event_id FROM events WHERE event_type = 'click' AND value > 100
""")
def q_filter_variant(spark, sf):
    e = table(spark, sf, "events")
    et = F.col("event_type")
    target = F.struct(
        F.when(et == "click", F.struct(F.col("value").alias("size"), F.col("props").alias("path"))).alias("lake"),
        F.when(et == "view", F.struct(F.col("value").alias("size"))).alias("objectStore"))
    u = e.select("event_id", target.alias("target"))
    return project.filter_variant(u, "target", "lake", F.col("target.lake.size") > 100).select("event_id")


@query("filter_array_any", sql="""
SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the')
""")
def q_filter_array_any(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return project.filter_array_any(d, "words", "the").select("doc_id")


@query("filter_array_contains", sql="""
SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ' '), lambda w: contains(w, 'oux'))) > 0
""")
def q_filter_array_contains(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return project.filter_array_any(d, "words", "oux", mode="contains").select("doc_id")


@query("filter_expired", sql=f"""
SELECT o_orderkey FROM orders
WHERE (CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END) < TIMESTAMP '1998-01-01 00:00:00'
""")
def q_filter_expired(spark, sf):
    o = table(spark, sf, "orders").withColumn(
        "expires", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return project.filter_expired(o, "expires", rel.now_lit("1998-01-01 00:00:00")).select("o_orderkey")


@query("exclude_types", sql="SELECT event_id FROM events WHERE event_type NOT IN ('error', 'signup')")
def q_exclude_types(spark, sf):
    return project.exclude_types(table(spark, sf, "events"), "event_type", ["error", "signup"]).select("event_id")


@query("filter_extension", sql=f"""
SELECT page_id FROM pages
WHERE '.' || lower(string_split({UPATH}, '.')[-1]) IN ({", ".join("'" + x + "'" for x in text.ACCEPTED_FILE_TYPES)})
""")
def q_filter_extension(spark, sf):
    p = table(spark, sf, "pages").withColumn("up", upath_col())
    return project.filter_extension(p, "up", text.ACCEPTED_FILE_TYPES).select("page_id")


@query("filter_open", sql="""
SELECT o_orderkey FROM orders
WHERE o_orderpriority <> '5-LOW'
  AND (CASE o_orderstatus WHEN 'F' THEN 'Succeeded' WHEN 'P' THEN 'Pending' ELSE 'InProgress' END)
      NOT IN ('Succeeded', 'Failed', 'Cancelled')
""")
def q_filter_open(spark, sf):
    o = table(spark, sf, "orders")
    d = o.select("o_orderkey",
                 F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey")).alias("job_id"),
                 F.when(F.col("o_orderstatus") == "F", "Succeeded").when(F.col("o_orderstatus") == "P", "Pending")
                 .otherwise("InProgress").alias("status"))
    return project.filter_open(d, "job_id", "status").select("o_orderkey")


# ---------------------------------------------------------------- JN-1
@query("match_first", sql="""
SELECT c.c_custkey, f.o_orderkey, f.o_totalprice
FROM customer c LEFT JOIN (
  SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice
  FROM orders GROUP BY o_custkey) f ON c.c_custkey = f.o_custkey
""")
def q_match_first(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rel.match_first(c, o, "c_custkey", "o_custkey", ["o_orderkey"]).select(
        "c_custkey", "o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- JN-2
_REQ = ("CASE WHEN c_acctbal > 0 THEN 'nation_' || CAST(c_nationkey AS VARCHAR) "
        "ELSE 'NATION_' || CAST(c_nationkey + 25 AS VARCHAR) END")


def _lookup(spark, sf):
    c = table(spark, sf, "customer")
    req = c.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.concat(F.lit("nation_"), F.col("c_nationkey")))
                   .otherwise(F.concat(F.lit("NATION_"), (F.col("c_nationkey") + 25).cast("string"))).alias("name"))
    n = table(spark, sf, "nation")
    cat = n.select(F.col("n_name").alias("cname"), F.col("n_nationkey").cast("long").alias("id"),
                   F.col("n_nationkey").cast("long").alias("seq")).unionByName(
        n.select(F.lower("n_name").alias("cname"), (F.col("n_nationkey") + 100).cast("long").alias("id"),
                 (F.col("n_nationkey") + 100).cast("long").alias("seq")))
    return rel.lookup_names(req, cat, "name", "cname", ["seq"])


@query("lookup_found", sql=f"""
SELECT c_custkey, {_REQ} AS name, CAST(n_nationkey + 100 AS BIGINT) AS id, CAST(n_nationkey + 100 AS BIGINT) AS seq
FROM customer JOIN nation ON lower({_REQ}) = lower(n_name)
""")
def q_lookup_found(spark, sf):
    return _lookup(spark, sf)[0]


@query("lookup_missing", sql=f"""
SELECT c_custkey, {_REQ} AS name FROM customer
WHERE lower({_REQ}) NOT IN (SELECT lower(n_name) FROM nation)
""")
def q_lookup_missing(spark, sf):
    return _lookup(spark, sf)[1]


# ---------------------------------------------------------------- JN-3 / JN-4 / JN-5 / ACL-1
_T = f"({HOST} || {UPATH})"


def _access_rules(spark, sf):
    p = table(spark, sf, "pages")
    seg1 = F.split(F.regexp_replace(upath_col(), "^/", ""), "/").getItem(0)
    lang_rules = p.where(seg1 != "").select(F.concat(F.lit("lang_"), seg1).alias("role"),
                                            F.concat(host_col(), F.lit("/"), seg1).alias("path"))
    sub_rules = p.select(F.concat(F.lit("sub_"), F.substring_index(host_col(), ".", 1)).alias("role"),
                         F.concat(F.substring_index(host_col(), ".", 1), F.lit(".")).alias("path"))
    admin = spark.range(1).select(F.lit("admin").alias("role"), F.lit("*").alias("path"))
    return lang_rules.unionByName(sub_rules).unionByName(admin).distinct() \
        .withColumn("action", F.lit("Read"))


_RULES_SQL = f"""
rules AS (
  SELECT DISTINCT role, path FROM (
    SELECT 'lang_' || split_part(ltrim({UPATH}, '/'), '/', 1) AS role,
           {HOST} || '/' || split_part(ltrim({UPATH}, '/'), '/', 1) AS path
    FROM pages WHERE split_part(ltrim({UPATH}, '/'), '/', 1) <> ''
    UNION ALL SELECT 'sub_' || split_part({HOST}, '.', 1), split_part({HOST}, '.', 1) || '.' FROM pages
    UNION ALL SELECT 'admin', '*')),
targets AS (SELECT page_id, {_T} AS t FROM pages)"""


@query("path_access", sql=f"""
WITH {_RULES_SQL}
SELECT DISTINCT r.role, t.page_id FROM rules r JOIN targets t
  ON r.path = '*' OR t.t = r.path OR starts_with(t.t, r.path)
""")
def q_path_access(spark, sf):
    rules = _access_rules(spark, sf)
    targets = table(spark, sf, "pages").select("page_id", F.concat(host_col(), upath_col()).alias("t"))
    return access.path_access(rules, targets, "t").select("role", "page_id").distinct()


@query("path_access_normalized", sql=f"""
WITH {_RULES_SQL}
SELECT DISTINCT r.role, t.page_id FROM rules r JOIN targets t
  ON r.path = '*' OR regexp_replace(t.t, '^/+', '') = regexp_replace(regexp_replace(r.path, '^/+', ''), '/\\*$', '')
  OR starts_with(regexp_replace(t.t, '^/+', ''), regexp_replace(regexp_replace(r.path, '^/+', ''), '/\\*$', '') || '/')
""")
def q_path_access_normalized(spark, sf):
    rules = _access_rules(spark, sf)
    targets = table(spark, sf, "pages").select("page_id", F.concat(host_col(), upath_col()).alias("t"))
    return access.path_access(rules, targets, "t", normalize=True).select("role", "page_id").distinct()


@query("member_roles", sql="SELECT DISTINCT 'conv_' || CAST(conv_id AS VARCHAR) AS role FROM conversations "
                           "WHERE role = 'system'")
def q_member_roles(spark, sf):
    c = table(spark, sf, "conversations")
    members = c.select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("role_name"),
                       F.col("role").alias("member"))
    return access.member_roles(members, "member", "role_name", "system").select(F.col("role_name").alias("role"))


@query("effective_access", sql=f"""
WITH {_RULES_SQL},
members AS (SELECT DISTINCT role, CASE WHEN role = 'admin' THEN 'alice'
                                       WHEN starts_with(role, 'lang_') THEN 'team_' || substr(role, 6)
                                       ELSE 'ops' END AS principal FROM rules)
SELECT DISTINCT m.principal, t.page_id, 'Read' AS action
FROM rules r JOIN targets t ON r.path = '*' OR t.t = r.path OR starts_with(t.t, r.path)
JOIN members m ON m.role = r.role
""")
def q_effective_access(spark, sf):
    rules = _access_rules(spark, sf)
    members = rules.select("role").distinct().select(
        "role", F.when(F.col("role") == "admin", "alice")
        .when(F.col("role").startswith("lang_"), F.concat(F.lit("team_"), F.substring("role", 6, 1000)))
        .otherwise("ops").alias("principal"))
    targets = table(spark, sf, "pages").select("page_id", F.concat(host_col(), upath_col()).alias("t"))
    return access.effective_access(rules, members, targets, "t", "page_id")


@query("build_rules", sql="""
SELECT DISTINCT role, path, action FROM (
  SELECT p_name || 'Reader' AS role, '/Tables/' || p_name AS path, 'Read' AS action FROM part
  UNION ALL SELECT replace(p_type || '/' || p_brand, '/', '_') || 'Reader', '/' || p_type || '/' || p_brand, 'Read'
    FROM part
  UNION ALL SELECT replace(p_type || '/' || p_brand, '/', '_') || 'Reader', '/' || p_type || '/' || p_brand || '/*',
    'Read' FROM part
  UNION ALL SELECT 'DefaultReader', '*', 'Read')
""")
def q_build_rules(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(F.lit("table").alias("kind"), F.col("p_name").alias("name")).unionByName(
        p.select(F.lit("folder").alias("kind"), F.concat("p_type", F.lit("/"), "p_brand").alias("name"))).unionByName(
        spark.range(1).select(F.lit("default").alias("kind"), F.lit(None).cast("string").alias("name")))
    return access.read_role_rows(names, "kind", "name").select("role", "path", "action").distinct()


@query("custom_roles", sql="""
WITH r AS (SELECT p_brand AS role, '/' || p_type AS path, CASE WHEN p_size % 2 = 0 THEN ['Read'] ELSE ['Read', 'ReadWrite'] END AS actions FROM part),
a AS (SELECT role, path, unnest(actions) AS action FROM r)
SELECT DISTINCT role, 'Permit' AS effect, path, action FROM a
UNION ALL SELECT DISTINCT p_brand || 'Empty', 'Permit', '', '' FROM part WHERE false
""")
def q_custom_roles(spark, sf):
    """ACL-1: custom roles, each path of a role with each of its actions; roles with an empty list permit nothing."""
    p = table(spark, sf, "part")
    actions = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Read"))).otherwise(F.array(F.lit("Read"), F.lit("ReadWrite"), F.lit("Read")))
    roles = p.groupBy(F.col("p_brand").alias("role"), actions.alias("actions")).agg(F.collect_set(F.concat(F.lit("/"), "p_type")).alias("paths"))
    empty = p.select(F.concat("p_brand", F.lit("Empty")).alias("role"), actions.alias("actions"), F.array().cast("array<string>").alias("paths"))
    return access.custom_role_rows(roles.unionByName(empty)).distinct()


# ---------------------------------------------------------------- JN-6 / SRT-1 / JN-7
def _listing(spark, sf):
    p = table(spark, sf, "pages")
    segs = F.filter(F.split(upath_col(), "/"), lambda s: s != "")
    files = p.select(F.concat_ws("/", host_col(), F.array_join(segs, "/")).alias("path"),
                     F.lit(False).alias("isDirectory"))
    dirs = (p.where(F.size(segs) > 1)
            .select(F.concat_ws("/", host_col(), segs.getItem(0)).alias("path"), F.lit(True).alias("isDirectory"))
            .unionByName(p.where(host_col().startswith("blog."))
                         .select(host_col().alias("path"), F.lit(True).alias("isDirectory"))))
    return files.unionByName(dirs).distinct()


_LISTING_SQL = f"""
listing AS (
  SELECT DISTINCT path, is_dir FROM (
    SELECT concat_ws('/', {HOST}, nullif(array_to_string(list_filter(string_split({UPATH}, '/'), lambda s: s <> ''), '/'), ''))
             AS path, false AS is_dir FROM pages
    UNION ALL SELECT {HOST} || '/' || list_filter(string_split({UPATH}, '/'), lambda s: s <> '')[1], true FROM pages
      WHERE len(list_filter(string_split({UPATH}, '/'), lambda s: s <> '')) > 1
    UNION ALL SELECT {HOST}, true FROM pages WHERE starts_with({HOST}, 'blog.'))),
withp AS (
  SELECT path, is_dir,
    CASE WHEN len(list_filter(string_split(path, '/'), lambda s: s <> '')) > 1 THEN
      array_to_string(list_filter(string_split(path, '/'), lambda s: s <> '')[1:len(list_filter(string_split(path, '/'), lambda s: s <> '')) - 1], '/')
    END AS pp,
    list_filter(string_split(path, '/'), lambda s: s <> '')[-1] AS name
  FROM listing)"""


@query("tree_parent", sql=f"""
WITH {_LISTING_SQL}
SELECT w.path, w.is_dir AS isDirectory, f.path AS parent
FROM withp w LEFT JOIN (SELECT DISTINCT path FROM listing WHERE is_dir) f ON w.pp = f.path
""")
def q_tree_parent(spark, sf):
    return rel.link_parents(_listing(spark, sf)).select("path", "isDirectory", "parent")


@query("tree_rank", sql=f"""
WITH {_LISTING_SQL},
linked AS (SELECT w.path, w.is_dir, w.name, f.path AS parent
           FROM withp w LEFT JOIN (SELECT DISTINCT path FROM listing WHERE is_dir) f ON w.pp = f.path)
SELECT path, parent, CAST(row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN is_dir THEN 0 ELSE 1 END,
       name, path) AS BIGINT) AS rank
FROM linked
""")
def q_tree_rank(spark, sf):
    linked = rel.link_parents(_listing(spark, sf))
    named = linked.withColumn("name", F.try_element_at(F.filter(F.split("path", "/"), lambda s: s != ""), F.lit(-1)))
    return rel.tree_rank(named, "parent", "name", "isDirectory", tie=["path"]).select("path", "parent", "rank")


@query("tree_order", sql=f"""
WITH RECURSIVE {_LISTING_SQL},
linked AS (SELECT w.path, w.is_dir, w.name, f.path AS parent
           FROM withp w LEFT JOIN (SELECT DISTINCT path FROM listing WHERE is_dir) f ON w.pp = f.path),
nodes AS (SELECT path, any_value(parent) AS parent, bool_or(is_dir) AS is_dir, any_value(name) AS name FROM linked GROUP BY path),
ranked AS (SELECT path, parent, row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN is_dir THEN 0 ELSE 1 END, name, path) AS rank FROM nodes),
walk(path, way, depth) AS (SELECT path, [rank], 1 FROM ranked WHERE parent IS NULL
  UNION ALL SELECT r.path, list_append(walk.way, r.rank), depth + 1 FROM walk JOIN ranked r ON r.parent = walk.path)
SELECT w.path, w.depth, CAST((SELECT count(*) FROM walk b WHERE list_slice(b.way, 1, w.depth) = w.way) AS BIGINT) AS size,
       CAST(row_number() OVER (ORDER BY w.way) AS BIGINT) AS position FROM walk w
""")
def q_tree_order(spark, sf):
    linked = rel.link_parents(_listing(spark, sf))
    nodes = linked.groupBy("path").agg(F.min("parent").alias("parent"), F.max("isDirectory").alias("isDirectory"))
    named = nodes.withColumn("name", F.try_element_at(F.filter(F.split("path", "/"), lambda s: s != ""), F.lit(-1)))
    return rel.tree_order(named, "path", "parent", "name", "isDirectory")


@query("ancestor_path", sql="""
SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, r_name || '/' || n_name || '/' || c_name AS path,
       3 AS depth, false AS truncated
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'n' || CAST(n_nationkey AS VARCHAR), r_name || '/' || n_name, 2, false
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), r_name, 1, false FROM region
""")
def q_ancestor_path(spark, sf):
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"),
                                          F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
                                          F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"),
                                          F.col("n_name").alias("name"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
                                            F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"),
                                            F.col("c_name").alias("name"))
    return rel.ancestor_path(r.unionByName(n).unionByName(c), "id", "parent", "name")


# ---------------------------------------------------------------- JN-8 / JN-9
@query("merge_updates", sql="""
SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1.0 ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority
FROM orders
""")
def q_merge_updates(spark, sf):
    o = table(spark, sf, "orders")
    upd = o.where(F.col("o_orderstatus") == "O").withColumn("o_orderstatus", F.lit("F")) \
        .withColumn("o_totalprice", F.col("o_totalprice") + 1.0)
    return rel.merge_updates(o, upd, "o_orderkey")


@query("exists_semi", sql="SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def q_exists_semi(spark, sf):
    return rel.exists_in(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey") \
        .select("c_custkey")


@query("empty_anti", sql="""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
""")
def q_empty_anti(spark, sf):
    f = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    return rel.exists_in(table(spark, sf, "customer"), f, "c_custkey", "o_custkey", negate=True).select("c_custkey")


# ---------------------------------------------------------------- JN-10
_WORD3 = "lower(regexp_extract(text, '^[^A-Za-z]*[A-Za-z]+[^A-Za-z]+[A-Za-z]+[^A-Za-z]+([A-Za-z]+)', 1))"


@query("ordered_remap", sql=f"""
WITH m AS (SELECT doc_id AS seq, {_WORD3} AS old_id, '#' || CAST(doc_id AS VARCHAR) || '#' AS new_id
           FROM documents WHERE length({_WORD3}) >= 4),
pairs AS (SELECT d.doc_id, list(struct_pack(o := m.old_id, n := m.new_id) ORDER BY m.seq) AS reps
          FROM documents d JOIN m ON m.seq < d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, COALESCE(list_reduce(p.reps, lambda acc, r: replace(acc, r.o, r.n), d.text), d.text) AS text
FROM documents d LEFT JOIN pairs p USING (doc_id)
""")
def q_ordered_remap(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    word3 = F.lower(F.regexp_extract("text", r"^[^A-Za-z]*[A-Za-z]+[^A-Za-z]+[A-Za-z]+[^A-Za-z]+([A-Za-z]+)", 1))
    mapping = d.select(F.col("doc_id").alias("seq"), word3.alias("old_id"),
                       F.concat(F.lit("#"), F.col("doc_id").cast("string"), F.lit("#")).alias("new_id")) \
        .where(F.length("old_id") >= 4)
    return rel.ordered_remap(d, mapping, "doc_id", "text")


# ---------------------------------------------------------------- AGG-1 .. AGG-6
@query("row_count", sql="SELECT CAST(count(*) AS BIGINT) AS n FROM documents")
def q_row_count(spark, sf):
    return rel.row_count(table(spark, sf, "documents"))


_SCHEMA = "CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_brand END"


def _tables(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("schema"),
                    F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("name"),
                    F.col("p_partkey").alias("pos"))


@query("group_tables", sql=f"""
SELECT {_SCHEMA} AS schema, CAST(count(*) AS BIGINT) AS n_tables,
       arg_min(p_name || '#' || CAST(p_partkey AS VARCHAR), p_partkey) AS first_table,
       arg_max(p_name || '#' || CAST(p_partkey AS VARCHAR), p_partkey) AS last_table
FROM part GROUP BY 1
""")
def q_group_tables(spark, sf):
    return rel.summarize_tables(_tables(spark, sf), "schema", "name", "pos")


@query("group_tables_order", sql=f"""
SELECT {_SCHEMA} AS schema, p_name || '#' || CAST(p_partkey AS VARCHAR) AS name,
       CAST(row_number() OVER (PARTITION BY {_SCHEMA} ORDER BY p_partkey) AS BIGINT) AS position
FROM part
""")
def q_group_tables_order(spark, sf):
    return rel.group_tables(_tables(spark, sf), "schema", "name", "pos")[0].select("schema", "name", "position")


@query("status_fold", sql=f"""
WITH j AS (SELECT user_id, ts, {DEPLOYMENT_STATUS} AS st FROM events WHERE value < 400),
f AS (SELECT user_id,
        COALESCE(arg_max(st, ts) FILTER (WHERE st IN ('Failed', 'Cancelled')),
                 arg_max(st, ts) FILTER (WHERE st IN ('Pending', 'InProgress')), 'Succeeded') AS fold
      FROM j GROUP BY user_id),
d AS (SELECT user_id, CAST(count(DISTINCT event_type) AS BIGINT) AS deployed, CAST(5 AS BIGINT) AS expected,
             max(ts) AS end_ts FROM events GROUP BY user_id)
SELECT d.user_id, COALESCE(f.fold, 'Succeeded') AS fold,
  CASE WHEN COALESCE(f.fold, 'Succeeded') = 'Succeeded' AND d.deployed = d.expected THEN 'Succeeded'
       WHEN d.end_ts + INTERVAL 10 MINUTE > TIMESTAMP '{NOW}' THEN 'InProgress' ELSE 'Failed' END AS status
FROM d LEFT JOIN f USING (user_id)
""")
def q_status_fold(spark, sf):
    e = table(spark, sf, "events")
    jobs = e.select("user_id", "ts", text.map_lookup(F.col("event_type"), EVENT_JOB_STATUS).alias("job_status"),
                    F.when(F.col("value") >= 400, "IgnoreErrors").otherwise("FailOnError").alias("policy"))
    deps = e.groupBy("user_id").agg(F.countDistinct("event_type").alias("deployed"),
                                    F.lit(5).cast("long").alias("expected"), F.max("ts").alias("end_ts"))
    out = rel.status_fold(jobs, "user_id", "job_status", "ts", "policy", deps, "expected", "deployed", "end_ts",
                          rel.now_lit(NOW))
    return out.select("user_id", "fold", "status")


@query("any_status", sql="""
SELECT o_custkey, bool_or(o_orderstatus IN ('O', 'P')) AS any_match,
       arg_min(o_orderpriority, o_orderkey) = '1-URGENT' AS first_has
FROM orders GROUP BY o_custkey
""")
def q_any_status(spark, sf):
    o = table(spark, sf, "orders")
    a = rel.any_status(o, "o_custkey", "o_orderstatus", ["O", "P"])
    f = rel.first_has(o.withColumn("urgent", F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("yes"))),
                      "o_custkey", "urgent", ["o_orderkey"])
    return a.join(f, "o_custkey")


@query("outcome_split", sql="""
SELECT user_id, CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS n_ok,
       CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS n_failed,
       min(event_id) FILTER (WHERE event_type = 'error') AS first_failed
FROM events GROUP BY user_id
""")
def q_outcome_split(spark, sf):
    e = table(spark, sf, "events")
    return rel.outcome_split(e, "user_id", F.col("event_type") != "error", "event_id")[0]


@query("scope_union", sql="""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word,
                  unnest(range(1, len(string_split(text, ' ')) + 1)) AS pos FROM documents)
SELECT word, CAST(arg_min(doc_id, doc_id * 100000 + pos) AS BIGINT) AS first_doc,
       CAST(arg_min(pos, doc_id * 100000 + pos) AS INTEGER) AS first_pos
FROM w GROUP BY word
""")
def q_scope_union(spark, sf):
    d = table(spark, sf, "documents")
    u = rel.union_words(d, "text", ["doc_id"])
    return u.select("word", F.col("first_seen.doc_id").alias("first_doc"), F.col("first_pos").cast("int"))


# ---------------------------------------------------------------- WIN-1 .. WIN-3
@query("first_per_key", sql="""
SELECT user_id, arg_min(event_id, ts) AS event_id, arg_min(event_type, ts) AS event_type FROM events GROUP BY user_id
""")
def q_first_per_key(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return rel.first_per_key(e, "user_id", ["ts"]).select("user_id", "event_id", "event_type")


@query("last_per_key", sql="""
SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id
""")
def q_last_per_key(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return rel.last_per_key(e, "user_id", ["ts"]).select("user_id", "event_id", "event_type")


@query("running_progress", sql="""
SELECT o_custkey, o_orderkey,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS item_no,
  CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS n_items,
  30.0 + (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 70.0
       / count(*) OVER (PARTITION BY o_custkey) AS progress
FROM orders
""")
def q_running_progress(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return rel.running_progress(o, "o_custkey", ["o_orderkey"]).select(
        "o_custkey", "o_orderkey", "item_no", F.col("n_items").cast("long"), "progress")


@query("latest_state", sql=f"""
SELECT user_id, arg_max({JOB_STATUS}, ts) AS state, max(ts) AS ts FROM events GROUP BY user_id
""")
def q_latest_state(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", text.map_lookup(F.col("event_type"), EVENT_JOB_STATUS)
                                          .alias("state"))
    return rel.latest_state(e, "user_id", "ts", "state")


# ---------------------------------------------------------------- LIM-1 .. LIM-3
@query("limit_n", sql="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
""")
def q_limit_n(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rel.limit_n(o, [F.desc("o_totalprice"), "o_orderkey"], 10)


@query("slice_log", sql="SELECT event_id, ts FROM events ORDER BY ts LIMIT 50 OFFSET 100")
def q_slice_log(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return rel.slice_rows(e, ["ts"], 100, 50)


@query("slice_from", sql="SELECT event_id, ts FROM events ORDER BY ts OFFSET 100")
def q_slice_from(spark, sf):
    return rel.slice_rows(table(spark, sf, "events").select("event_id", "ts"), ["ts"], 100, None)


@query("preview", sql="SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 5")
def q_preview(spark, sf):
    return rel.preview(table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"])


# ---------------------------------------------------------------- SET-1 .. SET-3
@query("union_all", sql="""
SELECT c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier
""")
def q_union_all(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return rel.concat_frames([c, s])


@query("union_distinct", sql="SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def q_union_distinct(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("k"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"))
    return rel.union_distinct(n, r)


@query("except_distinct", sql="""
SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
""")
def q_except_distinct(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    s = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("k"))
    return rel.difference(c, s, keep_duplicates=False)


@query("except_keep", sql="""
SELECT o_orderkey, o_custkey AS k FROM orders
WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def q_except_keep(spark, sf):
    c = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    s = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("k"))
    return rel.difference(c, s, keys=["k"])
