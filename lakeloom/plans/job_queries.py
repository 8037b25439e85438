"""Registered composite-job queries (JOB-1 .. JOB-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import format_log, map_lookup
from ..operators.relational import now_lit, summarize_tables
from .jobs import catalog_inventory, catalog_tree, deployment_report, log_analytics, text_enrichment
from .registry import query, table
from .relational_queries import NOW
from .scalar_queries import EVENT_JOB_STATUS
from .sqlfrag import DEPLOYMENT_STATUS, HOST, UPATH

_TOKENS = "regexp_split_to_array(lower(text), '[^a-z]+')"
_POS = (f"CAST(len(list_filter({_TOKENS}, lambda x: x IN ('good', 'great', 'excellent', "
        "'wonderful', 'fantastic', 'perfect', 'best', 'beautiful', 'brilliant', 'love', 'loved', 'enjoy', 'enjoyed', "
        "'happy', 'pleased', 'nice', 'friendly', 'helpful', 'easy', 'reliable', 'recommend'))) AS BIGINT)")
_NEG = (f"CAST(len(list_filter({_TOKENS}, lambda x: x IN ('bad', 'worse', 'worst', 'terrible', "
        "'awful', 'horrible', 'poor', 'ugly', 'hate', 'hated', 'sad', 'angry', 'unhappy', 'disappointing', 'broken', "
        "'slow', 'useless', 'unreliable', 'wrong', 'fail', 'failed'))) AS BIGINT)")


@query("text_enrichment", sql=f"""
SELECT doc_id, text, lang, source, n_chars,
       CASE WHEN {_POS} > {_NEG} THEN 'positive'
            WHEN {_NEG} > {_POS} THEN 'negative'
            WHEN {_POS} > 0 THEN 'mixed' ELSE 'neutral' END AS sentiment
FROM documents
""")
def q_text_enrichment(spark, sf_dir):
    """JOB-1 on documents: score every full text, append ``sentiment``."""
    return text_enrichment(table(spark, sf_dir, "documents"), "text", "sentiment")


# ---------------------------------------------------------------- JOB-3
def _listing(spark, sf):
    from .scalar_queries import host_col, upath_col
    p = table(spark, sf, "pages")
    segs = F.filter(F.split(upath_col(), "/"), lambda s: s != "")
    delta = p.where(F.size(segs) >= 2).select(
        F.concat(F.lit("item1/Tables/"), segs.getItem(0), F.lit("/"), segs.getItem(1), F.lit("/_delta_log"))
        .alias("name"), F.lit(True).alias("isDirectory"), F.lit(False).alias("isShortcut"),
        F.lit(None).cast("string").alias("accountType"))
    shortcut = p.where(host_col().startswith("blog.")).select(
        F.concat(F.lit("item1/Tables/"), F.substring_index(host_col(), ".", 2)).alias("name"),
        F.lit(True).alias("isDirectory"), F.lit(True).alias("isShortcut"), F.lit("ADLS").alias("accountType"))
    files = p.select(F.concat(F.lit("item1/Files/"), host_col(), upath_col()).alias("name"),
                     F.lit(False).alias("isDirectory"), F.lit(False).alias("isShortcut"),
                     F.lit(None).cast("string").alias("accountType"))
    return delta.unionByName(shortcut).unionByName(files)


_SEGS = f"list_filter(string_split({UPATH}, '/'), lambda s: s <> '')"


@query("catalog_tables", sql=f"""
SELECT name, schema, path FROM (
  SELECT {_SEGS}[2] AS name, {_SEGS}[1] AS schema,
         'item1/Tables/' || {_SEGS}[1] || '/' || {_SEGS}[2] || '/' AS path
  FROM pages WHERE len({_SEGS}) >= 2
  UNION ALL
  SELECT split_part({HOST}, '.', 1) || '.' || split_part({HOST}, '.', 2), NULL,
         'item1/Tables/' || split_part({HOST}, '.', 1) || '.' || split_part({HOST}, '.', 2) || '/'
  FROM pages WHERE starts_with({HOST}, 'blog.'))
""")
def q_catalog_tables(spark, sf):
    return catalog_inventory(_listing(spark, sf), "item1")[0].select("name", "schema", "path")


@query("catalog_files", sql=f"""
SELECT string_split({HOST} || {UPATH}, '/')[-1] AS name, {HOST} || {UPATH} AS path FROM pages
""")
def q_catalog_files(spark, sf):
    return catalog_inventory(_listing(spark, sf), "item1")[1].select("name", "path")


@query("catalog_schemas", sql=f"""
WITH t AS (
  SELECT {_SEGS}[2] AS name, {_SEGS}[1] AS schema, {_SEGS}[1] || '/' || {_SEGS}[2] AS p FROM pages WHERE len({_SEGS}) >= 2
  UNION ALL
  SELECT split_part({HOST}, '.', 1) || '.' || split_part({HOST}, '.', 2), NULL, split_part({HOST}, '.', 1) || '.' || split_part({HOST}, '.', 2)
  FROM pages WHERE starts_with({HOST}, 'blog.'))
SELECT schema, count(*) AS n_tables, arg_min(name, p) AS first_table, arg_max(name, p) AS last_table FROM t GROUP BY schema
""")
def q_catalog_schemas(spark, sf):
    """JOB-3: the catalog's tables by schema."""
    return summarize_tables(catalog_inventory(_listing(spark, sf), "item1")[0], "schema", "name", "path")


@query("catalog_tree", sql=f"""
WITH f AS (SELECT {HOST} || {UPATH} AS path, false AS d FROM pages UNION ALL SELECT DISTINCT {HOST}, true FROM pages),
s AS (SELECT path, d, list_filter(string_split(path, '/'), lambda s: s <> '') AS s FROM f),
l AS (SELECT path, d, string_split(path, '/')[-1] AS name,
        CASE WHEN len(s) > 1 AND array_to_string(s[1:len(s) - 1], '/') IN (SELECT {HOST} FROM pages)
             THEN array_to_string(s[1:len(s) - 1], '/') END AS parent FROM s)
SELECT path, parent, row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN d THEN 0 ELSE 1 END, name, path) AS rank FROM l
""")
def q_catalog_tree(spark, sf):
    """JOB-3: the catalog's files below their folders, ranked among their siblings."""
    hosts = _listing(spark, sf).where(F.col("name").startswith("item1/Files/")).select(F.concat(
        F.lit("item1/Files/"), F.split("name", "/").getItem(2)).alias("name")).distinct()
    folders = hosts.select("name", F.lit(True).alias("isDirectory"), F.lit(False).alias("isShortcut"),
                           F.lit(None).cast("string").alias("accountType"))
    files = catalog_inventory(_listing(spark, sf).unionByName(folders), "item1")[1]
    return catalog_tree(files).select("path", "parent", "rank")


# ---------------------------------------------------------------- JOB-4
@query("deployment_report", sql=f"""
WITH j AS (SELECT user_id, ts, {DEPLOYMENT_STATUS} AS st,
                  value FROM events),
f AS (SELECT user_id,
        COALESCE(arg_max(st, ts) FILTER (WHERE st IN ('Failed', 'Cancelled') AND value < 400),
                 arg_max(st, ts) FILTER (WHERE st IN ('Pending', 'InProgress') AND value < 400), 'Succeeded') AS fold,
        min(ts) AS start_ts, max(ts) AS end_ts FROM j GROUP BY user_id),
exp AS (SELECT user_id, t FROM (SELECT DISTINCT user_id FROM events), (VALUES ('purchase'), ('signup'), ('view'),
        ('click'), ('error'), ('refund')) v(t)),
cnt AS (SELECT e.user_id, CAST(count(*) AS BIGINT) AS expected,
               CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id
                                                    AND x.event_type = e.t)) AS BIGINT) AS deployed
        FROM exp e GROUP BY e.user_id),
d AS (SELECT c.user_id, c.expected, c.deployed, f.fold, f.start_ts, f.end_ts,
        (epoch_us(f.end_ts) - epoch_us(f.start_ts)) // 1000 AS ms FROM cnt c JOIN f USING (user_id))
SELECT user_id, expected, deployed, fold,
  CASE WHEN fold = 'Succeeded' AND deployed = expected THEN 'Succeeded'
       WHEN end_ts + INTERVAL 10 MINUTE > TIMESTAMP '{NOW}' THEN 'InProgress' ELSE 'Failed' END AS status,
  CASE WHEN concat_ws(' ', CASE WHEN ms // 86400000 > 0 THEN (ms // 86400000) || 'd' END,
                      CASE WHEN ms % 86400000 // 3600000 > 0 THEN (ms % 86400000 // 3600000) || 'h' END,
                      CASE WHEN ms % 3600000 // 60000 > 0 THEN (ms % 3600000 // 60000) || 'm' END,
                      CASE WHEN ms % 60000 // 1000 > 0 THEN (ms % 60000 // 1000) || 's' END) = '' THEN '0s'
       ELSE concat_ws(' ', CASE WHEN ms // 86400000 > 0 THEN (ms // 86400000) || 'd' END,
                      CASE WHEN ms % 86400000 // 3600000 > 0 THEN (ms % 86400000 // 3600000) || 'h' END,
                      CASE WHEN ms % 3600000 // 60000 > 0 THEN (ms % 3600000 // 60000) || 'm' END,
                      CASE WHEN ms % 60000 // 1000 > 0 THEN (ms % 60000 // 1000) || 's' END) END AS duration
FROM d
""")
def q_deployment_report(spark, sf):
    e = table(spark, sf, "events")
    # every deployment expects the package's six items
    package_items = F.array(*[F.lit(t) for t in ("purchase", "signup", "view", "click", "error", "refund")])
    expected = e.select("user_id").distinct().select("user_id", F.explode(package_items).alias("event_type"))
    jobs = e.select("user_id", "ts", map_lookup(F.col("event_type"), EVENT_JOB_STATUS).alias("job_status"),
                    F.when(F.col("value") >= 400, "IgnoreErrors").otherwise("FailOnError").alias("policy"))
    rep = deployment_report(expected, e.select("user_id", "event_type"), jobs, "user_id", "event_type",
                            now_lit(NOW))
    return rep.select("user_id", "expected", "deployed", "fold", "status", "duration")


# ---------------------------------------------------------------- JOB-6
@query("log_analytics", sql="""
SELECT user_id,
  CAST(count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS BIGINT) AS n_info,
  CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS n_debug,
  CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS n_error,
  arg_min('error by user ' || CAST(user_id AS VARCHAR) || ' #' || CAST(event_id AS VARCHAR), ts)
    FILTER (WHERE event_type = 'error') AS first_error
FROM events GROUP BY user_id
""")
def q_log_analytics(spark, sf):
    e = table(spark, sf, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "debug") \
        .otherwise("info")
    msg = F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"), F.lit(" #"),
                   F.col("event_id").cast("string"))
    lines = e.select("user_id", format_log("ts", level, msg).alias("line"))
    return log_analytics(lines, "user_id", "line")


# ---------------------------------------------------------------- JOB-5
@query("access_audit", sql=f"""
WITH t AS (SELECT page_id, '/' || {HOST} || {UPATH} AS target FROM pages),
r AS (SELECT DISTINCT {HOST} AS folder FROM pages)
SELECT DISTINCT 'owner_' || split_part(r.folder, '.', 1) AS principal, t.page_id, 'Read' AS action
FROM t JOIN r ON ltrim(t.target, '/') = r.folder OR starts_with(ltrim(t.target, '/'), r.folder || '/')
""")
def q_access_audit(spark, sf):
    from ..operators.access import effective_access, read_role_rows
    from .scalar_queries import host_col, upath_col
    p = table(spark, sf, "pages")
    names = p.select(F.lit("folder").alias("kind"), host_col().alias("name")).distinct().unionByName(
        p.select(F.lit("table").alias("kind"),
                 F.split(F.regexp_replace(upath_col(), "^/", ""), "/").getItem(0).alias("name")).distinct())
    rules = read_role_rows(names, "kind", "name")
    members = names.select(
        F.when(F.col("kind") == "folder", F.concat(F.regexp_replace("name", r"[/\\\\]", "_"), F.lit("Reader")))
        .otherwise(F.concat("name", F.lit("Reader"))).alias("role"),
        F.when(F.col("kind") == "folder", F.concat(F.lit("owner_"), F.substring_index("name", ".", 1)))
        .otherwise(F.lit("analyst")).alias("principal"))
    targets = p.select("page_id", F.concat(F.lit("/"), host_col(), upath_col()).alias("target"))
    return effective_access(rules, members, targets, "target", "page_id", normalize=True)
