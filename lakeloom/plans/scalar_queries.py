"""Registered queries for scalar functions (STR, MTH, DTE, VAL, JSN, STM-2).

Each reads a full test table; the SQL is the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, status, text, validate
from ..sources.tables import parse_json_col
from .registry import query, table
from .sqlfrag import DEPLOYMENT_STATUS, HOST, JOB_STATUS, UPATH, replace_first

def host_col():
    return F.regexp_extract("url", r"^https?://([^/?#]+)", 1)


def upath_col():
    return F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)", 1)

# ---------------------------------------------------------------- STR-1
REPL = {"the": "{{X}}", "{{X}}": "Y", "and": "$&", "2": "two"}
REPL_VARS = {"{{X}}": "<X>"}


@query("replace_many", sql="""
SELECT doc_id, replace(replace(replace(replace(text, '2', 'two'), 'the', '<X>'), '{{X}}', 'Y'), 'and', '$&') AS out
FROM documents
""")
def q_replace_many(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.replace_many("text", REPL, REPL_VARS).alias("out"))


# ---------------------------------------------------------------- STR-2 / SRC-4
@query("intercept_base64", sql="""
SELECT doc_id, to_base64(encode(replace(text, 'the', 'THE'))) AS content
FROM documents
""")
def q_intercept_base64(spark, sf):
    d = table(spark, sf, "documents")
    b64 = text.text_to_base64("text")
    return d.select("doc_id", text.intercept_base64(b64, lambda s: F.replace(s, F.lit("the"), F.lit("THE")))
                    .alias("content"))


@query("text_to_base64", sql="SELECT doc_id, to_base64(encode(text)) AS b64 FROM documents")
def q_text_to_base64(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.text_to_base64("text").alias("b64"))


# ---------------------------------------------------------------- STR-4
@query("sanitize_name", sql=r"""
SELECT page_id,
       substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url,
         '[<>:"/\\|?*]', '_', 'g'), '\s+', '_', 'g'), '_{2,}', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40) AS name
FROM pages
""")
def q_sanitize_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.sanitize_name("url", 40).alias("name"))


# ---------------------------------------------------------------- STR-5
_LAKE = f"({HOST} || '/Tables' || {UPATH} || '/_delta_log')"
_STRIP = f"regexp_replace({_LAKE}, '/_delta_log$', '')"


@query("parse_lake_path", sql=f"""
SELECT page_id,
       string_split({_STRIP}, '/')[-1] AS name,
       CASE WHEN len(string_split({_STRIP}, '/')) = 4 THEN string_split({_STRIP}, '/')[3] END AS schema,
       {_STRIP} || '/' AS path
FROM pages
WHERE ends_with({_LAKE}, '/_delta_log')
""")
def q_parse_lake_path(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(host_col(), F.lit("/Tables"), upath_col(),
                                                            F.lit("/_delta_log")).alias("lake"))
    t = p.where(F.col("lake").endswith(text.DELTA_LOG_SUFFIX)).select("page_id", text.parse_lake_path("lake").alias("t"))
    return t.select("page_id", "t.name", "t.schema", "t.path")


# ---------------------------------------------------------------- STR-6
@query("relative_path", sql=f"""
SELECT page_id,
       CASE WHEN length({HOST} || '/Files' || {UPATH}) > length({HOST} || '/Files/')
            THEN substr({HOST} || '/Files' || {UPATH}, length({HOST} || '/Files/') + 1) ELSE '' END AS rel,
       CASE WHEN starts_with(ltrim({UPATH}, '/'), 'Files/') THEN 'Files'
            WHEN starts_with(ltrim({UPATH}, '/'), 'Tables/') THEN 'Tables'
            ELSE split_part(ltrim({UPATH}, '/'), '/', 1) END AS prefix,
       string_split({UPATH}, '/')[-1] AS base
FROM pages
""")
def q_relative_path(spark, sf):
    p = table(spark, sf, "pages")
    full = F.concat(host_col(), F.lit("/Files"), upath_col())
    d = F.concat(host_col(), F.lit("/Files/"))
    up = F.regexp_replace(upath_col(), "^/+", "")
    return p.select("page_id", text.relative_path(full, d).alias("rel"), text.folder_prefix(up).alias("prefix"),
                    text.base_name(upath_col()).alias("base"))


# ---------------------------------------------------------------- STR-7
_ABFSS_1 = replace_first("url", "'en/'", "''")
_ABFSS_2 = replace_first(_ABFSS_1, "'https://'", "'abfss://en@'")


@query("to_abfss", sql=f"SELECT page_id, {_ABFSS_2} AS abfss, concat_ws('/', {HOST}, 'Files', 'x') AS built FROM pages")
def q_to_abfss(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", text.to_abfss(F.col("url"), "en").alias("abfss"),
                    text.build_path(host_col(), F.lit("Files"), F.lit("x")).alias("built"))


# ---------------------------------------------------------------- STR-8 / FLT-8
_EXT = f"lower(string_split(string_split({UPATH}, '/')[-1], '.')[-1])"


@query("file_language", sql=f"""
WITH e AS (SELECT page_id, {_EXT} AS x FROM pages)
SELECT page_id, CASE
  WHEN x IN ('js', 'jsx') THEN 'javascript' WHEN x IN ('ts', 'tsx') THEN 'typescript' WHEN x = 'ipynb' THEN 'jupyter'
  WHEN x = 'py' THEN 'python' WHEN x = 'md' THEN 'markdown' WHEN x IN ('yml', 'yaml') THEN 'yaml' WHEN x = 'sh' THEN 'shell'
  WHEN x = 'ps1' THEN 'powershell' WHEN x = 'cs' THEN 'csharp' WHEN x = 'rb' THEN 'ruby' WHEN x = 'rs' THEN 'rust'
  WHEN x IN ('html', 'css', 'scss', 'sass', 'json', 'xml', 'sql', 'java', 'cpp', 'c', 'php', 'go') THEN x
  ELSE 'plaintext' END AS language
FROM e
""")
def q_file_language(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", text.file_language(text.base_name(upath_col())).alias("language"))


# ---------------------------------------------------------------- STR-9
_LOC = f"('/workspaces/' || {HOST} || '/items/x/jobs/instances' || {UPATH})"


@query("extract_id", sql=f"""
SELECT page_id,
       CASE WHEN regexp_matches({_LOC}, '/jobs/instances/([^/?]+)')
            THEN regexp_extract({_LOC}, '/jobs/instances/([^/?]+)', 1) END AS job_id
FROM pages
""")
def q_extract_id(spark, sf):
    p = table(spark, sf, "pages")
    loc = F.concat(F.lit("/workspaces/"), host_col(), F.lit("/items/x/jobs/instances"), upath_col())
    return p.select("page_id", text.extract_id(loc).alias("job_id"))


@query("extract_connection", sql="""
WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN '' ELSE
  ' in Sql.Database("' || source || '",' || repeat(' ', doc_id % 4) || '"end-' || doc_id || '")' END AS t FROM documents)
SELECT doc_id, nullif(regexp_extract(t, 'Sql\\.Database\\("([^"]+)",\\s*"([^"]+)"\\)', 1), '') AS database,
  nullif(regexp_extract(t, 'Sql\\.Database\\("([^"]+)",\\s*"([^"]+)"\\)', 2), '') AS endpoint FROM t
""")
def q_extract_connection(spark, sf):
    d = table(spark, sf, "documents")
    conn = F.concat(F.lit(' in Sql.Database("'), "source", F.lit('",'), F.repeat(F.lit(" "), (F.col("doc_id") % 4).cast("int")),
                    F.lit('"end-'), F.col("doc_id").cast("string"), F.lit('")'))
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "").otherwise(conn))
    return d.select("doc_id", text.extract_connection(t).alias("c")).select("doc_id", "c.database", "c.endpoint")


# ---------------------------------------------------------------- STR-10
_LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' ELSE 'info' END"


def _log_lines(spark, sf):
    e = table(spark, sf, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "debug") \
        .otherwise("info")
    msg = F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"))
    return e.select("event_id", text.format_log("ts", level, msg, F.concat(F.lit("["), F.col("props"), F.lit("]")))
                    .alias("line"))


@query("format_log", sql=f"""
SELECT event_id, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z] [' || upper({_LEVEL_SQL}) || '] '
       || event_type || ' by user ' || CAST(user_id AS VARCHAR) || ' [' || props || ']' AS line
FROM events
""")
def q_format_log(spark, sf):
    return _log_lines(spark, sf)


@query("log_levels", sql=f"""
SELECT upper({_LEVEL_SQL}) AS level, CAST(count(*) AS BIGINT) AS n, CAST(min(event_id) AS BIGINT) AS first_id
FROM events GROUP BY 1
""")
def q_log_levels(spark, sf):
    parsed = _log_lines(spark, sf).select("event_id", text.parse_log("line").alias("p"))
    return parsed.groupBy(F.col("p.level").alias("level")).agg(F.count("*").alias("n"),
                                                               F.min("event_id").alias("first_id"))


# ---------------------------------------------------------------- STR-11
@query("suffix_name", sql=f"""
SELECT p_partkey, p_name || '_dep42' AS suffixed,
       {replace_first("(p_name || '_dep42_dep42')", "'_dep42'", "''")} AS unsuffixed
FROM part
""")
def q_suffix_name(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.suffix_name("p_name", "dep42").alias("suffixed"),
                    text.unsuffix_name(F.concat("p_name", F.lit("_dep42_dep42")), "dep42").alias("unsuffixed"))


# ---------------------------------------------------------------- STR-14
_JS_TRIM = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
_ITEMS = f"list_filter(list_transform(string_split(text, ','), lambda x: {_JS_TRIM}), lambda x: length(x) > 0)"


@query("parse_list", sql=f"""
SELECT doc_id, CAST(len({_ITEMS}) AS BIGINT) AS n_items,
       'w.' || {_ITEMS}[1] AS first_item, 'w.' || {_ITEMS}[-1] AS last_item
FROM documents
""")
def q_parse_list(spark, sf):
    d = table(spark, sf, "documents")
    items = text.parse_list("text", prefix="w.")
    return d.select("doc_id", F.size(items).cast("long").alias("n_items"),
                    F.try_element_at(items, F.lit(1)).alias("first_item"), F.try_element_at(items, F.lit(-1)).alias("last_item"))


# ---------------------------------------------------------------- STR-15
@query("label_status", sql="""
SELECT o_orderkey,
       CASE o_orderstatus WHEN 'O' THEN 'In Progress' WHEN 'F' THEN 'Succeeded' ELSE 'Not Started' END AS label,
       CASE o_orderstatus WHEN 'O' THEN '#0078D4' WHEN 'F' THEN '#107C10' ELSE '#605E5C' END AS colour
FROM orders
""")
def q_label_status(spark, sf):
    o = table(spark, sf, "orders")
    st = F.when(F.col("o_orderstatus") == "O", "InProgress").when(F.col("o_orderstatus") == "F", "Succeeded") \
        .otherwise("NotStarted")
    return o.select("o_orderkey", status.label(st, status.SESSION_STATE_LABELS).alias("label"),
                    status.status_colour(st).alias("colour"))


# ---------------------------------------------------------------- STR-16
@query("describe_schedule", sql="""
SELECT event_id,
  'RunNotebook - ' ||
  CASE event_type WHEN 'view' THEN 'Daily' WHEN 'purchase' THEN 'Weekly' ELSE 'Cron' END ||
  CASE event_type
    WHEN 'view' THEN ' at ' || strftime(ts, '%H:%M') || ', 23:00'
    WHEN 'purchase' THEN ' on ' || dayname(ts) || ' at ' || strftime(ts, '%H:%M')
    ELSE ' every ' || CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) || ' minutes' END ||
  CASE WHEN event_type = 'error' THEN ' (Disabled)' ELSE '' END AS description
FROM events
""")
def q_describe_schedule(spark, sf):
    e = table(spark, sf, "events")
    et = F.col("event_type")
    hhmm = F.date_format("ts", "HH:mm")
    typ = F.when(et == "view", "Daily").when(et == "purchase", "Weekly").otherwise("Cron")
    cfg = F.struct(typ.alias("type"), F.floor("value").cast("int").alias("interval"),
                   F.when(et == "view", F.array(hhmm, F.lit("23:00"))).when(et == "purchase", F.array(hhmm))
                   .alias("times"),
                   F.when(et == "purchase", F.array(F.date_format("ts", "EEEE"))).alias("weekdays"))
    return e.select("event_id", status.describe_schedule(F.lit("RunNotebook"), cfg, et != "error")
                    .alias("description"))


# ---------------------------------------------------------------- MTH-1
def _tier_sql(col: str) -> str:
    return (f"CASE WHEN starts_with({col}, 'F') THEN 'Fabric' WHEN starts_with({col}, 'P') THEN 'Premium' "
            f"WHEN starts_with({col}, 'A') THEN 'Azure' ELSE 'Unknown' END")


@query("tier", sql=f"""
SELECT p_partkey, {_tier_sql('p_type')} AS tier, {_tier_sql('p_brand')} AS brand_tier
FROM part
""")
def q_tier(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", status.pricing_tier("p_type").alias("tier"),
                    status.pricing_tier("p_brand").alias("brand_tier"))


# ---------------------------------------------------------------- MTH-2
# Event type -> job status stand-in used by the test queries.
EVENT_JOB_STATUS = {"purchase": "Completed", "error": "Failed", "signup": "NotStarted",
                    "view": "InProgress", "click": "Running"}
EVENT_BATCH_STATE = {"purchase": "success", "error": "dead", "signup": "not_started", "view": "starting",
                     "click": "unknown_state"}


def event_job_status(col="event_type"):
    return text.map_lookup(F.col(col), EVENT_JOB_STATUS)


@query("map_state", sql=f"""
SELECT event_id, {JOB_STATUS} AS job_status, {DEPLOYMENT_STATUS} AS deployment_status,
  CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Pending'
       ELSE 'InProgress' END AS batch_status
FROM events
""")
def q_map_state(spark, sf):
    e = table(spark, sf, "events")
    js = event_job_status()
    bs = text.map_lookup(F.col("event_type"), EVENT_BATCH_STATE)
    return e.select("event_id", js.alias("job_status"), status.map_job_status(js).alias("deployment_status"),
                    status.map_batch_state(bs).alias("batch_status"))


# ---------------------------------------------------------------- STM-2
@query("state_flags", sql="""
WITH s AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed'
             WHEN 'signup' THEN 'NotStarted' WHEN 'view' THEN 'Running' ELSE 'Unknown' END AS st,
             value > 480 AS read_error FROM events)
SELECT event_id,
  CASE WHEN read_error THEN false ELSE st IN ('Running', 'NotStarted') END AS is_running,
  CASE WHEN read_error THEN true ELSE st IN ('Succeeded', 'Failed') END AS is_complete,
  CASE WHEN read_error THEN false ELSE st = 'Succeeded' END AS is_succeeded,
  CASE WHEN read_error THEN false ELSE st = 'Failed' END AS is_failed
FROM s
""")
def q_state_flags(spark, sf):
    e = table(spark, sf, "events")
    st = text.map_lookup(F.col("event_type"), {"purchase": "Succeeded", "error": "Failed", "signup": "NotStarted",
                                               "view": "Running"}, "Unknown")
    return e.select("event_id", status.state_flags(st, F.col("value") > 480).alias("f")).select("event_id", "f.*")


# ---------------------------------------------------------------- DTE-1
_MS = "((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000)"


@query("format_duration", sql=f"""
WITH d AS (SELECT event_id, {_MS} // 86400000 AS dd, ({_MS} % 86400000) // 3600000 AS hh,
                  ({_MS} % 3600000) // 60000 AS mi, ({_MS} % 60000) // 1000 AS ss FROM events)
SELECT event_id, CASE WHEN t = '' THEN '0s' ELSE t END AS duration
FROM (SELECT event_id, concat_ws(' ', CASE WHEN dd > 0 THEN dd || 'd' END, CASE WHEN hh > 0 THEN hh || 'h' END,
        CASE WHEN mi > 0 THEN mi || 'm' END, CASE WHEN ss > 0 THEN ss || 's' END) AS t FROM d)
""")
def q_format_duration(spark, sf):
    e = table(spark, sf, "events")
    ms = dates.millis_between(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return e.select("event_id", dates.format_duration(dates.duration_struct(ms)).alias("duration"))


# ---------------------------------------------------------------- DTE-2
_VMS = "CAST(floor(value * 1000) AS BIGINT)"


@query("durations", sql=f"""
SELECT event_id, {_VMS} AS queued_ms,
  CASE WHEN event_type = 'error' THEN NULL ELSE {_VMS} * 60 END AS running_ms,
  CASE WHEN event_type = 'error' THEN NULL ELSE {_VMS} * 61 END AS total_ms,
  CASE WHEN event_type = 'error' THEN NULL ELSE
    CASE WHEN concat_ws(' ',
      CASE WHEN ({_VMS} * 61) // 86400000 > 0 THEN (({_VMS} * 61) // 86400000) || 'd' END,
      CASE WHEN ({_VMS} * 61) % 86400000 // 3600000 > 0 THEN (({_VMS} * 61) % 86400000 // 3600000) || 'h' END,
      CASE WHEN ({_VMS} * 61) % 3600000 // 60000 > 0 THEN (({_VMS} * 61) % 3600000 // 60000) || 'm' END,
      CASE WHEN ({_VMS} * 61) % 60000 // 1000 > 0 THEN (({_VMS} * 61) % 60000 // 1000) || 's' END) = '' THEN '0s'
    ELSE concat_ws(' ',
      CASE WHEN ({_VMS} * 61) // 86400000 > 0 THEN (({_VMS} * 61) // 86400000) || 'd' END,
      CASE WHEN ({_VMS} * 61) % 86400000 // 3600000 > 0 THEN (({_VMS} * 61) % 86400000 // 3600000) || 'h' END,
      CASE WHEN ({_VMS} * 61) % 3600000 // 60000 > 0 THEN (({_VMS} * 61) % 3600000 // 60000) || 'm' END,
      CASE WHEN ({_VMS} * 61) % 60000 // 1000 > 0 THEN (({_VMS} * 61) % 60000 // 1000) || 's' END) END
  END AS total_text
FROM events
""")
def q_durations(spark, sf):
    e = table(spark, sf, "events")
    vms = F.floor(F.col("value") * 1000).cast("long")
    submitted = F.col("ts")
    start = F.col("ts") + F.make_dt_interval(secs=(vms / 1000).cast("decimal(18,6)"))
    end = F.when(F.col("event_type") != "error",
                 start + F.make_dt_interval(secs=(vms * 60 / 1000).cast("decimal(18,6)")))
    d = e.select("event_id", dates.session_durations(submitted, start, end).alias("d"),
                 dates.millis_between(submitted, start).alias("queued_ms"),
                 dates.millis_between(start, end).alias("running_ms"),
                 dates.millis_between(submitted, end).alias("total_ms"))
    return d.select("event_id", "queued_ms", "running_ms", "total_ms",
                    F.when(F.col("d.total").isNotNull(), dates.format_duration("d.total")).alias("total_text"))


# ---------------------------------------------------------------- VAL-1
_MIN = "(CAST(p_size // 10 AS INTEGER) - 1)"
_MAX = "(CAST(floor(p_retailprice / 400) AS INTEGER) - 2)"


@query("range_errors", sql=f"""
SELECT p_partkey,
  concat_ws('; ',
    CASE WHEN {_MIN} < 1 THEN 'Minimum node count must be at least 1' END,
    CASE WHEN {_MAX} < 1 THEN 'Maximum node count must be at least 1' END,
    CASE WHEN {_MIN} > {_MAX} THEN 'Minimum node count cannot be greater than maximum node count' END) AS errors,
  CAST(({_MIN} < 1)::INT + ({_MAX} < 1)::INT + ({_MIN} > {_MAX})::INT AS INTEGER) AS n_errors
FROM part
""")
def q_range_errors(spark, sf):
    p = table(spark, sf, "part")
    mn = (F.floor(F.col("p_size") / 10) - 1).cast("int")
    mx = (F.floor(F.col("p_retailprice") / 400) - 2).cast("int")
    errs = validate.range_errors(mn, mx, "node count")
    return p.select("p_partkey", F.array_join(errs, "; ").alias("errors"), F.size(errs).alias("n_errors"))


# ---------------------------------------------------------------- VAL-2
def _valid_sql(x: str) -> str:
    t = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return (f"({x} IS NOT NULL AND length({t}) > 0 AND length({x}) BETWEEN 1 AND 64 "
            f"AND regexp_full_match({x}, '[a-zA-Z0-9\\-_ ]+') AND lower({t}) <> 'starter pool')")


@query("valid_name", sql=f"""
SELECT c_custkey, {_valid_sql('c_name')} AS valid_raw,
       {_valid_sql("replace(c_name, '#', ' ')")} AS valid_clean,
       {_valid_sql("CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Starter Pool' ELSE c_mktsegment END")} AS valid_seg
FROM customer
""")
def q_valid_name(spark, sf):
    c = table(spark, sf, "customer")
    seg = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Starter Pool").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", validate.valid_name("c_name").alias("valid_raw"),
                    validate.valid_name(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("valid_clean"),
                    validate.valid_name(seg).alias("valid_seg"))


# ---------------------------------------------------------------- SRC-6 / JSN-1 / PRJ-3
@query("parse_props", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
""")
def q_parse_props(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", parse_json_col("props", "k int")["k"].alias("k"))


@query("decode_definition", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       '{"k":' || json_extract_string(props, '$.k') || '}' AS canonical
FROM events
""")
def q_decode_definition(spark, sf):
    from ..functions.documents import decode_definition
    e = table(spark, sf, "events")
    parts = e.select("event_id", F.array(
        F.struct(F.lit("notes.txt").alias("path"), text.text_to_base64(F.lit("x")).alias("payload"),
                 F.lit("InlineBase64").alias("payloadType")),
        F.struct(F.lit("item.metadata.json").alias("path"), text.text_to_base64("props").alias("payload"),
                 F.lit("InlineBase64").alias("payloadType"))).alias("parts"))
    d = parts.select("event_id", decode_definition("parts", "item.metadata.json", "k int").alias("d"))
    return d.select("event_id", F.col("d")["k"].alias("k"), F.to_json("d").alias("canonical"))


@query("extract_nested", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS sentiment FROM events
""")
def q_extract_nested(spark, sf):
    from ..operators.project import extract_nested
    e = table(spark, sf, "events")
    wrapped = e.select("event_id", F.struct(parse_json_col("props", "k int").alias("documents")).alias("TmpOutput"))
    # two-step path as in the reference: TmpOutput.documents, then documents.k
    step1 = extract_nested(wrapped, "TmpOutput.documents", "documents")
    return extract_nested(step1, "documents.k", "sentiment").select("event_id", "sentiment")


# ---------------------------------------------------------------- JSN-2
@query("pick_output", sql="""
SELECT event_id,
  CASE event_type
    WHEN 'click' THEN 'k=' || json_extract_string(props, '$.k')
    WHEN 'view' THEN '{"k":' || json_extract_string(props, '$.k') || '}'
    ELSE '{"other":' || json_extract_string(props, '$.k') || '}' END AS output
FROM events
""")
def q_pick_output(spark, sf):
    from ..functions.documents import pick_output
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    data = (F.when(F.col("event_type") == "click",
                   F.to_json(F.struct(F.concat(F.lit("k="), k).alias("text/plain"))))
            .when(F.col("event_type") == "view", F.concat(F.lit('{"application/json":'), F.col("props"), F.lit("}")))
            .otherwise(F.concat(F.lit('{"other":'), k, F.lit("}"))))
    return e.select("event_id", pick_output(data).alias("output"))

