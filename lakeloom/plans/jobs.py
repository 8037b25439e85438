"""Composite jobs (JOB-1 .. JOB-7) built from the library's operators.

Each job returns a DataFrame (the plan); writers are separate so the same plan
can be checked, explained or written.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import LexiconScorer, Scorer
from ..operators.project import append_result, drop_if_exists, require_columns
from ..session import cut_lineage, ensure_parallelism


def text_enrichment(df: DataFrame, source_col: str, result_col: str,
                    scorer: Scorer | None = None, field: str | None = "sentiment") -> DataFrame:
    """JOB-1: require the source column, drop an old result, score the text,
    keep the original columns and append the result.

    ``field`` picks one field out of the scorer's struct (the reference keeps
    ``documents.sentiment``); ``None`` keeps the whole struct.
    """
    require_columns(df, [source_col])
    base = ensure_parallelism(drop_if_exists(df, result_col))
    originals = list(base.columns)
    scorer = scorer or LexiconScorer()
    tmp = "__score"
    scored = scorer.score(base, source_col, tmp)
    value = F.col(tmp)[field] if field else F.col(tmp)
    return append_result(scored.withColumn(result_col, value), originals, result_col)


def enrich_table(spark, root: str, table: str, source_col: str, result_col: str,
                 scorer: Scorer | None = None, fmt: str = "parquet") -> DataFrame:
    """JOB-1 end to end: scan, enrich and overwrite the table in place
    (through a staged copy, since a path cannot be overwritten while read)."""
    from ..sources.sinks import overwrite_table
    from ..sources.tables import scan_table
    df = scan_table(spark, root, table, fmt)
    out = text_enrichment(df, source_col, result_col, scorer)
    return overwrite_table(out, f"{root.rstrip('/')}/Tables/{table}", fmt)


#: A table of a few short columns with so many rows is broadcast.
SMALL_ROWS = 100_000


def render_parts(parts: DataFrame, variables: DataFrame, key: str, payload_col: str, definition: Mapping,
                 global_interceptors: Mapping[str, Mapping] | None = None, name_col: str = "name",
                 value_col: str = "value", base64: bool = True) -> DataFrame:
    """JOB-2: apply an interceptor definition to every part's payload with the
    variables of its own deployment.

    The definition (a reference to a global one, too) becomes a Column function
    through the interceptor registry; with ``base64`` payloads are decoded and
    encoded around it.  Replacement values that name a variable take that
    deployment's non-empty value.  Only the variables that the definition names
    are pivoted out of the long variable table (``max(when(...))`` per
    deployment, map-side combined); with up to ``SMALL_ROWS`` deployments they
    are broadcast, so that the parts aren't shuffled.  Null and empty payloads
    stay as they are.
    """
    from ..functions.documents import build_interceptor, resolve_definition
    from ..functions.text import intercept_base64, ordered_entries
    final = resolve_definition(definition, global_interceptors)
    needed = sorted({v for _, v in ordered_entries((final.get("config") or {}).get("replacements") or {})})
    names = {v: f"__v{i}" for i, v in enumerate(needed)}
    j = parts
    if needed:
        piv = cut_lineage(variables.where(F.col(name_col).isin(needed)).groupBy(key).agg(
            *[F.max(F.when(F.col(name_col) == v, F.col(value_col))).alias(c) for v, c in names.items()]))
        j = parts.join(F.broadcast(piv) if piv.count() <= SMALL_ROWS else piv, key, "left")
    apply = build_interceptor(final, variables={v: F.col(c) for v, c in names.items()})
    payload = F.col(payload_col)
    done = intercept_base64(payload, apply) if base64 else apply(payload)
    return j.withColumn(payload_col, F.when(F.length(payload) > 0, done).otherwise(payload)).drop(*names.values())


def capture_references(parts: DataFrame, key: str, text_col: str, items: DataFrame, id_col: str,
                       name_col: str, workspace_id: str | None = None) -> DataFrame:
    """JOB-7: replace the original workspace id by ``{{WORKSPACE_ID}}`` and then every
    known item id in the parts by ``{{name}}`` (inverted references), so that the
    captured package is portable."""
    from ..functions.documents import WORKSPACE_ID, invert_references
    from ..operators.relational import ordered_remap
    refs = invert_references(items, id_col, name_col).withColumn("seq", F.lit(1).cast("long"))
    if workspace_id:
        parts = parts.withColumn(text_col, F.replace(text_col, F.lit(workspace_id), F.lit(WORKSPACE_ID)))
    return ordered_remap(parts, refs, key, text_col, "seq", "search", "value", ordered=False)


# Item types that are captured without a definition, and longest package id.
NO_DEFINITION_TYPES, PACKAGE_ID_LENGTH, DEFAULT_INTERCEPTOR = ("Lakehouse",), 25, "Default"


def package_items(items: DataFrame, package: str, name_col: str = "name", type_col: str = "type",
                  paths_col: str = "paths", interceptor: str | None = DEFAULT_INTERCEPTOR) -> DataFrame:
    """JOB-7: the package document's entry of each item, one JSON text per row.

    Adds ``package_id`` (sanitised package name), ``part_paths`` (where the parts
    are stored: ``Files/packages/<package>/<item>/definitions/<part>``) and
    ``entry``: display name, type and definition with its parts and a reference to
    the global interceptor.  Items of a type without definition have none.  A
    package's entries are rows, not one document, so a package has no size limit.
    """
    from ..functions.text import sanitize_name
    pid = sanitize_name(F.lit(package), PACKAGE_ID_LENGTH)
    root = F.concat(F.lit("Files/packages/"), pid, F.lit("/"), sanitize_name(name_col), F.lit("/definitions/"))
    parts = F.transform(paths_col, lambda p: F.struct(p.alias("path"), F.concat(root, p).alias("payload"),
                                                      F.lit("OneLake").alias("payloadType")))
    ref = F.struct(F.lit("Reference").alias("type"), F.struct(F.lit(interceptor).alias("id")).alias("config"))
    fields = [parts.alias("parts")] + ([ref.alias("interceptor")] if interceptor else [])
    plain = F.col(type_col).isin(*NO_DEFINITION_TYPES)
    entry = F.struct(F.col(name_col).alias("displayName"), F.col(type_col).alias("type"), F.when(~plain, F.struct(*fields)).alias("definition"))
    return items.withColumns({"package_id": pid, "part_paths": F.when(plain, F.array().cast("array<string>")).otherwise(
        F.transform(parts, lambda p: p["payload"])), "entry": F.to_json(entry)})


def catalog_inventory(listing: DataFrame, item_dir: str, name_col: str = "name") -> tuple[DataFrame, DataFrame]:
    """JOB-3: one path listing -> (tables, files).

    Tables are ``_delta_log`` folders or ADLS shortcuts under ``Tables``,
    parsed to name/schema/path; files are every entry under ``Files`` with
    its path relative to ``<item>/Files/``.
    """
    from ..functions.text import DELTA_LOG_SUFFIX, base_name, parse_lake_path, relative_path
    lst = listing
    is_table = (F.col(name_col).endswith(DELTA_LOG_SUFFIX)
                | (F.coalesce(F.col("isShortcut"), F.lit(False))
                   & F.coalesce(F.col("accountType").isin("ADLS", "ExternalADLS"), F.lit(False))))
    tbl_root = f"{item_dir.rstrip('/')}/Tables/"
    file_root = f"{item_dir.rstrip('/')}/Files/"
    tables = (lst.where(F.col(name_col).startswith(tbl_root) & is_table)
              .select(parse_lake_path(F.col(name_col)).alias("t")).select("t.*"))
    files = lst.where(F.col(name_col).startswith(file_root)).select(
        F.lit("Files").alias("prefix"), base_name(F.col(name_col)).alias("name"),
        relative_path(F.col(name_col), F.lit(file_root)).alias("path"),
        F.col("isDirectory"), F.col("isShortcut"))
    return tables, files


def catalog_tree(files: DataFrame, path_col: str = "path") -> DataFrame:
    """JOB-3: the files of :func:`catalog_inventory` as a tree: each entry with its
    listed parent folder and its place among its siblings (folders first)."""
    from ..operators.relational import link_parents, tree_rank
    return tree_rank(link_parents(files, path_col), "parent", "name", "isDirectory", tie=[path_col])


def deployment_report(expected: DataFrame, deployed: DataFrame, jobs: DataFrame, key: str,
                      item_keys, now) -> DataFrame:
    """JOB-4: match expected items to deployed ones (a deployed duplicate
    never counts twice), count them, fold job states into a status (rule R1)
    and report the job duration.

    ``jobs`` carries ``job_status``, ``ts`` and ``policy`` per ``key``.
    """
    from ..functions.dates import duration_struct, format_duration, millis_between
    from ..operators.relational import status_fold
    ik = [item_keys] if isinstance(item_keys, str) else list(item_keys)
    found = deployed.select(key, *ik).distinct().withColumn("__hit", F.lit(True))
    matched = expected.join(found, [key, *ik], "left")
    counts = matched.groupBy(key).agg(F.count(F.lit(1)).alias("expected"),
                                      F.count_if(F.col("__hit").isNotNull()).alias("deployed"))
    span = jobs.groupBy(key).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    deps = counts.join(span, key, "left")
    folded = status_fold(jobs, key, "job_status", "ts", "policy", deps, "expected", "deployed", "end_ts", now)
    return folded.withColumn("duration", format_duration(duration_struct(millis_between("start_ts", "end_ts"))))


def log_analytics(lines: DataFrame, run_col: str, line_col: str) -> DataFrame:
    """JOB-6: parse log lines, count them by level per run and find the
    first error (by time, then text) of each run."""
    from ..functions.text import parse_log
    p = lines.select(run_col, parse_log(line_col).alias("p")).select(run_col, "p.*")
    return p.groupBy(run_col).agg(
        F.count_if(F.col("level") == "INFO").alias("n_info"),
        F.count_if(F.col("level") == "DEBUG").alias("n_debug"),
        F.count_if(F.col("level") == "ERROR").alias("n_error"),
        F.min(F.when(F.col("level") == "ERROR", F.struct("ts", "message"))).alias("__first"),
    ).select(run_col, "n_info", "n_debug", "n_error", F.col("__first.message").alias("first_error"))
