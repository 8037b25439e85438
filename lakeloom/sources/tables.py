"""Scans and sources (SRC-1 .. SRC-9).

Everything is a DataFrame reader; file bodies never pass through the driver.
"""

from __future__ import annotations

import uuid

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.documents import PAYLOAD_TYPES
from ..functions.text import _c, clean_base64, js_trim
from ..session import cut_lineage, scratch_path
from .files import read_files


def table_path(root: str, name: str, layout: str = "lake", fmt: str = "parquet") -> str:
    root = root.rstrip("/")
    if layout == "lake":
        return f"{root}/Tables/{name}"
    return f"{root}/{name}.{fmt}"


def scan_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet",
               layout: str = "lake") -> DataFrame:
    """Resolve ``Tables/<name>`` under ``root`` and load it (SRC-1).
    ``layout='flat'`` reads ``<root>/<name>.<fmt>`` as the test tables are laid out."""
    return spark.read.format(fmt).load(table_path(root, name, layout, fmt))


# ---------------------------------------------------------------------------
# CSV folder -> table (SRC-2)
# ---------------------------------------------------------------------------

CORRUPT = "_corrupt_record"
#: So many paths of malformed files are broadcast at most.
BAD_FILES = 50_000


def csv_to_table(spark: SparkSession, path: str, schema: T.StructType | None = None, delimiter: str = ",",
                 use_first_row_as_header: bool = True, skip_files_with_errors: bool = True,
                 staging: str | None = None) -> DataFrame:
    """Convert a folder of CSV files to a table (SRC-2).

    With a header its names decide which column is which: ``schema`` gives types
    by name (columns that it lacks are dropped, those that the files lack are
    null), and without a schema all columns are strings.  The files of a folder
    share one header.  Without a header the schema is taken by position.

    With ``skip_files_with_errors`` one malformed row drops its whole file.
    Rows are parsed once in PERMISSIVE mode with the corrupt-record column and
    the source file path, staged to parquet (Spark refuses queries that touch
    only the corrupt column of a raw CSV scan).  The bad files are counted: up to
    ``BAD_FILES`` of them are broadcast, so that no row is shuffled; beyond that
    rows and bad files meet by file path.
    """
    fields = list(schema.fields) if schema else []
    if use_first_row_as_header or not fields:
        named = {f.name: f.dataType for f in fields}
        header = spark.read.option("header", str(bool(use_first_row_as_header)).lower()).option("sep", delimiter).csv(path).columns
        fields = [T.StructField(c, named.get(c, T.StringType())) for c in header]
    read_schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType(), True)])
    raw = (spark.read.schema(read_schema)
           .option("header", str(bool(use_first_row_as_header)).lower())
           .option("sep", delimiter)
           .option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT)
           .csv(path)
           .withColumn("_file", F.col("_metadata.file_path")))
    if schema:
        have = {f.name for f in fields}
        raw = raw.select(*[F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields],
                         CORRUPT, "_file")
    if not skip_files_with_errors:
        return raw.drop(CORRUPT, "_file")
    staging = staging or scratch_path(spark, f"csv_stage_{uuid.uuid4().hex}")
    raw.write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    bad = cut_lineage(staged.where(F.col(CORRUPT).isNotNull()).select("_file").distinct())
    few = bad.limit(BAD_FILES + 1).count() <= BAD_FILES
    return staged.join(F.broadcast(bad) if few else bad.hint("merge"), "_file", "left_anti").drop(CORRUPT, "_file")


# ---------------------------------------------------------------------------
# Whole files (SRC-3, SRC-4, SRC-5)
# ---------------------------------------------------------------------------

def _plain_path(path) -> Column:
    """A path without percent-encoding, as ``binaryFile`` gives it."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")


def list_files(spark: SparkSession, root: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """File metadata without reading contents (``content`` is pruned).

    Spark's file scans skip zero-length files; their names are taken from
    the file index the driver already holds and added with length 0.
    """
    r = spark.read.format("binaryFile")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(root)
    meta = files.select("path", "length", "modificationTime")
    indexed = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string").select(
        _plain_path(F.col("path")).alias("path"))
    empty = indexed.join(meta.select("path"), "path", "left_anti").select(
        "path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    return meta.unionByName(empty)


def scan_text(spark: SparkSession, root: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """Whole file as one string per row (SRC-3); a file that cannot be read
    gives ``""`` (listed files left-joined to the text read)."""
    # a file that cannot be read is skipped by the read and comes back from
    # the listing with empty content
    r = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    text = r.text(root, wholetext=True).select(_plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content"))
    files = list_files(spark, root, recursive, glob).select("path")
    return files.join(text, "path", "left").select("path", F.coalesce("content", F.lit("")).alias("content"))


def scan_binary_base64(spark: SparkSession, root: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """File bytes as base64 text without line breaks (SRC-4)."""
    r = spark.read.format("binaryFile")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(root).select("path", clean_base64("content").alias("content_base64"))


def list_paths(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Metadata rows for files and the directories above them (SRC-5).

    Output: ``name`` (relative to ``root``), ``contentLength``,
    ``lastModified``, ``isDirectory``.  Directories come from the distinct
    path prefixes of the files, so no second listing is needed.
    """
    files = list_files(spark, root, recursive)
    base = files.select(
        F.regexp_replace(F.col("path"), r"^[a-z]+:", "").alias("p"), "length", "modificationTime")
    root_norm = root.rstrip("/")
    rel = base.select(
        F.regexp_replace(F.col("p"), "^.*?" + re.escape(root_norm.split(":", 1)[-1]) + "/", "").alias("name"),
        F.col("length").alias("contentLength"),
        F.col("modificationTime").alias("lastModified"),
    )
    file_rows = rel.withColumn("isDirectory", F.lit(False))
    parts = F.split(F.col("name"), "/")
    dirs = (rel.where(F.size(parts) > 1)
            .select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                                          lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("name"),
                    "lastModified")
            .groupBy("name").agg(F.max("lastModified").alias("lastModified"))
            .select("name", F.lit(0).cast("long").alias("contentLength"), "lastModified",
                    F.lit(True).alias("isDirectory")))
    return file_rows.unionByName(dirs)


def read_item_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Item manifests (XML) as rows ``(name, workload, file, jobs)``, read with
    Spark's XML source, one row per ``<Item>`` element; input of the manifest
    name checks (VAL-5).  ``jobs`` are the names of all ``<ItemJobType>``
    elements of the manifest, wherever they stand (empty if there are none)."""
    schema = T.StructType([
        T.StructField("_TypeName", T.StringType()),
        T.StructField("Workload", T.StructType([T.StructField("_WorkloadName", T.StringType())]))])
    raw = spark.read.format("xml").option("rowTag", "Item").schema(schema).load(path)
    items = raw.select(F.col("_TypeName").alias("name"), F.col("Workload._WorkloadName").alias("workload"),
                       F.col("_metadata.file_path").alias("file"))
    named = T.StructType([T.StructField("_Name", T.StringType())])
    jobs = spark.read.format("xml").option("rowTag", "ItemJobType").schema(named).load(path).where(F.col("_Name").isNotNull())
    jobs = jobs.select(F.col("_metadata.file_path").alias("file"), "_Name").groupBy("file").agg(
        F.array_sort(F.collect_set("_Name")).alias("jobs"))
    return items.join(jobs, "file", "left").select("name", "workload", "file", F.coalesce("jobs", F.array().cast("array<string>")).alias("jobs"))


# ---------------------------------------------------------------------------
# JSON documents and pages (SRC-6, SRC-7)
# ---------------------------------------------------------------------------

def parse_json_col(text: Column | str, schema: T.DataType | str, default: Column | None = None) -> Column:
    """Parse JSON text; malformed text gives null (or ``default``) (SRC-6).

    For a struct schema the text is parsed once with a corrupt-record field:
    PERMISSIVE parsing would otherwise return a struct of nulls for bad text.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)  # noqa: SLF001 - DDL string to DataType
    t = _c(text)
    if isinstance(schema, T.StructType):
        with_bad = T.StructType(list(schema.fields) + [T.StructField("__bad", T.StringType(), True)])
        p = F.from_json(t, with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
        parsed = F.when(p.isNotNull() & p["__bad"].isNull(), p.dropFields("__bad"))
    else:
        parsed = F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema, {"mode": "PERMISSIVE"}))
    return parsed if default is None else F.coalesce(parsed, default)


def scan_json_docs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Package documents, one JSON document per file; unreadable documents
    keep their row with a null payload, empty files have none (SRC-6)."""
    raw = read_files(spark, path).where("octet_length(content) > 0").select("path", F.col("content").cast("string").alias("raw"))
    return raw.select("path", "raw", parse_json_col("raw", schema).alias("doc"))


def flatten_pages(pages: DataFrame, body_col: str, record_schema: T.StructType,
                  keep: list[str] | None = None) -> DataFrame:
    """Concatenate the records of every page (SRC-7).

    A page is ``{"value": [...], "continuationToken": ...}``; a bare array or
    a single object is accepted too.  One output row per record; a page that is
    no JSON object or array, or whose ``value`` is no list, has none.  Pages are
    parsed and exploded in parallel, never gathered.
    """
    body = js_trim(F.col(body_col))
    arr_t = T.ArrayType(record_schema)
    wrapped = F.from_json(body, T.StructType([T.StructField("value", arr_t, True)]))
    names = F.json_object_keys(body)  # null unless the page is a JSON object
    records = (F.when(body.startswith("["), F.from_json(body, arr_t))
               .when(wrapped["value"].isNotNull(), wrapped["value"])
               .when(names.isNotNull() & ~F.array_contains(names, "value"), F.array(F.from_json(body, record_schema)))
               .otherwise(F.array().cast(arr_t)))
    keep = keep or []
    return (pages.select(*keep, F.explode(records).alias("__r"))
            .select(*keep, "__r.*"))


def chain_pages(pages: DataFrame, token_col: str, next_col: str, count_col: str) -> DataFrame:
    """Order pages that are linked by continuation tokens (SRC-7).

    Adds to the pages ``chain`` (token of the first page), ``page_no`` (from 0),
    ``offset`` (records on the pages before) and ``chain_state``: ``complete`` if
    the last page has no continuation token (null or empty), ``broken`` if its
    token leads nowhere.  Pages whose tokens run in a circle, and those after
    them, have ``circular`` and no chain, number or offset.  Of pages with one
    token all but the smallest row are dropped, as are those without a token; of
    pages that lead to one page the smallest token is its predecessor.

    List ranking by pointer jumping: each round a page takes over the pages and
    records that its furthest known predecessor has before it, so rounds grow with
    the logarithm of the longest chain.  Only pages that have not reached the
    beginning of their chain are joined, and each round is checkpointed.
    """
    rest = [c for c in pages.columns if c != token_col]
    once = pages.where(F.col(token_col).isNotNull()).groupBy(token_col).agg(F.min(F.struct(*rest)).alias("__r")).select(token_col, *[F.col("__r")[c].alias(c) for c in rest])
    once = cut_lineage(once)
    lead = F.nullif(F.col(next_col), F.lit(""))
    links = once.where(lead.isNotNull()).groupBy(lead.alias("__to")).agg(F.min(F.struct(F.col(token_col).alias("t"), F.col(count_col).alias("n"))).alias("__prev"))
    state = cut_lineage(once.join(links, once[token_col] == links["__to"], "left").select(
        F.col(token_col).alias("id"), F.col("__prev.t").alias("far"), F.when(F.col("__prev").isNotNull(), 1).otherwise(0).cast("long").alias("page_no"),
        F.coalesce("__prev.n", F.lit(0)).cast("long").alias("offset"), F.coalesce("__prev.t", token_col).alias("chain")))
    left, total = state.where(F.col("far").isNotNull()).count(), state.count()
    rounds = max(1, total.bit_length())
    while left and rounds:
        hop = state.select(F.col("id").alias("__i"), F.col("far").alias("__f"), F.col("page_no").alias("__p"), F.col("offset").alias("__o"), F.col("chain").alias("__c"))
        open_ = state.where(F.col("far").isNotNull())
        moved = open_.join(hop, F.col("far") == F.col("__i")).select("id", F.col("__f").alias("far"), (F.col("page_no") + F.col("__p")).alias("page_no"),
                                                                    (F.col("offset") + F.col("__o")).alias("offset"), F.col("__c").alias("chain"))
        state = cut_lineage(state.where(F.col("far").isNull()).unionByName(moved))
        left, rounds = state.where(F.col("far").isNotNull()).count(), rounds - 1
    whole = once.join(state, once[token_col] == state["id"])
    circular = F.col("far").isNotNull()
    whole = whole.withColumns({c: F.when(~circular, F.col(c)) for c in ("chain", "page_no", "offset")})
    targets = once.select(F.col(token_col).alias("__t"))
    ends = whole.where(~circular).join(targets, lead == F.col("__t"), "left").groupBy(F.col("chain").alias("__chain")).agg(F.max(lead.isNotNull() & F.col("__t").isNull()).alias("__broken"))
    state_of = F.when(circular, "circular").when(F.col("__broken"), "broken").otherwise("complete")
    return whole.join(ends, whole["chain"] == ends["__chain"], "left").withColumn("chain_state", state_of).drop("id", "far", "__chain", "__broken")


# ---------------------------------------------------------------------------
# Payload and shortcut target resolution (SRC-8, SRC-9)
# ---------------------------------------------------------------------------



def resolve_payload(parts: DataFrame, files: DataFrame, type_col: str = "payloadType",
                    payload_col: str = "payload", file_path_col: str = "path",
                    file_content_col: str = "content_base64") -> DataFrame:
    """Give every definition part its base64 content (SRC-8).

    ``InlineBase64`` keeps the payload; ``AssetLink``, ``Link`` and
    ``OneLake`` payloads are paths into ``files`` (staged beforehand -- the
    job does no network I/O); any other type raises, and so does a path without
    content.  One equi-join on the path for the linked rows; inline rows skip the
    join entirely.  Of several contents of a path the smallest is taken.
    """
    t = F.col(type_col)
    checked = parts.withColumn(
        "__t", F.when(t.isin(*PAYLOAD_TYPES), t).otherwise(
            F.raise_error(F.concat(F.lit("Unsupported payload type: "), F.coalesce(t, F.lit("null"))))))
    inline = checked.where(F.col("__t") == "InlineBase64").withColumn("content", F.col(payload_col))
    linked = checked.where(F.col("__t") != "InlineBase64")
    f = files.groupBy(F.col(file_path_col).alias("__p")).agg(F.min(file_content_col).alias("__found"))
    missing = F.raise_error(F.concat(F.lit("No content for payload: "), F.coalesce(F.col(payload_col), F.lit("null"))))
    resolved = (linked.join(f, linked[payload_col] == f["__p"], "left")
                .withColumn("content", F.coalesce(F.col("__found"), missing)).drop("__p", "__found"))
    return inline.unionByName(resolved).drop("__t")


# Host of the lake's ABFS endpoint; deployments pass their own.
DEFAULT_LAKE_HOST = "lake.dfs.example.net"
# Field names of the shortcut target union.
TARGET_KINDS = ("oneLake", "amazonS3", "adlsGen2", "googleCloudStorage", "s3Compatible",
                "dataverse", "externalDataShare", "azureBlobStorage")


def _host(location: Column) -> Column:
    return F.regexp_extract(location, r"^[a-zA-Z0-9]+://([^/]+)", 1)


def _join_path(*parts: Column) -> Column:
    """Join path parts with single slashes (empty or null parts skipped)."""
    trimmed = [F.nullif(F.regexp_replace(p, "^/+|/+$", ""), F.lit("")) for p in parts]
    return F.concat_ws("/", *trimmed)


def _container_path(account_host: Column, subpath: Column, scheme: str) -> Column:
    sp = F.regexp_replace(subpath, "^/+", "")
    container = F.substring_index(sp, "/", 1)
    rest = F.when(F.instr(sp, "/") > 0, sp.substr(F.instr(sp, "/") + 1, F.lit(2**31 - 1))).otherwise(F.lit(""))
    return F.concat(F.lit(scheme + "://"), container, F.lit("@"), account_host,
                    F.when(rest != "", F.concat(F.lit("/"), rest)).otherwise(F.lit("")))


def resolve_source(target: Column | str, lake_host: str = DEFAULT_LAKE_HOST) -> Column:
    """Readable URI of a shortcut target (SRC-9); no credentials, no I/O.

    oneLake -> ``abfss://ws@<lake_host>/item/path``; amazonS3 / s3Compatible
    -> ``s3a://bucket/subpath``; adlsGen2 -> ``abfss://container@account/...``;
    azureBlobStorage -> ``wasbs://container@account/...``; googleCloudStorage
    -> ``gs://bucket/subpath``; dataverse -> ``domain/folder/table``;
    externalDataShare -> null.
    """
    t = _c(target)
    ol, s3, adls, gcs, s3c, dv, blob = (t["oneLake"], t["amazonS3"], t["adlsGen2"], t["googleCloudStorage"],
                                         t["s3Compatible"], t["dataverse"], t["azureBlobStorage"])
    s3_bucket = F.substring_index(_host(s3["location"]), ".", 1)
    gcs_bucket = F.substring_index(_host(gcs["location"]), ".", 1)
    return F.coalesce(
        F.when(ol.isNotNull(), F.concat(F.lit("abfss://"), ol["workspaceId"], F.lit("@" + lake_host + "/"),
                                        _join_path(ol["itemId"], ol["path"]))),
        F.when(s3.isNotNull(), F.concat(F.lit("s3a://"), _join_path(s3_bucket, s3["subpath"]))),
        F.when(s3c.isNotNull(), F.concat(F.lit("s3a://"), _join_path(s3c["bucket"], s3c["subpath"]))),
        F.when(adls.isNotNull(), _container_path(_host(adls["location"]), adls["subpath"], "abfss")),
        F.when(blob.isNotNull(), _container_path(_host(blob["location"]), blob["subpath"], "wasbs")),
        F.when(gcs.isNotNull(), F.concat(F.lit("gs://"), _join_path(gcs_bucket, gcs["subpath"]))),
        F.when(dv.isNotNull(), _join_path(dv["environmentDomain"], dv["deltaLakeFolder"], dv["tableName"])),
    )
