"""JOB-2 end to end: package documents to rendered parts on storage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as docs
from ..functions.text import intercept_base64, sanitize_name, suffix_name
from ..session import scratch_path
from ..sources.files import export_files
from ..sources.tables import resolve_payload

_DEFINITION = "struct<type string, config struct<id string, replacements map<string,string>>>"
_PACKAGE = f"""struct<id string,
 deploymentConfig struct<type string, location string, suffixItemNames boolean, parameters map<string, struct<value string>>,
  globalInterceptors map<string, {_DEFINITION}>>,
 items array<struct<type string, displayName string, definition struct<
  parts array<struct<path string, payload string, payloadType string>>, interceptor {_DEFINITION}>>>>"""


def ordered_entries(replacements: Column) -> Column:
    """A replacement map's entries in the order in which they apply: integer keys by value, then the others as written."""
    entries = F.map_entries(replacements)
    number = lambda e: F.when(e["key"].rlike("^(0|[1-9][0-9]{0,9})$"), e["key"].cast("long"))
    is_number = lambda e: F.coalesce(number(e) < 2**32 - 1, F.lit(False))
    first = F.array_sort(F.transform(F.filter(entries, is_number), lambda e: F.struct(number(e).alias("n"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.concat(F.transform(first, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))), F.filter(entries, lambda e: ~is_number(e)))


def final_definition(definition: Column, shared: Column) -> Column:
    """The definition that a chain of references ends in; still a reference, or null, if the chain has no end."""
    hops = F.sequence(F.lit(0), F.coalesce(F.size(shared), F.lit(0)))
    return F.aggregate(hops, definition, lambda d, _: F.when(d["type"] == "Reference", F.try_element_at(shared, d["config"]["id"])).otherwise(d))


def replaced(text: Column, definition: Column, variables: Column) -> Column:
    """``text`` with the definition's replacements, each applied to the previous result (STR-1); values naming a variable take its value."""
    def value(v: Column) -> Column:
        return F.coalesce(F.nullif(F.try_element_at(variables, v), F.lit("")), v)

    return F.aggregate(F.coalesce(ordered_entries(definition["config"]["replacements"]), F.array().cast("array<struct<key:string,value:string>>")), text,
                       lambda done, e: F.replace(done, e["key"], value(e["value"])))


def _kept(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back; a checkpoint would not be compressed."""
    path = scratch_path(df.sparkSession, f"packages-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def render_packages(packages: DataFrame, files: DataFrame, key: str, raw_col: str, deployment_id: str, workspace_id: str,
                    folder_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rendered parts, rejected packages) of package documents, one JSON text per row.

    Each text is validated (VAL-3); packages with violations, or with references
    that never end, are returned with their messages and not rendered.  The
    others get the deployment's defaults (VAL-4); their items become rows, their
    parts' payloads are resolved from ``files`` (SRC-8: ``path``,
    ``content_base64``), and each item's interceptor, one of its own or the
    package's shared ones, is applied to them (STR-2) with the variables of the
    deployment (``{{DEPLOYMENT_ID}}``, ``{{PACKAGE_ID}}``, ``{{WORKSPACE_ID}}``,
    ``{{FOLDER_ID}}``) and the package's parameters.  Null and empty contents stay.

    Parts: ``key``, ``item`` (its place), ``item_name`` (with the deployment's id
    where names are suffixed), ``item_type``, ``path``, ``content`` (base64) and
    ``file``, the place to write it to.  Validated packages are written
    once, compressed; only linked payloads are shuffled, by their path.
    """
    own = {"deployment": F.col(deployment_id), "workspace": F.col(workspace_id), "folder": F.col(folder_id) if folder_id else F.lit(None)}
    seen = packages.select(key, *[c.cast("string").alias(f"__{n}") for n, c in own.items()], F.from_json(raw_col, _PACKAGE).alias("__doc"),
                           docs.validate_package(raw_col).alias("__errors"))
    shared = F.col("__doc.deploymentConfig.globalInterceptors")

    def endless(item: Column, i: Column) -> Column:
        given = item["definition"]["interceptor"]
        ends = F.coalesce(final_definition(given, shared)["type"] != "Reference", F.lit(False))
        return F.when(given.isNotNull() & ~ends, F.concat(F.lit("item "), i.cast("string"), F.lit(": interceptor references have no end")))

    chains = F.filter(F.transform(F.col("__doc.items"), endless), lambda m: m.isNotNull())
    checked = _kept(seen.withColumn("__errors", F.concat("__errors", F.when(F.size("__errors") == 0, F.coalesce(chains, F.array().cast("array<string>")))
                                                         .otherwise(F.array().cast("array<string>"))))
                    .withColumn("__doc", F.when(F.size("__errors") == 0, F.col("__doc"))))
    rejected = checked.where(F.size("__errors") > 0).select(key, F.col("__errors").alias("errors"))
    fixed = F.create_map(F.lit(docs.DEPLOYMENT_ID), F.col("__deployment"), F.lit(docs.PACKAGE_ID), F.col("__doc.id"),
                         F.lit(docs.WORKSPACE_ID), F.col("__workspace"), F.lit(docs.FOLDER_ID), F.col("__folder"))
    given = F.coalesce(F.col("__doc.deploymentConfig.parameters"), F.create_map().cast("map<string,struct<value:string>>"))
    named = F.transform_values(F.transform_keys(given, lambda k, _: F.concat(F.lit("{{"), k, F.lit("}}"))), lambda _, p: p["value"])
    variables = F.map_concat(F.map_filter(named, lambda k, _: ~k.isin(docs.DEPLOYMENT_ID, docs.PACKAGE_ID, docs.WORKSPACE_ID, docs.FOLDER_ID)), fixed)
    config = docs.apply_defaults(F.col("__doc.deploymentConfig"))
    items = (checked.where(F.size("__errors") == 0)
             .select(key, "__deployment", config.alias("__config"), variables.alias("__variables"), shared.alias("__shared"), F.col("__doc.items").alias("__items"))
             .select(key, "__deployment", "__config", "__variables", "__shared", F.posexplode("__items").alias("item", "__item"))
             .select(key, "item", suffix_name("__item.displayName", F.col("__deployment"), F.col("__config.suffixItemNames")).alias("item_name"),
                     F.col("__item.type").alias("item_type"), "__variables", final_definition(F.col("__item.definition.interceptor"), F.col("__shared")).alias("__how"),
                     F.explode("__item.definition.parts").alias("__part")))
    parts = items.select(key, "item", "item_name", "item_type", "__variables", "__how", "__part.*")
    done = resolve_payload(parts, files)
    content = F.when(F.col("__how").isNotNull() & (F.length("content") > 0),
                     intercept_base64("content", lambda t: replaced(t, F.col("__how"), F.col("__variables")))).otherwise(F.col("content"))
    place = F.concat_ws("/", F.col(key).cast("string"), F.concat(F.col("item").cast("string"), F.lit("_"), sanitize_name("item_name")), F.col("path"))
    return done.select(key, "item", "item_name", "item_type", "path", content.alias("content"), place.alias("file")), rejected


def write_packages(parts: DataFrame, root: str) -> None:
    """Write each rendered part to its ``file`` below ``root``; files show only when all are written (SNK-3)."""
    export_files(parts, root, "file", "content")
