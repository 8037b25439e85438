"""Package-document functions: definitions, variables, value substitution,
validation and defaults (JSN-1, JSN-2, STR-3, STR-12, STR-13, VAL-3 .. VAL-5),
plus the text-interceptor registry (UDF-1).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _c, replace_many

# ---------------------------------------------------------------------------
# Definitions and outputs (JSN-1, JSN-2)
# ---------------------------------------------------------------------------


def decode_definition(parts: Column | str, path: str, schema) -> Column:
    """Pick the part with ``path``, base64 -> UTF-8 -> JSON (JSN-1).
    Missing part or malformed JSON gives null."""
    part = F.try_element_at(F.filter(_c(parts), lambda p: p["path"] == F.lit(path)), F.lit(1))
    from ..sources.tables import parse_json_col
    body = F.decode(F.unbase64(part["payload"]), "UTF-8")
    return parse_json_col(body, schema)


def pick_output(data: Column | str) -> Column:
    """``text/plain`` if present and not empty, else ``application/json`` as
    JSON text (a string keeps its quotes), else the whole object (JSN-2)."""
    d = _c(data)
    found = F.try_variant_get(F.try_parse_json(d), "$['application/json']", "variant")
    as_json = F.when(F.schema_of_variant(found) == "STRING", F.to_json(found)).otherwise(
        F.get_json_object(d, "$['application/json']"))
    return F.coalesce(F.nullif(F.get_json_object(d, "$['text/plain']"), F.lit("")), as_json, d)


# ---------------------------------------------------------------------------
# Whole-value substitution at any depth (STR-3)
# ---------------------------------------------------------------------------


def _subst_string(x: Column, mapping: Column) -> Column:
    return F.coalesce(F.nullif(mapping[x], F.lit("")), x)


def substitute_expr(x: Column, dtype: T.DataType, mapping: Column) -> Column:
    """Rebuild ``x`` of type ``dtype`` with every string value that equals a
    key of ``mapping`` replaced (empty replacement keeps the original); keys
    of maps and field names are untouched."""
    if isinstance(dtype, T.StringType):
        return _subst_string(x, mapping)
    if isinstance(dtype, T.StructType):
        fields = [substitute_expr(x[f.name], f.dataType, mapping).alias(f.name) for f in dtype.fields]
        return F.when(x.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(x, lambda e: substitute_expr(e, dtype.elementType, mapping))
    if isinstance(dtype, T.MapType):
        return F.transform_values(x, lambda k, v: substitute_expr(v, dtype.valueType, mapping))
    return x


def as_map(mapping: Mapping[str, str] | Column) -> Column:
    if isinstance(mapping, Column):
        return mapping
    if not mapping:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def substitute_values(df: DataFrame, mapping: Mapping[str, str] | Column, cols=None) -> DataFrame:
    """Apply :func:`substitute_expr` to the given (default: all) columns."""
    m = as_map(mapping)
    cols = set(cols or df.columns)
    return df.select(*[substitute_expr(F.col(f.name), f.dataType, m).alias(f.name) if f.name in cols
                       else F.col(f.name) for f in df.schema.fields])


# ---------------------------------------------------------------------------
# Variables (STR-12) and reference inversion (STR-13)
# ---------------------------------------------------------------------------

# Deployment variable names.
DEPLOYMENT_ID, PACKAGE_ID, WORKSPACE_ID, FOLDER_ID, ITEM_ID = (
    "{{DEPLOYMENT_ID}}", "{{PACKAGE_ID}}", "{{WORKSPACE_ID}}", "{{FOLDER_ID}}", "{{ITEM_ID}}")


def build_variables(deployments: DataFrame, items: DataFrame, key: str, item_name: str, item_id: str,
                    item_seq: str, deployment_id: str, package_id: str, workspace_id: str,
                    folder_id: str | None = None, params: str | None = None) -> DataFrame:
    """Long-form variable rows ``(key, name, value)`` per deployment (STR-12).

    Deployment variables, ``{{<param>}}`` for each parameter pair,
    ``{{ITEM_ID_<name>}}`` and ``{{<name>}}`` per item, and ``{{ITEM_ID}}``
    = the id of the last item in ``item_seq`` order (``max_by``, one
    aggregation pass, no window over a whole deployment).
    """
    base = deployments.select(
        key, F.explode(F.array(
            F.struct(F.lit(DEPLOYMENT_ID).alias("name"), F.col(deployment_id).cast("string").alias("value")),
            F.struct(F.lit(PACKAGE_ID).alias("name"), F.col(package_id).cast("string").alias("value")),
            F.struct(F.lit(WORKSPACE_ID).alias("name"), F.col(workspace_id).cast("string").alias("value")),
            F.struct(F.lit(FOLDER_ID).alias("name"),
                     (F.col(folder_id) if folder_id else F.lit(None)).cast("string").alias("value")),
        )).alias("v")).select(key, "v.name", "v.value")
    out = base
    if params:
        p = deployments.select(key, F.explode(params).alias("p")).select(
            key, F.concat(F.lit("{{"), F.col("p")[0], F.lit("}}")).alias("name"), F.col("p")[1].alias("value"))
        out = out.unionByName(p)
    it = items.select(key, F.col(item_name).alias("n"), F.col(item_id).cast("string").alias("i"), item_seq)
    per_item = it.select(key, F.explode(F.array(
        F.struct(F.concat(F.lit("{{ITEM_ID_"), "n", F.lit("}}")).alias("name"), F.col("i").alias("value")),
        F.struct(F.concat(F.lit("{{"), "n", F.lit("}}")).alias("name"), F.col("i").alias("value")),
    )).alias("v")).select(key, "v.name", "v.value")
    last = it.groupBy(key).agg(F.max_by("i", item_seq).alias("value")).select(
        key, F.lit(ITEM_ID).alias("name"), "value")
    return out.unionByName(per_item).unionByName(last)


def invert_references(items: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Rows ``(search, value)`` mapping an item id to ``{{name}}`` (STR-13),
    ready for ``ordered_remap`` when capturing a package."""
    return items.select(F.col(id_col).cast("string").alias("search"),
                        F.concat(F.lit("{{"), F.col(name_col), F.lit("}}")).alias("value"))


# ---------------------------------------------------------------------------
# Package validation and defaults (VAL-3, VAL-4, VAL-5)
# ---------------------------------------------------------------------------

# Package schema keys and enumerations (as the package format defines them).
TOP_LEVEL_KEYS = ("$schema", "id", "displayName", "description", "icon", "deploymentConfig", "items", "data")
ID_PATTERN = r"^[a-zA-Z0-9][a-zA-Z0-9\-_]*[a-zA-Z0-9]$"
DEPLOYMENT_TYPES = ("UX", "SparkNotebook")
DEPLOYMENT_LOCATIONS = ("Default", "NewWorkspace")
PAYLOAD_TYPES = ("AssetLink", "Link", "InlineBase64", "OneLake")
INTERCEPTOR_TYPES = ("Reference", "StringReplacement")
DEPLOYMENT_POLICIES = ("FailOnError", "IgnoreErrors")

PACKAGE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("displayName", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("deploymentConfig", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("suffixItemNames", T.BooleanType()),
    ])),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("displayName", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("definition", T.StructType([
            T.StructField("parts", T.ArrayType(T.StructType([
                T.StructField("path", T.StringType()),
                T.StructField("payload", T.StringType()),
                T.StructField("payloadType", T.StringType()),
            ]))),
            T.StructField("interceptor", T.StructType([
                T.StructField("type", T.StringType()),
                T.StructField("config", T.MapType(T.StringType(), T.StringType())),
            ])),
        ])),
    ]))),
])


# Fields of the package format's objects (name: kind), required fields and enumerations.
SHAPES = {
    "package": ({"$schema": "string", "id": "string", "displayName": "string", "description": "string", "icon": "string",
                 "deploymentConfig": "object", "items": "array", "data": "array"}, ()),
    "deploymentConfig": ({"type": "string", "location": "string", "deploymentFile": "object", "suffixItemNames": "boolean",
                          "parameters": "object", "globalInterceptors": "object", "onFinishJobs": "array"}, ()),
    "deploymentFile": ({"payloadType": "string", "payload": "string"}, ("payloadType", "payload")),
    "parameter": ({"type": "string", "value": "string", "displayName": "string", "description": "string"}, ("type",)),
    "onFinishJob": ({"workspaceId": "string", "itemId": "string", "jobType": "string", "deploymentPolicy": "string", "executionData": "any"},
                    ("itemId", "jobType", "deploymentPolicy")),
    "item": ({"type": "string", "displayName": "string", "description": "string", "installType": "string", "definition": "object",
              "data": "object", "creationPayload": "any", "schedules": "array", "shortcuts": "array"}, ()),
    "definition": ({"format": "string", "parts": "array", "interceptor": "object", "creationMode": "string"}, ()),
    "data": ({"files": "array", "interceptor": "object"}, ()),
    "packageData": ({"files": "array", "interceptor": "object", "workspaceId": "string", "itemId": "string", "shortcuts": "array"}, ()),
    "part": ({"payloadType": "string", "payload": "string", "path": "string"}, ("payload", "path")),
    "file": ({"payloadType": "string", "payload": "string", "path": "string"}, ("payloadType", "payload", "path")),
    "schedule": ({"enabled": "boolean", "jobType": "string", "configuration": "any"}, ("enabled", "jobType", "configuration")),
    "shortcut": ({"conflictPolicy": "string", "configuration": "any"}, ("configuration",)),
    "interceptor": ({"type": "string", "config": "object"}, ("config",)),
}
ENUMS = {
    ("item", "installType"): ("Default", "OnFinishJob"),
    ("definition", "creationMode"): ("WithoutDefinition", "WithDefinition", "CreateAndUpdateDefinition"),
    ("deploymentFile", "payloadType"): PAYLOAD_TYPES,
    ("file", "payloadType"): PAYLOAD_TYPES,
    ("onFinishJob", "deploymentPolicy"): DEPLOYMENT_POLICIES,
}


def _of(v: Column, field: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{field}']", kind)


def _is_kind(v: Column, kind: str) -> Column:
    found = F.schema_of_variant(v)
    return found.startswith(kind.upper()) if kind in ("object", "array") else found == kind.upper()


def _shape(v: Column, where: Column, name: str) -> Column:
    """Messages on one object: unknown keys, missing required fields, wrong kinds, values outside an enumeration."""
    fields, required = SHAPES[name]
    keys = F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))
    unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, fields)))), lambda k: F.concat(where, F.lit(": unknown key: "), k))
    checks = [F.when(_of(v, f).isNull(), F.concat(where, F.lit(f": missing {f}"))) for f in required]
    checks += [F.when(_of(v, f).isNotNull() & ~_is_kind(_of(v, f), kind), F.concat(where, F.lit(f": {f} must be of type {kind}")))
               for f, kind in fields.items() if kind != "any"]
    checks += [F.when(~_of(v, f, "string").isin(*values), F.concat(where, F.lit(f": invalid {f} "), _of(v, f, "string")))
               for (own, f), values in ENUMS.items() if own == name]
    return F.when(_is_kind(v, "object"), F.concat(unknown, F.array(*checks) if checks else F.array().cast("array<string>")) if name != "package"
                  else F.array(*checks))


def _each(v: Column, field: str, check) -> Column:
    """``check(element, number)`` for each element of an array field."""
    none = F.try_variant_get(F.parse_json(F.lit("[]")), "$", "array<variant>")
    return F.flatten(F.transform(F.coalesce(_of(v, field, "array<variant>"), none), check))


def _interceptor(v: Column, where: Column, known: Column) -> Column:
    """Messages on an interceptor: its shape, what its type asks of ``config``, and whether a reference resolves."""
    config = _of(v, "config")
    kind, ref = _of(v, "type", "string"), _of(config, "id", "string")
    values = F.map_values(F.try_variant_get(config, "$.replacements", "map<string,variant>"))
    say = lambda text: F.concat(where, F.lit(f": {text}"))
    return F.when(v.isNotNull(), F.concat(_shape(v, where, "interceptor"), F.array(
        F.when((kind == "Reference") & ref.isNull(), say("reference without an id")),
        F.when((kind == "Reference") & ref.isNotNull() & ~F.array_contains(known, ref), F.concat(say("no global interceptor "), ref)),
        F.when((kind == "StringReplacement") & values.isNull(), say("replacements must be of type object")),
        F.when((kind == "StringReplacement") & F.exists(values, lambda x: F.schema_of_variant(x) != "STRING"), say("replacement values must be strings")))))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: as a lambda variable it isn't copied to every place that reads it."""
    return F.transform(F.array(value), use)[0]


def package_structure(raw: Column) -> Column:
    """Messages on the structure of a package below its top level (part of VAL-3); the text is parsed once."""
    return _once(F.try_parse_json(raw), lambda v: _once(_of(v, "deploymentConfig"), lambda config: _structure(v, config)))


def _structure(v: Column, config: Column) -> Column:
    known = F.coalesce(F.json_object_keys(F.to_json(_of(config, "globalInterceptors"))), F.array().cast("array<string>"))
    label = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    num = lambda i: i.cast("string")
    none = F.array().cast("array<string>")
    some = lambda *lists: F.concat(*[F.coalesce(x, none) for x in lists])

    def named(field: str, check) -> Column:
        entries = F.map_entries(F.try_variant_get(config, f"$.{field}", "map<string,variant>"))
        return F.flatten(F.transform(F.array_sort(F.map_keys(F.try_variant_get(config, f"$.{field}", "map<string,variant>"))),
                                     lambda k: check(F.filter(entries, lambda e: e["key"] == k)[0]["value"], k)))

    def content(d: Column, where: Column, shape: str) -> Column:
        return some(F.when(d.isNotNull(), _shape(d, where, shape)),
                    _each(d, "files", lambda x, i: F.coalesce(_shape(x, label(where, " file ", num(i)), "file"), none)),
                    _interceptor(_of(d, "interceptor"), label(where, " interceptor"), known))

    def item(x: Column, i: Column) -> Column:
        where, definition = label("item ", num(i)), _of(x, "definition")
        return some(F.coalesce(_shape(x, where, "item"), F.array(label(where, " must be of type object"))),
                    F.when(definition.isNotNull(), _shape(definition, label(where, " definition"), "definition")),
                    _each(definition, "parts", lambda p, j: F.coalesce(_shape(p, label(where, " part ", num(j)), "part"), none)),
                    _interceptor(_of(definition, "interceptor"), label(where, " interceptor"), known),
                    content(_of(x, "data"), label(where, " data"), "data"),
                    _each(x, "schedules", lambda s, j: F.coalesce(_shape(s, label(where, " schedule ", num(j)), "schedule"), none)),
                    _each(x, "shortcuts", lambda s, j: F.coalesce(_shape(s, label(where, " shortcut ", num(j)), "shortcut"), none)))

    found = some(_shape(v, F.lit("package"), "package"),
                 F.when(config.isNotNull(), _shape(config, F.lit("deploymentConfig"), "deploymentConfig")),
                 F.when(_of(config, "deploymentFile").isNotNull(), _shape(_of(config, "deploymentFile"), F.lit("deploymentFile"), "deploymentFile")),
                 named("parameters", lambda x, k: F.coalesce(_shape(x, label("parameter ", k), "parameter"), none)),
                 named("globalInterceptors", lambda x, k: F.coalesce(_interceptor(x, label("global interceptor ", k), known), none)),
                 _each(config, "onFinishJobs", lambda x, i: F.coalesce(_shape(x, label("onFinishJob ", num(i)), "onFinishJob"), none)),
                 _each(v, "items", item),
                 _each(v, "data", lambda x, i: some(content(x, label("data ", num(i)), "packageData"), _each(
                     x, "shortcuts", lambda s, j: F.coalesce(_shape(s, label("data ", num(i), " shortcut ", num(j)), "shortcut"), none)))))
    return F.when(_is_kind(v, "object"), found).otherwise(none)


def validate_package(raw: Column | str) -> Column:
    """Array of violation messages for one package JSON text, fixed order (VAL-3).

    Checks: parse, required ``id``/``displayName``, id pattern, unknown
    top-level keys, deployment type and location enums, each item's required
    fields and each part's payload type, interceptor type; then unknown keys,
    required fields, kinds and enumerations of everything below, interceptor
    configurations, and that references name a global interceptor.
    """
    r = _c(raw)
    parsed = F.struct(F.from_json(r, PACKAGE_SCHEMA, {"mode": "PERMISSIVE"}).alias("doc"),
                      F.from_json(r, "map<string,string>", {"mode": "PERMISSIVE"}).alias("top"))
    found = F.concat(_once(parsed, lambda p: _top_level(p["doc"], p["top"])), package_structure(r))
    return F.filter(found, lambda m: m.isNotNull())


def _top_level(doc: Column, top: Column) -> Column:
    """Messages on the top level, the deployment's enumerations, items and their parts (part of VAL-3)."""
    is_obj = top.isNotNull()
    keys = F.coalesce(F.map_keys(top), F.array().cast("array<string>"))
    allowed = F.array(*[F.lit(k) for k in TOP_LEVEL_KEYS])
    unknown = F.transform(F.array_sort(F.array_except(keys, allowed)), lambda k: F.concat(F.lit("unknown key: "), k))
    dc = doc["deploymentConfig"]
    fixed = F.array(
        F.when(~is_obj, F.lit("not a JSON object")),
        F.when(is_obj & doc["id"].isNull(), F.lit("missing id")),
        F.when(doc["id"].isNotNull() & ~doc["id"].rlike(ID_PATTERN), F.lit("invalid id")),
        F.when(is_obj & doc["displayName"].isNull(), F.lit("missing displayName")),
        F.when(F.length(doc["displayName"]) == 0, F.lit("empty displayName")),
        F.when(dc["type"].isNotNull() & ~dc["type"].isin(*DEPLOYMENT_TYPES),
               F.concat(F.lit("invalid deployment type: "), dc["type"])),
        F.when(dc["location"].isNotNull() & ~dc["location"].isin(*DEPLOYMENT_LOCATIONS),
               F.concat(F.lit("invalid location: "), dc["location"])),
    )
    items = F.coalesce(F.when(is_obj, doc["items"]), F.array().cast(PACKAGE_SCHEMA["items"].dataType))
    item_msgs = F.flatten(F.transform(items, lambda it, i: F.concat(
        F.array(
            F.when(it["type"].isNull(), F.concat(F.lit("item "), i.cast("string"), F.lit(": missing type"))),
            F.when(it["displayName"].isNull() | (F.length(it["displayName"]) == 0),
                   F.concat(F.lit("item "), i.cast("string"), F.lit(": missing displayName"))),
            F.when(it["description"].isNull(),
                   F.concat(F.lit("item "), i.cast("string"), F.lit(": missing description"))),
            F.when(it["definition"]["interceptor"].isNotNull()
                   & ~F.coalesce(it["definition"]["interceptor"]["type"].isin(*INTERCEPTOR_TYPES), F.lit(False)),
                   F.concat(F.lit("item "), i.cast("string"), F.lit(": invalid interceptor type"))),
        ),
        F.transform(F.coalesce(it["definition"]["parts"], F.array()), lambda p: F.when(
            ~F.coalesce(p["payloadType"].isin(*PAYLOAD_TYPES), F.lit(False)),
            F.concat(F.lit("item "), i.cast("string"), F.lit(": invalid payloadType "),
                     F.coalesce(p["payloadType"], F.lit("null"))))),
    )))
    return F.concat(fixed, unknown, item_msgs)


class PackageConfigError(ValueError):
    pass


def apply_defaults(cfg: Column | str) -> Column:
    """Deployment config defaults (VAL-4): type -> UX when missing, unknown
    type is an error; location -> Default unless NewWorkspace; suffix = the
    location is Default, unless given."""
    c = _c(cfg)
    t = c["type"]
    typ = (F.when(t.isNull(), F.lit("UX")).when(t.isin(*DEPLOYMENT_TYPES), t)
           .otherwise(F.raise_error(F.concat(F.lit("Unsupported deployment type: "), t))))
    loc = F.when(c["location"] == "NewWorkspace", F.lit("NewWorkspace")).otherwise(F.lit("Default"))
    suffix = F.coalesce(c["suffixItemNames"], loc == "Default")
    return F.struct(typ.cast("string").alias("type"), loc.alias("location"), suffix.alias("suffixItemNames"))


def check_manifest_names(items: DataFrame, workload_name: str | Column, item_col: str = "name",
                         parent_col: str = "workload", jobs_col: str | None = None) -> DataFrame:
    """Manifest name checks (VAL-5), one row per violation:

    * the item's workload name differs from the workload's (``workload name
      mismatch``);
    * the item name does not start with ``<item's workload>.``
      (``item name lacks prefix``), case-sensitive;
    * a job type name does not start with ``<item name>.``
      (``job name lacks prefix: <job>``).
    """
    wl = workload_name if isinstance(workload_name, Column) else F.lit(workload_name)
    name, parent = F.col(item_col), F.col(parent_col)
    item_rows = items.select(
        name.alias("name"),
        F.filter(F.array(
            F.when(~F.coalesce(parent == wl, F.lit(False)), F.lit("workload name mismatch")),
            F.when(~F.coalesce(name.startswith(F.concat(parent, F.lit("."))), F.lit(False)),
                   F.lit("item name lacks prefix")),
        ), lambda m: m.isNotNull()).alias("errs"))
    out = item_rows.select("name", F.explode("errs").alias("error"))
    if jobs_col:
        jobs = items.select(name.alias("name"), F.explode(jobs_col).alias("job"))
        bad = jobs.where(~F.coalesce(F.col("job").startswith(F.concat(F.col("name"), F.lit("."))), F.lit(False)))
        out = out.unionByName(bad.select("name", F.concat(F.lit("job name lacks prefix: "), F.col("job"))
                                         .alias("error")))
    return out


# ---------------------------------------------------------------------------
# Text interceptors (UDF-1)
# ---------------------------------------------------------------------------

Interceptor = Callable[[Column], Column]
_FACTORIES: dict[str, Callable[..., Interceptor]] = {}


def register_interceptor(type_name: str):
    """Register a factory ``(config, variables) -> (Column -> Column)``."""
    def deco(factory):
        _FACTORIES[type_name] = factory
        return factory
    return deco


@register_interceptor("StringReplacement")
def _string_replacement(config: Mapping, variables: Mapping[str, str | Column] | None = None) -> Interceptor:
    reps = config.get("replacements") or {}
    return lambda col: replace_many(col, reps, variables)


class InterceptorError(ValueError):
    pass


def resolve_definition(definition: Mapping, global_interceptors: Mapping[str, Mapping] | None = None) -> Mapping:
    """The definition that a chain of ``Reference`` definitions ends in; cycles and unknown ids are errors."""
    seen: list[str] = []
    while definition.get("type") == "Reference":
        ref = (definition.get("config") or {}).get("id")
        if ref in seen:
            raise InterceptorError(f"interceptor reference cycle: {' -> '.join((*seen, ref))}")
        target = (global_interceptors or {}).get(ref)
        if target is None:
            raise InterceptorError(f"global interceptor not found: {ref}")
        seen.append(ref)
        definition = target
    return definition


def build_interceptor(definition: Mapping, global_interceptors: Mapping[str, Mapping] | None = None,
                      variables: Mapping[str, str | Column] | None = None) -> Interceptor:
    """Resolve an interceptor definition to a Column function before planning.

    ``Reference`` points at a global interceptor by id; an unknown type or id is
    an error.  A variable may be a column with a value for each row.
    """
    final = resolve_definition(definition, global_interceptors)
    t = final.get("type")
    if t not in _FACTORIES:
        raise InterceptorError(f"Unsupported interceptor type: {t}")
    return _FACTORIES[t](final.get("config") or {}, variables)
