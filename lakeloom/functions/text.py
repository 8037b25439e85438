"""String column functions (STR-1 .. STR-14).

All functions take and return ``Column`` objects and use only built-in Spark
expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# Ordered replacement (STR-1) and its helpers
# ---------------------------------------------------------------------------

def js_object_order(keys: Iterable[str]) -> list[str]:
    """Key order of a JavaScript object: integer-like keys ascending, then
    the other keys in insertion order (rule R4)."""
    keys = list(keys)
    ints = [k for k in keys if re.fullmatch(r"0|[1-9][0-9]*", k) and int(k) < 2**32 - 1]
    rest = [k for k in keys if k not in set(ints)]
    return sorted(ints, key=int) + rest


def ordered_entries(replacements: Mapping[str, str] | Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Normalise a replacement config into an explicit ordered list."""
    if isinstance(replacements, Mapping):
        return [(k, replacements[k]) for k in js_object_order(replacements.keys())]
    return [(k, v) for k, v in replacements]


def resolve_values(entries: Sequence[tuple[str, str]], variables: Mapping[str, str | Column] | None) -> list[tuple[str, str | Column]]:
    """A replacement value that names a non-empty variable is replaced by it.

    A variable may be a column: it then has its own value in each row, and where
    that is null or empty the replacement value stays.
    """
    def value(v: str) -> str | Column:
        found = (variables or {}).get(v)
        if isinstance(found, Column):
            return F.coalesce(F.nullif(found, F.lit("")), F.lit(v))
        return found or v

    return [(k, value(v)) for k, v in entries]


def require_text(text: ColumnOrName, message: str = "Content to intercept cannot be empty") -> Column:
    """Raise for null or empty text, else pass the text through."""
    t = _c(text)
    return F.when(t.isNull() | (t == F.lit("")), F.raise_error(F.lit(message))).otherwise(t)


def replace_many(text: ColumnOrName, replacements, variables: Mapping[str, str | Column] | None = None,
                 check_empty: bool = True) -> Column:
    """Apply literal replacements in order, each to the previous output (STR-1).

    ``replacements`` is a mapping (JavaScript key order applies) or an ordered
    list of ``(search, value)`` pairs.  Search strings are literal, every
    occurrence is replaced, and ``$&``-style tokens in values stay literal.
    """
    out = require_text(text) if check_empty else _c(text)
    for search, value in resolve_values(ordered_entries(replacements), variables):
        if search == "":
            continue
        out = F.replace(out, F.lit(search), F.lit(value))
    return out


# ---------------------------------------------------------------------------
# Base64 content interception (STR-2)
# ---------------------------------------------------------------------------

def clean_base64(b: ColumnOrName) -> Column:
    """``base64`` without the CR/LF line breaks Spark inserts every 76 chars."""
    return F.translate(F.base64(_c(b)), "\r\n", "")


def text_to_base64(text: ColumnOrName, charset: str = "UTF-8") -> Column:
    return clean_base64(F.encode(_c(text), charset))


def intercept_base64(b64: ColumnOrName, f) -> Column:
    """Decode one byte to one character, apply ``f``, encode back (STR-2).

    Output characters outside Latin-1 raise, like the reference's ``btoa``.
    Empty input raises as well.
    """
    decoded = F.decode(F.unbase64(require_text(b64)), "ISO-8859-1")
    return clean_base64(F.encode(f(decoded), "ISO-8859-1"))


# ---------------------------------------------------------------------------
# Names and paths (STR-4 .. STR-8, STR-11)
# ---------------------------------------------------------------------------

# Characters not allowed in item names, default name length, and
# the folder that marks a table.
INVALID_NAME_CHARS = r'[<>:"/\\|?*]'
DEFAULT_NAME_LENGTH = 100
DELTA_LOG_SUFFIX = "/_delta_log"


def sanitize_name(s: ColumnOrName, n: int = DEFAULT_NAME_LENGTH) -> Column:
    """Replace ``<>:"/\\|?*`` and whitespace runs by ``_``, collapse and trim
    underscores, then cut to ``n`` characters (0 means 100) (STR-4)."""
    x = F.regexp_replace(_c(s), INVALID_NAME_CHARS, "_")
    x = F.regexp_replace(x, r"\s+", "_")
    x = F.regexp_replace(x, r"_{2,}", "_")
    x = F.regexp_replace(x, r"^_+|_+$", "")
    return F.substring(x, 1, n or DEFAULT_NAME_LENGTH)


def strip_delta_log(path: ColumnOrName) -> Column:
    """Drop a trailing ``/_delta_log`` segment."""
    return F.regexp_replace(_c(path), "/_delta_log$", "")


def parse_lake_path(path: ColumnOrName) -> Column:
    """Table name, schema and folder path from a listed path (STR-5).

    ``.../_delta_log`` is stripped; the name is the last segment; a path of
    exactly four segments carries the schema in the third.
    """
    stripped = strip_delta_log(path)
    parts = F.split(stripped, "/")
    return F.struct(
        F.lit("Tables").alias("prefix"),
        F.element_at(parts, -1).alias("name"),
        F.concat(stripped, F.lit("/")).alias("path"),
        F.when(F.size(parts) == 4, parts.getItem(2)).alias("schema"),
    )


def relative_path(path: ColumnOrName, directory: ColumnOrName, skip: int = 0) -> Column:
    """Path below ``directory``; ``""`` when the path is not longer (STR-6).
    ``skip=1`` also drops the separating slash, as for shortcut contents."""
    p, d = _c(path), _lit(directory)
    return F.when(F.length(p) > F.length(d),
                  p.substr(F.length(d) + 1 + skip, F.lit(2**31 - 1))).otherwise(F.lit(""))


def folder_prefix(directory: ColumnOrName) -> Column:
    """``Files`` / ``Tables`` / first segment of a directory path (STR-6)."""
    d = _c(directory)
    return (F.when(d.startswith("Files/"), F.lit("Files"))
            .when(d.startswith("Tables/"), F.lit("Tables"))
            .otherwise(F.split(d, "/").getItem(0)))


def base_name(path: ColumnOrName) -> Column:
    """Text after the last ``/`` (whole string if none)."""
    return F.substring_index(_c(path), "/", -1)


def build_path(*parts: ColumnOrName) -> Column:
    return F.concat_ws("/", *[_c(p) for p in parts])


def replace_first(s: ColumnOrName, search, repl) -> Column:
    """Replace only the first literal occurrence (JavaScript ``String.replace``)."""
    s, search, repl = _c(s), _lit(search), _lit(repl)
    i = F.position(search, s)
    return F.when(i > 0, F.concat(s.substr(F.lit(1), i - 1), repl,
                                  s.substr(i + F.length(search), F.lit(2**31 - 1)))).otherwise(s)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def to_abfss(url: ColumnOrName, workspace_id: ColumnOrName) -> Column:
    """Turn a lake https link into an ``abfss://ws@...`` URI (STR-7): the first
    ``<ws>/`` is removed, then the first ``https://`` is rewritten."""
    ws = _lit(workspace_id)
    x = replace_first(url, F.concat(ws, F.lit("/")), F.lit(""))
    return replace_first(x, F.lit("https://"), F.concat(F.lit("abfss://"), ws, F.lit("@")))


def file_extension(name: ColumnOrName) -> Column:
    """Last dot-separated part, lower-cased (whole name when it has no dot)."""
    return F.lower(F.element_at(F.split(_c(name), r"\."), -1))


# File extension -> editor language, as the reference defines them.
LANGUAGE_BY_EXTENSION = {
    "js": "javascript", "jsx": "javascript", "ts": "typescript", "ipynb": "jupyter",
    "tsx": "typescript", "py": "python", "html": "html", "css": "css", "scss": "scss",
    "sass": "sass", "json": "json", "xml": "xml", "md": "markdown", "yml": "yaml",
    "yaml": "yaml", "sql": "sql", "sh": "shell", "ps1": "powershell", "cs": "csharp",
    "java": "java", "cpp": "cpp", "c": "c", "php": "php", "rb": "ruby", "go": "go",
    "rs": "rust",
}

# File types the explorer editor accepts.
ACCEPTED_FILE_TYPES = (".txt,.js,.ts,.html,.css,.json,.md,.py,.cs,.java,.cpp,.c,.php,.rb,"
                       ".go,.rs,.xml,.yml,.yaml,.sql,.csv,.ipynb").split(",")


def map_lookup(key: Column, mapping: Mapping[str, str], default: Column | str | None = None) -> Column:
    """Literal map lookup with a default (known label, else ``default``)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = m[key]
    if default is None:
        return out
    return F.coalesce(out, _lit(default))


def file_language(name: ColumnOrName) -> Column:
    """Editor language by file extension, default ``plaintext`` (STR-8)."""
    return map_lookup(file_extension(name), LANGUAGE_BY_EXTENSION, "plaintext")


def suffix_name(name: ColumnOrName, deployment_id: ColumnOrName, enabled=True) -> Column:
    """``name_<deploymentId>`` when suffixing is on (STR-11)."""
    n, d = _c(name), _lit(deployment_id)
    return F.when(_lit(enabled), F.concat(n, F.lit("_"), d)).otherwise(n)


def unsuffix_name(name: ColumnOrName, deployment_id: ColumnOrName, enabled=True) -> Column:
    """Remove the first ``_<deploymentId>`` occurrence (STR-11)."""
    d = _lit(deployment_id)
    return F.when(_lit(enabled), replace_first(name, F.concat(F.lit("_"), d), F.lit(""))).otherwise(_c(name))


# ---------------------------------------------------------------------------
# Extraction, logs, lists (STR-9, STR-10, STR-14, AGG-6 helper)
# ---------------------------------------------------------------------------

# Job instance id in a Location header, SQL connection string,
# and the log line layout.
JOB_INSTANCE_PATTERN = r"/jobs/instances/([^/?]+)"
SQL_CONNECTION_PATTERN = r'Sql\.Database\("([^"]+)",\s*"([^"]+)"\)'


def extract_first(s: ColumnOrName, pattern: str, group: int = 1, required: bool = False,
                  message: str = "value not found") -> Column:
    """First regex match group; null when absent, or an error if required."""
    s = _c(s)
    hit = s.rlike(pattern)
    val = F.when(hit, F.regexp_extract(s, pattern, group))
    if required:
        return F.when(hit, val).otherwise(F.raise_error(F.lit(message)))
    return val


def extract_id(location: ColumnOrName, required: bool = False) -> Column:
    """Job instance id from a Location header (STR-9)."""
    return extract_first(location, JOB_INSTANCE_PATTERN, 1, required,
                         "Job instance ID not found in response headers")


def extract_connection(text: ColumnOrName) -> Column:
    """``struct(database, endpoint)`` of the first SQL connection string (STR-9)."""
    t = _c(text)
    hit = t.rlike(SQL_CONNECTION_PATTERN)
    return F.when(hit, F.struct(F.regexp_extract(t, SQL_CONNECTION_PATTERN, 1).alias("database"),
                                F.regexp_extract(t, SQL_CONNECTION_PATTERN, 2).alias("endpoint")))


LOG_LINE_PATTERN = r"^\[([^\]]*)\] \[([A-Z]+)\] (.*) (\[.*\])$"


def format_log(ts: ColumnOrName, level: ColumnOrName, message: ColumnOrName,
               params: ColumnOrName | None = None) -> Column:
    """``[ISO time] [LEVEL] message params-json`` (STR-10)."""
    iso = F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    p = F.lit("[]") if params is None else _c(params)
    return F.concat(F.lit("["), iso, F.lit("] ["), F.upper(_c(level)), F.lit("] "), _c(message), F.lit(" "), p)


def parse_log(line: ColumnOrName) -> Column:
    """Inverse of :func:`format_log`; non-matching lines give null fields."""
    ln = _c(line)
    ok = ln.rlike(LOG_LINE_PATTERN)
    g = lambda i: F.when(ok, F.regexp_extract(ln, LOG_LINE_PATTERN, i))
    return F.struct(g(1).alias("ts"), g(2).alias("level"), g(3).alias("message"), g(4).alias("params"))


def js_trim(s: ColumnOrName) -> Column:
    """Trim all leading/trailing whitespace like JavaScript ``trim`` (Spark's
    ``trim`` removes spaces only)."""
    return F.regexp_replace(_c(s), r"^\s+|\s+$", "")


def parse_list(s: ColumnOrName, prefix: str | None = None, sep: str = ",") -> Column:
    """Split on ``sep``, trim, drop empty entries, optionally prefix (STR-14)."""
    items = F.filter(F.transform(F.split(_c(s), re.escape(sep)), js_trim), lambda x: F.length(x) > 0)
    if prefix is None:
        return items
    return F.transform(items, lambda x: F.concat(F.lit(prefix), x))
