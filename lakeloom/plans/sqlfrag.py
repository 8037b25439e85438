"""Small DuckDB SQL fragments of the oracle strings, written out by hand.

They name no constant of the engine, so a wrong entry there shows as a mismatch.
"""

from __future__ import annotations


def replace_first(s: str, search: str, repl: str) -> str:
    return (f"(CASE WHEN strpos({s}, {search}) > 0 THEN substr({s}, 1, strpos({s}, {search}) - 1) || {repl} "
            f"|| substr({s}, strpos({s}, {search}) + length({search})) ELSE {s} END)")


# URL parts used to derive lake-style paths from pages.url.
HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
UPATH = "regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1)"

# Job and deployment status that the test queries give an event.
JOB_STATUS = ("(CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'NotStarted' "
              "WHEN 'view' THEN 'InProgress' WHEN 'click' THEN 'Running' END)")
DEPLOYMENT_STATUS = "(CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed' ELSE 'InProgress' END)"
