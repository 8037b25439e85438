"""Access rules: builders and who-can-read-what joins (ACL-1, JN-3 .. JN-5).

Path rules are matched with an equi-join on path prefixes instead of a
non-equi join: each target path is expanded to its prefixes at just the
lengths that rule paths have (a small set, read once from the rules), so the
join is a hash/sort-merge join on strings whatever the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



# Rule wildcard and the role field listing directory members.
WILDCARD = "*"
DIRECTORY_MEMBERS = "microsoftEntraMembers"
# Read-role builder names and paths.
READER_SUFFIX, DEFAULT_READER, TABLES_PREFIX, READ, PERMIT = "Reader", "DefaultReader", "/Tables/", "Read", "Permit"


def read_role_rows(names: DataFrame, kind_col: str, name_col: str) -> DataFrame:
    """Rules of the read-role builders (ACL-1): one row per (role, path, action).

    kind ``table`` -> role ``<name>Reader`` on ``/Tables/<name>``; kind
    ``folder`` -> ``<folder with / and \\ as _>Reader`` on ``/<f>`` and
    ``/<f>/*``; kind ``default`` -> ``DefaultReader`` on ``*``.  Action Read,
    effect Permit.
    """
    k, n = F.col(kind_col), F.col(name_col)
    role = (F.when(k == "table", F.concat(n, F.lit(READER_SUFFIX)))
            .when(k == "folder", F.concat(F.regexp_replace(n, r"[/\\\\]", "_"), F.lit(READER_SUFFIX)))
            .when(k == "default", F.lit(DEFAULT_READER)))
    paths = (F.when(k == "table", F.array(F.concat(F.lit(TABLES_PREFIX), n)))
             .when(k == "folder", F.array(F.concat(F.lit("/"), n), F.concat(F.lit("/"), n, F.lit("/*"))))
             .when(k == "default", F.array(F.lit(WILDCARD))))
    return names.select(role.alias("role"), F.lit(PERMIT).alias("effect"),
                        F.explode(paths).alias("path"), F.lit(READ).alias("action"))


def custom_role_rows(roles: DataFrame, role_col: str = "role", paths_col: str = "paths", actions_col: str = "actions") -> DataFrame:
    """Rules of custom roles (ACL-1): one row per (role, path, action) of a role's
    path and action lists; a role with an empty list permits nothing."""
    each = roles.select(F.col(role_col).alias("role"), F.explode(F.array_distinct(paths_col)).alias("path"), F.col(actions_col).alias("__a"))
    return each.select("role", F.lit(PERMIT).alias("effect"), "path", F.explode(F.array_distinct("__a")).alias("action"))


def rule_rows(roles: DataFrame, role_col: str = "name", rules_col: str = "decisionRules") -> DataFrame:
    """Flatten nested roles to ``(role, rule_no, path, action)`` rows.

    Only the first ``Path`` permission of each rule counts; actions come from
    the first ``Action`` permission.
    """
    r = roles.select(F.col(role_col).alias("role"), F.posexplode(rules_col).alias("rule_no", "rule"))
    first = lambda name: F.try_element_at(F.filter(F.col("rule.permission"),
                                                   lambda p: p["attributeName"] == name), F.lit(1))
    r = r.select("role", "rule_no", first("Path")["attributeValueIncludedIn"].alias("paths"),
                 first("Action")["attributeValueIncludedIn"].alias("actions"))
    r = r.select("role", "rule_no", F.explode_outer("actions").alias("action"), "paths")
    return r.select("role", "rule_no", F.explode("paths").alias("path"), "action")


def normalize_rule_path(p: Column) -> Column:
    """Normalised form: no leading slash, ``/*`` suffix dropped."""
    return F.regexp_replace(F.regexp_replace(p, "^/+", ""), "/\\*$", "")


def path_access(rules: DataFrame, targets: DataFrame, target_col: str, rule_path_col: str = "path",
                normalize: bool = False) -> DataFrame:
    """Pairs (rule row, target row) where the rule grants the target (JN-3).

    Compatible mode (default) is the reference rule: ``p == '*' or p == t or
    t startswith p`` with no segment boundary.  ``normalize=True`` strips the
    leading slash, honours ``/*`` and matches whole segments only.
    """
    t = targets.withColumn("__t", F.col(target_col))
    if normalize:
        rp = F.when(F.col(rule_path_col) == WILDCARD, F.lit("")).otherwise(normalize_rule_path(F.col(rule_path_col)))
        r = rules.withColumn("__key", rp)
        segs = F.filter(F.split(F.regexp_replace(F.col("__t"), "^/+", ""), "/"), lambda s: s != "")
        cands = F.concat(F.array(F.lit("")),
                         F.transform(F.sequence(F.lit(1), F.greatest(F.size(segs), F.lit(1))),
                                     lambda n: F.array_join(F.slice(segs, 1, n), "/")))
        tx = t.withColumn("__key", F.explode(F.array_distinct(cands))).hint("merge")
        return tx.join(r, "__key").drop("__key", "__t")
    # compatible mode: prefixes at the rule lengths only ('*' -> length 0)
    r = rules.withColumn("__key", F.when(F.col(rule_path_col) == WILDCARD, F.lit("")).otherwise(F.col(rule_path_col)))
    # one value for each length that occurs: at most as many as the longest rule has characters
    lens = r.agg(F.collect_set(F.length("__key")).alias("__lens")).scalar()
    cands = F.transform(F.filter(F.col("__lens"), lambda n: n <= F.length(F.col("__t"))),
                        lambda n: F.substring(F.col("__t"), F.lit(1), n))
    tx = t.withColumn("__lens", lens).withColumn("__key", F.explode(F.array_distinct(cands))).hint("merge")
    return tx.join(r, "__key").drop("__key", "__t", "__lens")


def member_roles(members: DataFrame, member_col: str, role_col: str, member_id) -> DataFrame:
    """Roles that list a member (JN-4); ``members`` is long form
    (role, member) of directory members only."""
    m = member_id if isinstance(member_id, Column) else F.lit(member_id)
    return members.where(F.col(member_col) == m).select(role_col).distinct()


def roles_with_member(roles: DataFrame, member_id: str, members_col: str = "members") -> DataFrame:
    """Nested form of JN-4: roles whose directory members include the id."""
    arr = F.col(f"{members_col}.{DIRECTORY_MEMBERS}")
    return roles.where(F.coalesce(F.exists(arr, lambda x: x["objectId"] == member_id), F.lit(False)))


def effective_access(rules: DataFrame, members: DataFrame, targets: DataFrame, target_col: str,
                     target_key: str, normalize: bool = False) -> DataFrame:
    """Distinct (principal, target, action) = path access joined with role
    members (JN-5)."""
    granted = path_access(rules, targets, target_col, normalize=normalize).select("role", target_key, "action")
    return granted.join(members, "role").select("principal", target_key, "action").distinct()


