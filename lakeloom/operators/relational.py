"""Joins, aggregates, windows, sorts, limits and set operations
(JN-1, JN-2, JN-6 .. JN-10, AGG-1 .. AGG-6, WIN-1 .. WIN-3, SRT-1, LIM-1 .. 3,
SET-1 .. 3).

"First" / "last" per key are ``min_by`` / ``max_by`` aggregates: they combine
map-side, so a key holding a third of the rows is pre-reduced in every task
instead of being sorted in one.  Joins are equi-joins; AQE picks broadcast or
sort-merge at run time from the measured sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.status import (CANCELLED, FAILED, IN_PROGRESS, PENDING, SUCCEEDED, in_grace,
                                map_job_status)
from ..functions.text import _lit
from ..session import cut_lineage, ensure_checkpoint_dir, ensure_parallelism
from . import grams
from .ranking import rank_within_groups  # noqa: F401 - re-exported


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _order_key(order: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])


# ---------------------------------------------------------------------------
# First / last per key (WIN-1, WIN-3) and joins built on them (JN-1, JN-2)
# ---------------------------------------------------------------------------

def first_per_key(df: DataFrame, keys, order: Sequence[str | Column], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order`` (WIN-1).

    ``order`` should be unique within a key for a deterministic pick.
    """
    keys = _cols(keys)
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(None)
    agg = df.groupBy(*keys).agg(pick(row, _order_key(order)).alias("__r"))
    return agg.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def last_per_key(df: DataFrame, keys, order: Sequence[str | Column]) -> DataFrame:
    return first_per_key(df, keys, order, last=True)


def latest_state(events: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """Current state per operation = state at the latest time (WIN-3)."""
    return events.groupBy(key).agg(F.max_by(state, ts).alias(state), F.max(ts).alias(ts))


def match_first(expected: DataFrame, existing: DataFrame, left_keys, right_keys,
                order: Sequence[str | Column]) -> DataFrame:
    """Left-match each expected row to the **first** existing row with equal
    keys (JN-1); duplicates on the right never multiply the left."""
    lk, rk = _cols(left_keys), _cols(right_keys)
    firsts = first_per_key(existing, rk, order)
    cond = [expected[a] == firsts[b] for a, b in zip(lk, rk)]
    return expected.join(firsts, cond, "left")


def lookup_names(requests: DataFrame, catalog: DataFrame, req_name: str, cat_name: str,
                 cat_order: Sequence[str | Column]) -> tuple[DataFrame, DataFrame]:
    """Case-insensitive lookup (JN-2): ``(found, missing)``.

    Catalog duplicates by lower-cased name: the **last** in ``cat_order``
    wins.  Not-found keeps request duplicates.
    """
    cat = catalog.withColumn("__lname", F.lower(F.col(cat_name)))
    last = last_per_key(cat, "__lname", cat_order)
    req = requests.withColumn("__lname", F.lower(F.col(req_name)))
    found = req.join(last.drop(cat_name), "__lname", "inner")
    missing = req.join(last.select("__lname"), "__lname", "left_anti")
    return found.drop("__lname"), missing.drop("__lname")


def merge_updates(base: DataFrame, updates: DataFrame, key, order: Sequence[str | Column] | None = None) -> DataFrame:
    """Replace whole rows of ``base`` by their update, else keep (JN-8).

    Several updates for one key never multiply a row: the last by ``order``
    wins (by all columns when no order is given, so the pick is the same
    on every retry).
    """
    keys = _cols(key)
    cols = [c for c in base.columns if c not in keys]
    extra = [o for o in (order or []) if isinstance(o, str) and o not in cols and o not in keys]
    upd = last_per_key(updates.select(*keys, *cols, *extra), keys, list(order) if order else cols)
    u = upd.select(*keys, F.struct(*cols).alias("__u"))
    j = base.join(u, keys, "left")
    return j.select(*keys, *[F.when(F.col("__u").isNotNull(), F.col("__u")[c]).otherwise(F.col(c)).alias(c)
                             for c in cols]).select(*base.columns)


def exists_in(df: DataFrame, other: DataFrame, left_keys, right_keys=None, negate: bool = False) -> DataFrame:
    """Rows with (or without) a match in ``other`` (JN-9)."""
    lk = _cols(left_keys)
    rk = _cols(right_keys) if right_keys is not None else lk
    cond = [df[a] == other[b] for a, b in zip(lk, rk)]
    return df.join(other, cond, "left_anti" if negate else "left_semi")


# ---------------------------------------------------------------------------
# Hierarchy (JN-6, JN-7, SRT-1)
# ---------------------------------------------------------------------------

def parent_path(path: Column) -> Column:
    """Parent of a ``/`` path after dropping empty segments; null at depth 1."""
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.when(F.size(segs) > 1, F.array_join(F.slice(segs, 1, F.size(segs) - 1), "/"))


def link_parents(listing: DataFrame, path_col: str = "path", dir_col: str = "isDirectory",
                 shortcut_contents: DataFrame | None = None, shortcut_col: str = "shortcut") -> DataFrame:
    """Child -> parent folder by path; a child whose parent folder is not
    listed goes to the root (null parent) (JN-6).

    ``shortcut_contents`` (``shortcut``, ``path`` relative, ``isDirectory``)
    replaces everything listed below each expanded shortcut folder.
    """
    nodes = listing
    if shortcut_contents is not None:
        expanded = shortcut_contents.select(F.col(shortcut_col).alias("__sc")).distinct()
        segs = F.filter(F.split(F.col(path_col), "/"), lambda s: s != "")
        above = F.when(F.size(segs) > 1, F.transform(F.sequence(F.lit(1), F.size(segs) - 1), lambda n: F.array_join(F.slice(segs, 1, n), "/")))
        below = (nodes.select(F.col(path_col).alias("__gone"), F.explode(above).alias("__sc")).hint("merge")
                 .join(expanded, "__sc").select("__gone").distinct())
        nodes = nodes.join(below, nodes[path_col] == below["__gone"], "left_anti")
        added = shortcut_contents.select(F.concat(F.col(shortcut_col), F.lit("/"), F.col(path_col)).alias(path_col),
                                         F.col(dir_col))
        nodes = nodes.unionByName(added, allowMissingColumns=True)
    with_pp = nodes.withColumn("__pp", parent_path(F.col(path_col)))
    folders = nodes.where(F.col(dir_col)).select(F.col(path_col).alias("__fp")).distinct()
    j = with_pp.join(folders, with_pp["__pp"] == folders["__fp"], "left")
    return j.withColumn("parent", F.col("__fp")).drop("__pp", "__fp")


def ancestor_path(nodes: DataFrame, id_col: str, parent_col: str, name_col: str, max_depth: int | None = None,
                  sep: str = "/") -> DataFrame:
    """Names from the root down to each node (JN-7), however deep the tree is.

    With ``max_depth`` longer paths keep their last names only and are flagged
    ``truncated``.

    Pointer doubling: a node knows the names from some ancestor down to itself;
    each round it takes over what that ancestor knows, so rounds grow with the
    logarithm of the depth.  Only nodes that have not reached a root take part,
    so finished ones never meet under one null key.  A node that meets an id
    twice is on, or below, a cycle: it stops with every id once and is flagged
    ``truncated``.  Each round writes the nodes that took part with a reliable
    ``checkpoint``; finished ones stay where they were written.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    step = F.struct(F.col(id_col).alias("i"), F.col(name_col).alias("n"))
    state = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("next"), F.array(step).alias("way"),
                         F.lit(False).alias("truncated")).checkpoint(eager=True)
    done, open_ = state.where(F.col("next").isNull()), state.where(F.col("next").isNotNull())
    while open_.limit(1).count():
        known = done.unionByName(open_).select(F.col("id").alias("kid"), F.col("next").alias("knext"), F.col("way").alias("kway"),
                             F.col("truncated").alias("kcut"))
        still = open_.join(known, F.col("next") == F.col("kid"), "left")
        way = F.when(F.col("kid").isNotNull(), F.concat("kway", "way")).otherwise(F.col("way"))
        once = F.array_distinct(way)
        cut = F.size(once) < F.size(way)
        still = still.select("id", F.when(cut | F.col("kcut"), None).otherwise(F.col("knext")).alias("next"),
                             F.when(cut, once).otherwise(way).alias("way"),
                             (cut | F.coalesce("kcut", F.lit(False))).alias("truncated")).checkpoint(eager=True)
        done, open_ = done.unionByName(still.where(F.col("next").isNull())), still.where(F.col("next").isNotNull())
    state = done
    if max_depth:
        long = F.size("way") > max_depth
        state = state.withColumn("truncated", F.col("truncated") | long).withColumn("way", F.when(
            long, F.slice("way", F.size("way") - max_depth + 1, max_depth)).otherwise(F.col("way")))
    return state.select(F.col("id").alias(id_col), F.array_join(F.transform("way", lambda w: w["n"]), sep).alias("path"),
                        F.size("way").alias("depth"), "truncated")


def tree_rank(nodes: DataFrame, parent_col: str, name_col: str, dir_col: str, tie: Sequence[str] = (),
              collation: str = "UNICODE") -> DataFrame:
    """Position of each node among its siblings: directories first, then name
    in locale order (SRT-1).  Skew-safe ranking, see :mod:`.ranking`."""
    order = [F.when(F.col(dir_col), 0).otherwise(1), F.collate(F.col(name_col), collation), *tie]
    return rank_within_groups(nodes, [parent_col], order, out="rank")


def tree_order(nodes: DataFrame, id_col: str, parent_col: str, name_col: str, dir_col: str, tie: Sequence[str] = (),
               collation: str = "UNICODE") -> DataFrame:
    """Place of each node in the displayed tree (SRT-1): ``id``, ``depth``, ``size``, ``position``.

    The tree is shown top-down, each folder followed by what is below it,
    siblings as in :func:`tree_rank`.  ``size`` counts a node and all below it,
    and ``position`` begins at 1.  Levels are found from the roots (no parent, or
    one that is not listed), sizes added up from the leaves, and positions handed
    down: a node stands after its parent and the subtrees of its earlier
    siblings, whose sizes are summed up without gathering a folder's children in
    one task.  Rounds grow with the depth, each over one level.  Nodes on or below
    a cycle, and rows without an id, have no place and are left out.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    own = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.when(F.col(dir_col), 0).otherwise(1).alias("__d"),
                       F.collate(F.col(name_col), collation).alias("__n"), *[F.col(t).alias(f"__t{i}") for i, t in enumerate(tie)])
    own = cut_lineage(own.where(F.col("id").isNotNull()))
    ids = own.select(F.col("id").alias("__i")).distinct()
    roots = own.join(ids, own["parent"] == ids["__i"], "left").where(F.col("__i").isNull()).drop("__i")
    level = cut_lineage(roots.withColumn("parent", F.lit(None).cast(own.schema["parent"].dataType)))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        above = level.select(F.col("id").alias("__i"))
        level = cut_lineage(own.join(above, own["parent"] == above["__i"]).drop("__i"))
    sized, below = [], None
    for level in reversed(levels):
        size = F.lit(1).cast("long")
        if below is not None:
            level = level.join(below.groupBy(F.col("parent").alias("__p")).agg(F.sum("size").alias("__s")), level["id"] == F.col("__p"), "left")
            size = size + F.coalesce("__s", F.lit(0))
        below = cut_lineage(level.withColumn("size", size).drop("__p", "__s"))
        sized.insert(0, below)
    placed, found = None, None
    for depth, level in enumerate(sized, 1):
        order = ["__d", "__n", *[f"__t{i}" for i in range(len(tie))], "id"]
        level = rank_within_groups(level, ["parent"], order, out="__upto", weight=F.col("size"))
        position = F.col("__upto") - F.col("size") + 1
        if placed is not None:
            above = placed.select(F.col("id").alias("__i"), F.col("position").alias("__at"))
            level = level.join(above, level["parent"] == above["__i"])
            position = position + F.col("__at")
        placed = cut_lineage(level.select("id", F.lit(depth).alias("depth"), "size", position.cast("long").alias("position")))
        found = placed if found is None else found.unionByName(placed)
    if found is None:
        found = own.select("id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("position"))
    return found.withColumnRenamed("id", id_col)


# ---------------------------------------------------------------------------
# Ordered id remapping (JN-10)
# ---------------------------------------------------------------------------

ID_BROADCAST_ROWS = 1_000_000
ID_BROADCAST_BYTES = 64 * 1024 * 1024


def _fold(text: Column, reps: Column, reach: int) -> Column:
    """Apply replacements in order: struct(text, steps).

    ``steps`` has, for each replacement that changed the text, its place in the
    order and the new text around each spot, ``reach`` characters to either side
    (the whole text if two spots are closer than that), where another id may
    have come into being.
    """
    def apply(acc: Column, r: Column) -> Column:
        quoted = F.concat(F.lit("\\Q"), F.replace(r["__old"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        done = F.replace(acc["text"], r["__old"], r["__new"])
        pieces = F.split(acc["text"], quoted, -1)

        def around(p: Column) -> Column:
            near = F.exists(F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))), lambda x: F.length(x) < reach)
            spots = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.concat(
                F.right(F.get(p, i), F.lit(reach)), r["__new"], F.left(F.get(p, i + 1), F.lit(reach))))
            return F.when(near, F.array(done)).otherwise(spots)

        spots = F.transform(F.array(pieces), around)[0]
        steps = F.concat(acc["steps"], F.transform(spots, lambda w: F.struct(r["__mseq"].alias("s"), w.alias("w"))))
        return F.when(F.instr(acc["text"], r["__old"]) > 0, F.struct(done.alias("text"), steps.alias("steps"))).otherwise(acc)

    none = F.array().cast("array<struct<s:bigint,w:string>>")
    return F.aggregate(reps, F.struct(text.alias("text"), none.alias("steps")), apply)


def ordered_remap(docs: DataFrame, mapping: DataFrame, doc_seq: str, text_col: str,
                  map_seq: str = "seq", old: str = "old_id", new: str = "new_id", max_gram: int = 8,
                  ordered: bool = True) -> DataFrame:
    """Replace ids in each document with the mappings of **earlier** documents,
    applied in mapping order, literal substring semantics (JN-10).

    Candidate mappings are found by one gram per old id -- its rarest among all
    ids by a bounded table of counts, so shared prefixes do not create a hot key.  An id's gram has its own
    length (the id's, at most ``max_gram`` bytes and 8), so one short id changes
    nothing for others.  A candidate whose id is absent is a no-op in the fold,
    so the candidate set only has to contain every id that ever occurs.  A
    document's grams that no id has are left out where its text is read
    (:mod:`.grams`); few ids are shipped to the texts and replaced there, many
    are joined with the grams that stay.

    A replacement can bring another id into being, within the new id or across
    its edges.  So if a mapping later in order has an old id that shares a
    character with some new id, the text around each spot that changed is
    searched like the documents, for such mappings; what is found joins the
    candidates and the fold is repeated until nothing new is found.  The result is that of
    applying every mapping in turn.  With ``ordered=False`` every mapping applies
    to every document (still in mapping order), as when capturing a package.
    Null new ids count as empty; ``doc_seq`` must be unique.
    """
    m = cut_lineage(mapping.select(F.col(map_seq).cast("long").alias("__mseq"), F.col(old).alias("__old"),
                                   F.coalesce(F.col(new), F.lit("")).alias("__new")).where(F.length("__old") > 0))
    size = F.least(F.octet_length("__old"), F.lit(min(max_gram, grams.LONGEST)))
    sizes = sorted(r[0] for r in m.select(size).distinct().collect())  # 8 values at most
    if not sizes:
        return docs
    lowest, highest, reach, n_maps = m.agg(F.min("__mseq"), F.max("__mseq"), F.max(F.length("__old")) - 1, F.count(F.lit(1))).first()
    # of several mappings for one id only the earliest can act on what is there at first
    first = m.groupBy("__old").agg(F.min(F.struct("__mseq", "__new")).alias("__f")).select("__f.__mseq", "__old", "__f.__new")
    counts = grams.counted(ensure_parallelism(m.select("__old")), "__old", n_maps, sizes)
    index = cut_lineage(grams.rarest(first, "__old", counts, sizes).select("__g", "__at", "__mseq", "__old", "__new"))
    # the id index is shipped when its counted size allows, so the document
    # grams are never shuffled; beyond the limit, a shuffle join
    n_rows, n_chars = index.agg(F.count(F.lit(1)), F.sum(2 * F.length("__old") + F.length("__new"))).first()
    near = n_rows <= ID_BROADCAST_ROWS and 64 * n_rows + 2 * (n_chars or 0) <= ID_BROADCAST_BYTES
    known = grams.Known.of(index, "__g", n_rows, sizes)
    # an id that comes into being overlaps a new id, so it shares a character with one
    # (an empty new id joins what stands around it), and a mapping later in order replaces it
    chained = lowest is not None and lowest < highest
    if chained or near:
        chars = "".join(r[0] for r in m.select(F.explode(F.array_distinct(F.split("__new", "")))).distinct().collect())
        made = F.translate("__old", chars, "") != F.col("__old") if chars else F.lit(False)
        if m.where("__new = ''").limit(1).count():
            made = F.lit(True)
        if near and not m.where(made).limit(1).count():
            return grams.replaced(ensure_parallelism(docs), doc_seq, text_col, index, known, ordered)
        chained = chained and m.where(made).where(F.col("__mseq") > lowest).limit(1).count() > 0
    d = docs.select(F.col(doc_seq).cast("long").alias("__dseq"), F.col(text_col).alias("__text")).where("__dseq is not null")
    d = ensure_parallelism(d)
    index = F.broadcast(index) if near else index.hint("merge")
    within = (F.col("__mseq") < F.col("__dseq")) if ordered else F.lit(True)
    reps = known.found(d, "__text").join(index, "__g").where(within).select("__dseq", "__mseq", "__old", "__new")
    empty = F.array().cast("array<struct<__mseq:bigint,__old:string,__new:string>>")
    if chained:
        index = index.where(made)
    while True:
        if chained:
            reps = cut_lineage(reps)
        per_doc = reps.groupBy("__dseq").agg(F.array_sort(F.collect_set(F.struct("__mseq", "__old", "__new"))).alias("__reps"))
        if not chained:
            break
        steps = (d.join(per_doc, "__dseq").select("__dseq", F.explode(_fold(F.col("__text"), F.col("__reps"), reach)["steps"]).alias("__s"))
                 .select("__dseq", F.col("__s.s").alias("__after"), F.col("__s.w").alias("__w")))
        found = known.found(steps, "__w").join(index.select("__g", "__old"), "__g").select("__dseq", "__after", "__old").distinct()
        later = (found.join(m, "__old").where(F.col("__mseq") > F.col("__after")).where(within)
                 .groupBy("__dseq", "__after", "__old").agg(F.min(F.struct("__mseq", "__new")).alias("__f"))
                 .select("__dseq", F.col("__f.__mseq").alias("__mseq"), "__old", F.col("__f.__new").alias("__new")).distinct())
        fresh = cut_lineage(later.join(reps, ["__dseq", "__mseq", "__old"], "left_anti"))
        if not fresh.limit(1).count():
            break
        reps = reps.unionByName(fresh.select(*reps.columns))
    out = docs.join(per_doc, docs[doc_seq] == per_doc["__dseq"], "left")
    # a null list changes nothing
    folded = F.aggregate(F.coalesce(F.col("__reps"), empty), F.col(text_col),
                         lambda acc, r: F.replace(acc, r["__old"], r["__new"]))
    return out.withColumn(text_col, folded).drop("__dseq", "__reps")


# ---------------------------------------------------------------------------
# Aggregates (AGG-1 .. AGG-6)
# ---------------------------------------------------------------------------

def row_count(df: DataFrame) -> DataFrame:
    """Row count as a one-row DataFrame (AGG-1)."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def group_tables(tables: DataFrame, schema_col: str, name_col: str, pos_col: str) -> tuple[DataFrame, DataFrame]:
    """Tables grouped by schema (AGG-2); a null schema is its own group.

    Returns ``(ordered, summary)``: every table with its 1-based position in
    the group (source order, skew-safe ranking, which writes a checkpoint), and
    :func:`summarize_tables`.  No group is gathered into one row.
    """
    ordered = rank_within_groups(tables, [schema_col], [F.col(pos_col)], out="position")
    return ordered, summarize_tables(tables, schema_col, name_col, pos_col)


def summarize_tables(tables: DataFrame, schema_col: str, name_col: str, pos_col: str) -> DataFrame:
    """One row per schema (AGG-2) with its number of tables and the first and last of them."""
    return tables.groupBy(schema_col).agg(
        F.count(F.lit(1)).alias("n_tables"),
        F.min_by(name_col, pos_col).alias("first_table"),
        F.max_by(name_col, pos_col).alias("last_table"))


def status_fold(jobs: DataFrame, key: str, status_col: str, seq_col: str, policy_col: str | None,
                deployments: DataFrame, expected_col: str, deployed_col: str, end_col: str, now,
                keep_cancelled: bool = False, mapped: bool = False) -> DataFrame:
    """Deployment status from its jobs (AGG-3, rule R1).

    Over FailOnError jobs in ``seq`` order: Failed/Cancelled set the value
    (last wins), Pending/InProgress set it unless already Failed/Cancelled,
    Succeeded leaves it.  Then Succeeded needs deployed = expected; otherwise
    InProgress within 10 minutes after the job end, else Failed.  Computed
    with ``max`` over ``(seq, status)`` structs -- a map-side-combinable
    aggregate, so a deployment with a huge job list is not a hot task.
    ``keep_cancelled`` keeps a Cancelled fold instead of InProgress/Failed.
    """
    st = F.col(status_col) if mapped else map_job_status(status_col)
    j = jobs.withColumn("__st", st)
    if policy_col:
        j = j.where(F.coalesce(F.col(policy_col), F.lit("FailOnError")) == "FailOnError")
    severe = F.col("__st").isin(FAILED, CANCELLED)
    waiting = F.col("__st").isin(PENDING, IN_PROGRESS)
    folds = j.groupBy(key).agg(
        F.max(F.when(severe, F.struct(F.col(seq_col).alias("s"), F.col("__st").alias("v")))).alias("__sev"),
        F.max(F.when(waiting, F.struct(F.col(seq_col).alias("s"), F.col("__st").alias("v")))).alias("__wait"))
    fold = F.coalesce(F.col("__sev")["v"], F.col("__wait")["v"], F.lit(SUCCEEDED))
    d = deployments.join(folds, key, "left").withColumn("fold", fold)
    ok = (F.col("fold") == SUCCEEDED) & (F.col(deployed_col) == F.col(expected_col))
    grace = in_grace(end_col, now)
    final = F.when(ok, F.lit(SUCCEEDED))
    if keep_cancelled:
        final = final.when(F.col("fold") == CANCELLED, F.lit(CANCELLED))
    final = final.when(grace, F.lit(IN_PROGRESS)).otherwise(F.lit(FAILED))
    return d.withColumn("status", final).drop("__sev", "__wait")


def any_status(df: DataFrame, key, status_col: str, statuses: Sequence[str], out: str = "any_match") -> DataFrame:
    """Per key: any row has one of ``statuses`` (AGG-4, ``isPathShared``)."""
    return df.groupBy(*_cols(key)).agg(F.coalesce(F.bool_or(F.col(status_col).isin(*statuses)),
                                                  F.lit(False)).alias(out))


def first_has(df: DataFrame, key, value_col: str, order: Sequence[str | Column], out: str = "first_has") -> DataFrame:
    """Per key: the first row's ``value_col`` is present (AGG-4, ``hasSchema``)."""
    return df.groupBy(*_cols(key)).agg(F.min_by(F.col(value_col), _order_key(order)).isNotNull().alias(out))


def outcome_split(results: DataFrame, key, ok_col: Column | str, name_col: str) -> tuple[DataFrame, DataFrame]:
    """Success/failure split that never stops on an error (AGG-5).

    Returns ``(counts, failures)``: per key the numbers of successes and
    failures and the first failed name; and the failed rows themselves
    (kept as rows, not gathered into a list).
    """
    ok = F.col(ok_col) if isinstance(ok_col, str) else ok_col
    r = results.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    counts = r.groupBy(*_cols(key)).agg(
        F.count_if(F.col("__ok")).alias("n_ok"), F.count_if(~F.col("__ok")).alias("n_failed"),
        F.min(F.when(~F.col("__ok"), F.col(name_col))).alias("first_failed"))
    failures = r.where(~F.col("__ok")).drop("__ok")
    return counts, failures


def union_words(df: DataFrame, col: str, order: Sequence[str | Column], sep: str = " ") -> DataFrame:
    """Distinct union of ``sep``-separated lists with first-seen position
    (AGG-6): one row per word with the order key and offset where it first
    appears.  Map-side combining ``min`` keeps frequent words cheap."""
    import re
    words = ensure_parallelism(df).select(_order_key(order).alias("__o"),
                      F.posexplode(F.split(F.col(col), re.escape(sep))).alias("__pos", "word"))
    first = words.groupBy("word").agg(F.min(F.struct("__o", "__pos")).alias("__f"))
    return first.select("word", F.col("__f.__o").alias("first_seen"), (F.col("__f.__pos") + 1).alias("first_pos"))


# ---------------------------------------------------------------------------
# Windows (WIN-2)
# ---------------------------------------------------------------------------

# Progress before the first item and the span the items share.
PROGRESS_START, PROGRESS_SPAN = 30.0, 70.0


def running_progress(items: DataFrame, package: str, order: Sequence[str | Column],
                     start: float = PROGRESS_START, span: float = PROGRESS_SPAN) -> DataFrame:
    """Progress shown before item i of n: ``start + (i-1) * span / n`` (WIN-2)."""
    ranked = rank_within_groups(items, [package], order, out="item_no", with_count="n_items")
    return ranked.withColumn("progress", F.lit(start) + (F.col("item_no") - 1) * F.lit(span) / F.col("n_items"))


# ---------------------------------------------------------------------------
# Sorts, limits, sets (LIM-1 .. LIM-3, SET-1 .. SET-3)
# ---------------------------------------------------------------------------

def limit_n(df: DataFrame, order: Sequence[str | Column], n: int | None) -> DataFrame:
    """First ``n`` rows in ``order``; 0 or None means no limit (LIM-1).
    ``orderBy().limit()`` plans as a per-partition top-k merge."""
    if not n:
        return df
    return df.orderBy(*order).limit(int(n))


def slice_rows(df: DataFrame, order: Sequence[str | Column], start: int, size: int | None) -> DataFrame:
    """Rows ``start .. start+size-1`` in ``order`` (LIM-2); without ``size`` all from ``start`` on.

    With a size it is a top-k merge.  Without, rows are numbered over range
    partitions and filtered, so nothing passes through one task; ``order`` should
    then tell rows apart.
    """
    if size:
        return df.orderBy(*order).offset(int(start)).limit(int(size))
    if not start:
        return df
    return rank_within_groups(df, [], order, out="__place").where(F.col("__place") > int(start)).drop("__place")


def preview(df: DataFrame, order: Sequence[str | Column], n: int = 5) -> DataFrame:
    """First five rows (LIM-3)."""
    return limit_n(df, order, n)


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of pages by column name (SET-1)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct union (SET-2)."""
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame, keys=None, keep_duplicates: bool = True) -> DataFrame:
    """Requested minus known (SET-3): ``left_anti`` keeps duplicates of ``a``;
    otherwise a distinct ``EXCEPT``.  In both, null equals null."""
    if keep_duplicates:
        k = _cols(keys) if keys else a.columns
        known = b.select(*[F.col(c).alias(f"__k_{c}") for c in k]).distinct()
        return a.join(known, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in k], "left_anti")
    return a.subtract(b)


def now_lit(ts: str) -> Column:
    return _lit(ts).cast("timestamp_ntz")
