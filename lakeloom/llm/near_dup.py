"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian pruning, exact check.

1. Every text becomes a set of word-shingle hashes, the hash of that set (its
   *class*: copies share it) and a MinHash signature.
2. Classes that agree on a whole band of the signature meet in a bucket.  Each
   class is compared with the smallest class of its buckets, never with all.
3. A pair's signatures are compared batch by batch; after each batch the pair
   is dropped once the posterior probability (uniform prior) that its similarity
   reaches the threshold is below ``miss``.  What is left is verified on the full
   sets.
4. Confirmed links give components.  Buckets that then still hold more than one
   component go through a second round in which everything outside a bucket's
   main component is compared with all of the bucket: in pairs for buckets up to
   ``PAIR_BUCKET`` classes, beyond that (all larger buckets of one main component
   together) in blocks of about ``BLOCK`` against ``BLOCK`` classes inside one
   task, which verifies them too and returns only links.  So no link between
   different texts is lost in a bucket and a group of copies never makes all its
   pairs.

With 28 bands of 5 values a pair of similarity 0.8 shares no bucket with
probability 1.5e-5, and a more similar one far less often.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bytes_of, over_batches, query, read, small, written
from .shingles import WordHashes, alnum_words, minhash, permutations, plain_words, shingle_sequence

BANDS, BAND_ROWS, SEED = 28, 5, 7
PAIR_BUCKET, BLOCK = 64, 256
WORDS = {"plain": plain_words, "alnum": alnum_words}


def survival_counts(length: int, batch: int, similarity: float, miss: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on) after each batch.

    With a uniform prior the similarity after m matches of n has a
    Beta(m + 1, n - m + 1) posterior, and P(similarity >= t) equals
    P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in [*range(batch, length, batch), length]:
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                              + m * math.log(similarity) + (n + 1 - m) * math.log1p(-similarity))
        out.append((n, m))
    return out


def _survivors(left: np.ndarray, right: np.ndarray, counts: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows of two signature matrices that no batch drops."""
    alive, matches, start = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for n, least in counts:
        matches = matches + (left[alive, start:n] == right[alive, start:n]).sum(axis=1, dtype=np.int32)
        go = matches >= least
        alive, matches, start = alive[go], matches[go], n
    return alive


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def _sets(words: str, k: int, with_set: bool):
    """Batch function: pass ``keep`` columns on and add class, set size, and signature (and set)."""
    def run(batches):
        hashes, (a, b) = WordHashes(), permutations(BANDS * BAND_ROWS, SEED)
        split = WORDS[words]
        for batch in batches:
            node, size, sigs, sets = [], [], [], []
            for text in batch.column("__text").to_pylist():
                s = np.unique(shingle_sequence(split(text), k, hashes)) if text else ()
                size.append(len(s))
                if not len(s):
                    node.append(None), sigs.append(None), sets.append(None)
                    continue
                raw = s.tobytes()
                node.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                sigs.append(minhash(s, a, b).tobytes())
                sets.append(raw if with_set else None)
            cols = {n: batch.column(n) for n in ("__id", "__th")} | {
                "node": pa.array(node, pa.int64()), "n": pa.array(size, pa.int64()), "sig": pa.array(sigs, pa.binary())}
            yield pa.RecordBatch.from_pydict(cols | ({"shingles": pa.array(sets, pa.binary())} if with_set else {}))
    return run


def _bands(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Band keys of each signature: one row per class and band."""
    sig = _matrix(batch.column("sig"), BANDS * BAND_ROWS).reshape(-1, BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = np.broadcast_to(key, sig.shape[:2]).copy()
    for j in range(BAND_ROWS):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + sig[:, :, j]
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    node = np.repeat(batch.column("node").to_numpy(), BANDS)
    return pa.RecordBatch.from_pydict({"bucket": pa.array(key.reshape(-1).view(np.int64)), "node": pa.array(node)})


def _verify(pairs: DataFrame, nodes: DataFrame, similarity: float, miss: float, batch_values: int) -> DataFrame:
    """Pairs (a, b) of classes whose signatures survive."""
    width = BANDS * BAND_ROWS
    counts = survival_counts(width, batch_values, similarity, miss)

    def prune(batch: pa.RecordBatch) -> pa.RecordBatch:
        alive = _survivors(_matrix(batch.column("sa"), width), _matrix(batch.column("sb"), width), counts)
        return batch.select(["a", "b"]).take(pa.array(alive))

    sig = nodes.select("node", "sig")
    return (pairs.join(sig.toDF("b", "sb"), "b").join(sig.toDF("a", "sa"), "a").select("a", "b", "sa", "sb")
            .mapInArrow(over_batches(prune), "a long, b long"))


def _exact(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity."""
    percent = round(similarity * 100, 6)

    def confirm(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int((y[at] == x).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                keep.append(i)
        return batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    sets = nodes.select("node", "shingles")
    return (pairs.join(sets.toDF("b", "xb"), "b").join(sets.toDF("a", "xa"), "a").select("a", "b", "xa", "xb")
            .mapInArrow(over_batches(confirm), "a long, b long"))


def _common(one: np.ndarray, codes: np.ndarray, starts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Shingles that a set has in common with each of several sets laid end to end."""
    marks[one] = True
    found = np.add.reduceat(marks[codes], starts, dtype=np.int64)
    marks[one] = False
    return found


def _blocks(outside: DataFrame, members: DataFrame, nodes: DataFrame, similarity: float, miss: float,
            batch_values: int) -> DataFrame:
    """Links between the outside classes and all classes of a large group, block against block.

    Signatures prune and full sets confirm within the task, so that only links leave it.
    """
    width = BANDS * BAND_ROWS
    counts = survival_counts(width, batch_values, similarity, miss)
    percent = round(similarity * 100, 6)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        out, side = [], group["outside"].to_numpy()
        sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(-1, width)
        node, comp = group["node"].to_numpy(), group["comp"].to_numpy()
        raw = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        size = np.array([len(x) for x in raw])
        names, codes = np.unique(np.concatenate(raw), return_inverse=True)
        own = np.split(codes, np.cumsum(size)[:-1])
        marks = np.zeros(len(names), bool)
        rest = np.flatnonzero(~side)
        if not len(rest):
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        laid, starts = np.concatenate([own[k] for k in rest]), np.cumsum(size[rest]) - size[rest]
        for i in np.flatnonzero(side):
            alive = np.flatnonzero(comp[rest] != comp[i])
            alive = alive[_survivors(np.broadcast_to(sig[i], (len(alive), width)), sig[rest[alive]], counts)]
            if len(alive):
                common = _common(own[i], laid, starts, marks)[alive]
                hit = rest[alive[100 * common >= percent * (size[i] + size[rest[alive]] - common)]]
                out += [(min(node[i], m), max(node[i], m)) for m in node[hit]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    def dealt(df: DataFrame, own: str, other: str, flag: bool) -> DataFrame:
        """Each class goes to its own block and meets every block of the other side."""
        mine = F.pmod(F.xxhash64("node"), F.col(own))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        x, y = (mine, every) if flag else (every, mine)
        return df.select("main", "node", "comp", F.lit(flag).alias("outside"), x.alias("x"), y.alias("y"))

    both = dealt(outside, "nx", "ny", True).unionAll(dealt(members, "ny", "nx", False))
    return (both.join(nodes.select("node", "sig", "shingles"), "node").groupBy("main", "x", "y")
            .applyInPandas(lambda key, g: compare(g), "a long, b long").distinct())


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: str = "alnum",
                          shingle_words: int = 5, similarity: float = 0.8, miss: float = 1e-6,
                          batch_values: int = 28) -> DataFrame:
    """One row per input row: ``doc_id, text_hash, n_shingles, component_id, group_key, kept``.

    ``component_id`` is the smallest id of the rows linked with this one, itself
    included; ``kept`` says that it is this row's own id.  ``group_key`` names the
    group (null without shingles) and ``text_hash`` is ``xxhash64`` of the text, so
    that a caller finds its rows again.  ``words`` is ``plain`` (split at ASCII
    white space) or ``alnum`` (letters and digits only), both with A-Z lower-cased.

    Texts with fewer words than a shingle have the whole sequence as their one
    shingle.  Null, empty and wordless texts have ``n_shingles`` 0 and are linked
    with nothing.  Repeated rows are copies of one another and each is returned;
    rows that repeat an id with another text are linked by their texts alone.  A
    null id never is the smallest; a group of null ids only has a null
    ``component_id`` and all its rows are kept.  Other columns are not read; an
    empty table gives no rows.
    """
    text = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__th"),
                       bytes_of(text_col).alias("__text"))
    base = "__id long, __th long, node long, n long, sig binary"
    texts = written(text.mapInArrow(_sets(words, shingle_words, False), base), "texts")

    bands = texts.filter("node is not null").select("node", "sig").mapInArrow(over_batches(_bands), "bucket long, node long")
    mixed = bands.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub < top")
    members = written(bands.join(mixed.drop("top"), "bucket").distinct(), "members")

    first = (texts.join(members.select("node").distinct(), "node", "left_semi").groupBy("node")
             .agg(F.min(F.struct("__id", "__th")).alias("r")).select(F.col("node").alias("__node"), "r.*"))
    first = written(first, "first").withColumnRenamed("__id", "__rid").withColumnRenamed("__th", "__rth")
    found = text.join(small(first.select("__rid", "__rth")), F.col("__id").eqNullSafe(F.col("__rid")) & (F.col("__th") == F.col("__rth")), "left_semi")
    nodes = found.mapInArrow(_sets(words, shingle_words, True), base + ", shingles binary").select("node", "sig", "shingles")
    nodes = written(nodes.join(first.select(F.col("__node").alias("node")), "node", "left_semi").dropDuplicates(["node"]), "nodes")

    check = (similarity, miss, batch_values)
    star = members.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = written(_exact(_verify(star, nodes, *check), nodes, similarity), "links")
    roots = connected_components(links)

    again = members.drop("hub").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp"))
    main = (again.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket")
            .agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("total"))
            .filter("most < total"))
    again = written(again.join(main, "bucket"), "again")
    outside = again.filter("comp != main")
    few = again.filter(F.col("total") <= PAIR_BUCKET)
    pairs = (outside.filter(F.col("total") <= PAIR_BUCKET).select("bucket", F.col("node").alias("p"), F.col("comp").alias("pc"))
             .join(few.select("bucket", F.col("node").alias("q"), F.col("comp").alias("qc")), "bucket").filter("pc != qc")
             .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct().join(star, ["a", "b"], "left_anti"))
    # large buckets with one main component hold much the same classes in every band: they are compared once
    many = again.filter(F.col("total") > PAIR_BUCKET).select("main", "node", "comp").distinct()
    blocks = F.ceil(F.count("*") / BLOCK).alias("ny"), F.greatest(F.ceil(F.count_if(F.col("comp") != F.col("main")) / BLOCK), F.lit(1)).alias("nx")
    many = written(many.join(many.groupBy("main").agg(*blocks), "main"), "many")
    late = written(_exact(_verify(pairs, nodes, *check), nodes, similarity).unionAll(_blocks(many.filter("comp != main"), many, nodes, *check)), "links")
    roots = connected_components(links.unionAll(late))

    out = texts.select("__id", "__th", "node", "n").join(roots, "node", "left").withColumn("group_key", F.coalesce("root", "node"))
    low = out.filter("group_key is not null").groupBy("group_key").agg(F.min("__id").alias("low"))
    # written, so that a hot group's rows can be split over tasks in the join
    out = out.join(written(low, "low"), "group_key", "left").withColumn("low", F.when(F.col("node").isNull(), F.col("__id")).otherwise(F.col("low")))
    return out.select(F.col("__id").alias("doc_id"), F.col("__th").alias("text_hash"), F.col("n").alias("n_shingles"),
                      F.col("low").alias("component_id"), "group_key", F.col("__id").eqNullSafe(F.col("low")).alias("kept"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one row of each group of near duplicates.

    Of a group the row with the smallest id stays; of rows that repeat both id
    and text one stays, and of a group of null ids only one text does.  Rows
    without words all stay.
    """
    groups = near_duplicate_groups(docs, id_col, text_col, **options).filter("kept and group_key is not null")
    keep = groups.groupBy("group_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*")
    keep = written(keep, "keep").toDF("__kid", "__kth")
    own = docs.withColumns({"__kid0": F.col(id_col).cast("long"), "__kth0": F.xxhash64(text_col)})
    worded = F.coalesce(F.length(F.regexp_replace(F.col(text_col), WORDLESS[options.get("words", "alnum")], "")) > 0, F.lit(False))
    rows = own.filter(worded).join(keep, F.col("__kid0").eqNullSafe(F.col("__kid")) & (F.col("__kth0") == F.col("__kth")), "left_semi")
    rows = rows.dropDuplicates(["__kid0", "__kth0"]).unionAll(own.filter(~worded))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


#: What makes no word, as Java patterns.
WORDLESS = {"plain": r"[\x20\x09-\x0D]+", "alnum": r"(?i)[\x00-\x7F&&[^A-Za-z0-9]]+"}


@query("op1_near_duplicates")
def op1_near_duplicates(spark, sf_dir):
    groups = near_duplicate_groups(read(spark, sf_dir, "documents"), words="plain", shingle_words=2)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")
