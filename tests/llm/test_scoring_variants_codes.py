"""Language model, spelling variants and vector codes against brute force; words, letters and labels of the classifiers."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import language_crf, pitman_yor, quality_net, spelling_variants, subwords, toxicity, vector_codes

DOCS = "doc_id long, text string, lang string, score string, word string, key string"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    rows = [(0, "a b a"), (0, "a b a"), (1, None), (2, ""), (3, " \n\t"), (4, text(5000)), (None, "a B c"), (None, None), (5, "日本 A\x00b ÄÖ"), (6, text(40)), (2024, "new words only here")]
    return spark.createDataFrame([(*r, None, "x", None, "y") for r in rows], DOCS)


# ---- language model ------------------------------------------------------------------

def test_scores_against_counts(odd):
    rows = odd.collect()
    tokens = [[*(r.text or "").lower().split(), None] for r in rows]
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r.doc_id), h, len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t, h in zip(rows, tokens, held))
    for shipped in (pitman_yor.SHIPPED, 10):
        got = pitman_yor.score_texts(odd, shipped_types=shipped).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
        first = sorted((str(r.doc_id), round(r.score, 9)) for r in got) if shipped == pitman_yor.SHIPPED else first
        assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == first
    assert pitman_yor.score_texts(odd.limit(0)).count() == 0
    assert [r.score for r in pitman_yor.score_texts(odd.filter("doc_id = 1"), held_out=lambda c: F.lit(True)).collect()] == [0.0]


def test_probabilities_sum_to_one_in_every_restaurant(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("the cat dog runs sees a big red house of".split()) for _ in range(60))) for i in range(40)], "doc_id long, text string")
    own = docs.select(F.lit(False).alias("__held"), F.col("text").alias("__text"))
    contexts = pitman_yor.choose_contexts(pitman_yor.token_counts(own))
    types = pitman_yor.type_counts(own, contexts).cache()
    _, settings, tokens, vocabulary = pitman_yor.fit_types(types, contexts)
    assert tokens == 40 * 61 and vocabulary == 11
    for s in settings:
        rows = types.orderBy("w").collect()
        w = np.array([r.w for r in rows])
        assert s.customers[0] == s.tables[1:][contexts.parent[1:] == 0].sum() and (s.tables <= s.customers).all()
        # any tables between the bounds: with the totals that they add up to, probabilities sum to one
        r = np.concatenate([np.arange(1, pitman_yor.RESTAURANTS)] * len(w))
        row = np.repeat(np.arange(len(w)), pitman_yor.RESTAURANTS - 1)
        n = np.zeros(len(r), np.int64)
        at = {(i, e): k for k, (i, e) in enumerate(zip(row.tolist(), r.tolist()))}
        for i, t in enumerate(rows):
            for e, count in zip(t.r, t.n):
                n[at[i, e]] = count
        dishes, _ = pitman_yor.Dishes.of_types(w, row, r, n, n + 1, contexts)
        dishes.seat_all(s)
        dishes.sweep(s, 1)
        tables = dishes.table_counts()
        own_totals = pitman_yor.Setting(contexts, s.discount, vocabulary, tokens, np.bincount(dishes.e, dishes.customer_counts(tables), pitman_yor.RESTAURANTS),
                                        np.bincount(dishes.e, tables, pitman_yor.RESTAURANTS))
        p = np.bincount(dishes.e, dishes.probabilities(own_totals, tables), pitman_yor.RESTAURANTS)
        unknown, _ = pitman_yor.Dishes.of_types(np.array([7]), np.zeros(pitman_yor.RESTAURANTS - 1, np.int64), np.arange(1, pitman_yor.RESTAURANTS), np.zeros(pitman_yor.RESTAURANTS - 1, np.int64),
                                                np.ones(pitman_yor.RESTAURANTS - 1, np.int64), contexts)
        p += unknown.probabilities(own_totals, np.zeros(pitman_yor.RESTAURANTS, np.int64))
        assert p == pytest.approx(np.ones(pitman_yor.RESTAURANTS))


def partitions(n, d, a):
    """Weight of every seating of n customers of one dish, by number of tables, from the joint probability."""
    weight = Counter()
    for rest in itertools.product(*(range(i + 1) for i in range(n))):
        sizes, w = [], 1.0
        for i, t in enumerate(rest):
            if t > len(sizes):
                break
            if t == len(sizes):
                w *= a
                sizes.append(1)
            else:
                w *= sizes[t] - d
                sizes[t] += 1
        else:
            weight[len(sizes)] += w
    total = sum(weight.values())
    return {t: w / total for t, w in weight.items()}


def test_gibbs_moves_keep_the_posterior_of_the_tables():
    d, a, n, many = 0.4, 0.7, 4, 20_000
    rng = np.random.default_rng(1)
    which = np.arange(many)
    seats = pitman_yor.Seating(np.zeros(0, np.int64), np.zeros(0, np.int64), many)
    seats.fill(np.full(many, n), lambda w, i: rng.random(len(w)), d, np.full(many, a))
    for _ in range(30):
        seats.remove(which, rng.random(many))
        seats.add(which, rng.random(many), d, np.full(many, a))
    assert (seats.customers() == n).all()
    share = np.bincount(seats.tables(), minlength=n + 1) / many
    for t, p in partitions(n, d, a).items():
        assert share[t] == pytest.approx(p, abs=0.015)


def test_many_customers_are_all_seated():
    rng = np.random.default_rng(2)
    count = np.array([0, 1, 31, 32, 33, 5_000, 1_000_000])
    seats = pitman_yor.Seating(np.zeros(0, np.int64), np.zeros(0, np.int64), len(count))
    seats.fill(count, lambda w, i: rng.random(len(w)), 0.5, np.full(len(count), 2.0))
    assert seats.customers().tolist() == count.tolist() and (seats.size > 0).all() and (np.diff(seats.own) >= 0).all()


def test_model_beats_the_base_on_held_out_texts(spark):
    scored = pitman_yor.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out")
    base, model = scored.agg(F.sum("base_score"), F.sum("score")).first()
    assert model > base + 0.1 * scored.agg(F.sum("n_tokens")).first()[0]


# ---- spelling variants ---------------------------------------------------------------

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def test_near_words_against_all_pairs(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(500)} | {"a" * 200, "a" * 201, "a" * 199 + "b", "b" + "a" * 199})
    counts = {w: rng.randint(3, 9) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = {}
    for a in words:
        own = [b for b in words if near(a, b)]
        if own:
            want[a] = (len(own), min((-counts[b], b) for b in own))
    for most in (spelling_variants.PIECE_WORDS, 8):
        got = {r.word: (r.n_near, (r.best.less, r.best.near)) for r in spelling_variants.near_words(df, most).collect()}
        assert got == want


def test_composition_is_minimal_and_finds_pairs_once():
    words = sorted({"".join(p) for k in (2, 3) for p in itertools.product("ab", repeat=k)})
    a = spelling_variants.Acceptor(words)
    assert len(a.next) == 4  # one state a length: all words of two and three symbols
    found = spelling_variants.Composition(words).pairs()
    assert len(found) == len(set(map(frozenset, found))) and set(map(frozenset, found)) == {frozenset((x, y)) for x in words for y in words if near(x, y)}


def test_words_of_texts(spark):
    text = "Öl öl haus HAUS Haus hauss hauss hauss hausx hausx hausx a×b÷c " + "x" * 30_000
    rows = [(1, text, None), (2, text, None), (2, text, None), (None, text, "k"), (3, None, None), (4, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    want = Counter()
    for i, t, _ in rows:
        for run in __import__("re").findall("[a-zÀ-ÿ]+", (t or "").translate({c: c + 32 for c in range(65, 91)})):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run
            want[run] += len(run) >= 5
    got = {r.word: r for r in spelling_variants.group_variants(df).collect()}
    assert {w: r.n for w, r in got.items()} == {w: n for w, n in want.items() if n >= 3}
    plain = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.group_variants(df, typo_mod=None, least_length=1).collect()}
    assert plain["hauss"] == (None, "hauss", 12, 2, None) and plain["haus"] == (None, "haus", 12, 2, None)
    assert spelling_variants.group_variants(df.limit(0)).count() == 0


def test_roots_follow_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "w3")], "word string, form string")
    assert {r.root for r in spelling_variants.roots(forms).collect()} == {"w9"}


# ---- vector codes --------------------------------------------------------------------

def brute_codes(rows, parts, entries, rounds, scale):
    """Plain k-means over (id, vector, label)."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    seeds = {}
    for i, v, _ in kept:
        seeds[i] = min(v, seeds.get(i, v))
    ids = sorted(seeds, key=lambda i: (i is None, i))[:entries]
    wide = len(kept[0][1]) // parts
    books = [[seeds[i][p * wide:(p + 1) * wide] for i in ids] for p in range(parts)]

    def assign(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for r in range(rounds + 1):
        found = [[assign(v[p * wide:(p + 1) * wide], books[p]) for p in range(parts)] for _, v, _ in kept]
        if r < rounds:
            for p in range(parts):
                for e in range(len(ids)):
                    own = [v[p * wide:(p + 1) * wide] for (_, v, _), f in zip(kept, found) if f[p][1] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    error = Counter()
    for (_, _, lab), f in zip(kept, found):
        error[lab] += sum(d for d, _ in f)
    return sorted((str(i), "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), error[lab]) for (i, _, lab), f in zip(kept, found))


@pytest.mark.parametrize("seed,count,entries", [(1, 300, 16), (2, 40, 16), (3, 5, 16), (4, 200, 7)])
def test_codes_against_plain_k_means(spark, seed, count, entries):
    rng = random.Random(seed)
    step = lambda: rng.choice([0.0, 0.25, -0.25, rng.uniform(-1, 1), rng.gauss(0, 2)])
    rows = [(i, [step() for _ in range(16)], rng.choice([None, 1, 2])) for i in range(count)]
    rows += [(None, rows[0][1], 1), (0, rows[1][1], None), (0, rows[0][1], 2), (count, None, 1), (count + 1, [None] + rows[0][1][1:], 1), (count + 2, [float("nan")] * 16, 1),
             (count + 3, [float("inf")] + rows[0][1][1:], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string")
    as_float = [(i, v and [x if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got = vector_codes.code_report(df, parts=4, entries=entries, rounds=5, scale=64).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == brute_codes(as_float, 4, entries, 5, 64)
    assert len({r.codebooks_sha256 for r in got}) == 1


def test_bounds_save_distances_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 10, (16, 32))
    rows = [(i, (centres[i % 16] + rng.normal(0, 0.05, 32)).tolist(), 0) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    codes, books = vector_codes.compress(df)
    assert len(books.history) == vector_codes.ROUNDS + 1
    assert codes.agg(F.sum("measured")).first()[0] < 0.2 * 600 * vector_codes.PARTS * vector_codes.ENTRIES
    assert vector_codes.code_report(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="one length"):
        vector_codes.code_report(df.unionAll(spark.createDataFrame([(900, [1.0] * 8, 0)], df.schema))).count()
    with pytest.raises(Exception, match="don't fit"):
        vector_codes.code_report(spark.createDataFrame([(1, [1e9] * 8, 0)], df.schema)).count()


# ---- classifiers ---------------------------------------------------------------------

def test_words_keep_digits_and_marks():
    assert subwords.marked_words("you h4te, id*ot! a.b \"q-r\" 12 &&& x$$$ 3d") == ["you", "h4te", "id*ot", "a", "b", "q", "r", "x", "d"]
    grams = lambda w: set(subwords.ngram_ids([w], toxicity.LO, toxicity.HI, 40)[0].tolist())
    assert len(grams("h4te") & grams("hate")) > len(grams("h4te") & grams("home")) and len(grams("id*ot") & grams("idiot")) >= 2


def test_toxicity_windows_against_a_plain_loop():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["good", "bad", "h4te", "x", "day"]) for _ in range(n)) for n in (0, 1, 2, 3, 50)]
    model = toxicity.ToxicityModel(np.random.default_rng(1).normal(size=1 << toxicity.BITS), 0.3, 1.0, 0.0)
    score = {w: float(model.word_scores([w])[0]) for w in ("good", "bad", "h4te", "x", "day")}
    want = []
    for t in texts:
        w = t.split()
        runs = [w[i:i + toxicity.WINDOW] for i in range(max(len(w) - toxicity.WINDOW + 1, 1))] if w else []
        want.append(max((sum(score[x] for x in r) / len(r) + 0.3 for r in runs), default=0.3))
    assert model.worst(texts, toxicity.WordTable(model.word_scores)) == pytest.approx(np.array(want))


def test_letters_are_category_l(spark):
    assert subwords.letter_runs("²½①Ⅷ a²b é٣ß") == ["a", "b", "é", "ß"]
    model = language_crf.train(["der hund " * 9, "the dog " * 9], ["de", "en"])
    df = spark.createDataFrame([(1, "²½① Ⅷ 12"), (2, "the dog"), (3, None)], "doc_id long, text string")
    assert [r.lang_pred for r in language_crf.identify_language(df, model).orderBy("doc_id").collect()] == ["und", "en", "und"]
    with pytest.raises(ValueError):
        language_crf.identify_language(df.withColumn("Score", F.lit(1)), model)
    assert "p" in language_crf.identify_language(df.withColumn("score", F.lit(1)), model, score="p").columns


def test_word_vectors_are_sums_over_neighbours(spark):
    texts = ["THE NICE cat 2024 sat", "the nice cat 1999 sat THE", None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    own = quality_net.frequent_tokens(docs)
    rows = quality_net.TokenRows(own)
    assert len({rows[w] for w in ("THE", "NICE", "the", "2024", "1999")}) == 5 and max(rows.values()) < quality_net.OWN
    plus, minus = quality_net.index_vectors()
    sums, seen = np.zeros((quality_net.ROWS, quality_net.DIM)), np.zeros(quality_net.ROWS)
    for t in texts:
        at = [rows[w] for w in (t or "").split()]
        for i, r in enumerate(at):
            seen[r] += 1
            for j in range(max(0, i - 2), min(len(at), i + 3)):
                if j != i:
                    sums[r, plus[at[j]]] += 1
                    sums[r, minus[at[j]]] -= 1
    mean = sums / np.maximum(seen, 1)[:, None]
    mean -= (mean * seen[:, None]).sum(axis=0) / seen.sum()
    mean[seen == 0] = 0
    want = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
    vectors = quality_net.context_vectors(docs, own)
    assert vectors == pytest.approx(want, abs=1e-6)
    for t, got in zip(texts, quality_net.pooled(texts, vectors, rows)):
        at = [rows[w] for w in (t or "").split()]
        if at:
            assert got[:quality_net.DIM] == pytest.approx(vectors[at].mean(axis=0), abs=1e-6) and got[quality_net.DIM:2 * quality_net.DIM] == pytest.approx(vectors[at].std(axis=0), abs=1e-5)
            assert got[-2] == pytest.approx(len(set(at)) / len(at))
        else:
            assert not got.any()


@pytest.mark.parametrize("rows", [[], [(0, 1, 0)], [(0, 0, 1), (4, 0, 1)]])
def test_a_fit_without_both_labels_rejects_nothing(spark, odd, tmp_dir, rows):
    import corpus_pipeline
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    for stage in (corpus_pipeline.quality, corpus_pipeline.toxicity):
        assert stage(spark, odd, tmp_dir).count() == odd.count()


def test_text_columns_go_to_tasks_once(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F
    from lakeloom.llm.shared import appended
    docs = spark.createDataFrame([(1, "ab", ("x",)), (2, None, None)], "doc_id long, Text string, s struct<t string>")

    def make():
        return lambda batch: [pa.array([len(t or "") for t in batch.column("__text").to_pylist()], pa.int32())]

    for given, copied, want in (("text", False, 2), (F.col("text"), True, 2), ("s.t", True, 1)):
        out = appended(docs, {"__text": given}, make, "n int")
        assert out.columns == ["doc_id", "Text", "s", "n"] and {(r.doc_id, r.n) for r in out.collect()} == {(1, want), (2, 0)}
        assert ("__text" in out._jdf.queryExecution().optimizedPlan().toString()) == copied
    with pytest.raises(ValueError):
        appended(docs, {"TEXT": "s.t"}, make, "n int")
