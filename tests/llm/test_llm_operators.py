"""Each operator against brute force, round trips or held-out labels, and its edge cases."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import (decontaminate, html_text, language_crf, near_dup, quality_net, quality_rules, sentencepiece_ops,
                          token_counts, toxicity, warc)
from lakeloom.llm.components import connected_components
from lakeloom.llm.sentencepiece_model import parse_model
from lakeloom.llm.shared import ORACLES, crc_mod, query

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, hits string, ids string, component_id string"


def words(seed, n, pool=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, copies, repeated rows and ids, columns with operators' names."""
    base, long = words(1, 120), words(2, 60_000, 5000)
    near = base.replace(" w", " W", 3) + " extra"
    texts = [(0, base), (0, base), (1, base), (2, near), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, long + " tail"), (None, base), (None, None),
             (8, "!!! ### 123"), (8, words(3, 80)), (9, "one"), (10, "ONE"), (11, "\x00 ́ ▁ 日本語 𝔘 " + words(4, 70))]
    rows = [(i, t, None if k % 3 else "en", None, None, "x", None, "y", "z", None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 1, 1), (2, None, None), (None, 1, 1), (6, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")


def empty(df):
    return df.limit(0)


# ---- near duplicates -----------------------------------------------------------------

def brute_groups(rows, k):
    """Smallest reachable id of every (id, text), by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def groups(df, **kw):
    got = near_dup.near_duplicate_groups(df, words="plain", shingle_words=2, **kw).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def test_groups_of_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert groups(odd) == brute_groups(rows, 2)
    assert groups(empty(odd)) == []
    kept = near_dup.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    # base copies keep one row; wordless texts all stay
    assert kept.filter("text like 'w%' and length(text) < 1000").count() == 2 and kept.filter("text is null").count() == 2


@pytest.mark.parametrize("pair_bucket,block", [(64, 256), (1, 4)])
def test_groups_of_edited_copies(spark, monkeypatch, pair_bucket, block):
    monkeypatch.setattr(near_dup, "PAIR_BUCKET", pair_bucket)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng, rows = random.Random(5), []
    for g in range(6):
        base = words(100 + g, 60).split()
        for c in range(12):
            own = base[:]
            for _ in range(rng.randrange(9)):
                own[rng.randrange(60)] = f"e{rng.randrange(9999)}"
            rows.append((g * 100 + c, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups(df) == brute_groups(rows, 2)


def test_survival_counts_follow_the_posterior():
    for n, m in near_dup.survival_counts(140, 28, 0.8, 1e-6):
        tail = lambda k: sum(math.comb(n + 1, j) * 0.8**j * 0.2**(n + 1 - j) for j in range(k + 1))
        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionAll(spark.createDataFrame([(100, 101), (7, 7)], "a long, b long"))
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert connected_components(empty(edges)).count() == 0


# ---- decontamination -----------------------------------------------------------------

def test_contained_items(spark, odd):
    item = words(50, 30, 5000)
    part = " ".join(item.split()[:27])
    docs = odd.unionByName(spark.createDataFrame(
        [(20, words(51, 30_000, 5000) + " " + item.upper() + "! " + words(52, 400)), (21, words(53, 50) + " " + part), (22, " ".join(item.split()[:20])), (23, "one")],
        "doc_id long, text string"), allowMissingColumns=True)
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "one"), (1, item), (5, words(2, 40, 5000))], "item_id long, text string")
    got = decontaminate.contained_items(docs, items, out="found").select("doc_id", "text", F.explode("found.item_id").alias("i")).collect()
    assert sorted((r.doc_id, r.i) for r in got) == [(6, 5), (7, 5), (9, 4), (10, 4), (20, 1), (21, 1), (23, 4)]
    assert decontaminate.without_contained_items(docs, items).columns == odd.columns
    assert decontaminate.contained_items(docs, empty(items), out="found").filter("size(found) > 0").count() == 0
    assert decontaminate.contained_items(empty(docs), items, out="found").count() == 0


def test_shortest_items_are_found_without_a_miss():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, 1 + i % 6, dtype=np.uint64)) for i in range(6000)]
    index = decontaminate.ItemIndex(list(enumerate(sets)), 0.8, 1e-6)
    for i, own in enumerate(sets):
        n = len(own)
        need = math.ceil(0.8 * n - 1e-9)
        some = rng.permutation(own)
        for hit in (need, need - 1):
            seq = rng.permutation(np.concatenate([some[:hit], rng.integers(1 << 63, 1 << 64, 16 - hit, dtype=np.uint64)]))
            assert index.hits(seq) == ([(i, n, hit)] if hit == need else [])


# ---- web archives --------------------------------------------------------------------

def test_archive_round_trip(spark, tmp_dir):
    body = "<p>" + "é" * 60 + "</p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [(3, "http://a/x y", body), (1, "http://b", body), (2, None, body), (1, "http://b", body), (4, "u", "small"), (5, "u", "small"), (6, None, None), (None, "n", body), (7, "u", ""), (8, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    warc.write_captures(pages, f"{tmp_dir}/w", records_per_file=4)
    records = warc.read_records(spark, f"{tmp_dir}/w", with_payload=True)
    assert records.count() == 3 * len(rows)
    captures = warc.resolve_revisits(warc.assemble(records)).collect()
    assert len(captures) == len(rows) and all(c.n_records == 3 and c.request and c.metadata for c in captures)
    got = sorted(((c.page_id, c.payload_bytes, c.payload_digest, c.record_type, c.refers_to) for c in captures), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h == body and i != 1
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)
    payloads = {c.page_id: bytes(c.response.payload) for c in captures if c.record_type == "response"}
    assert payloads[1] == body.encode() and payloads[8] == b"z" * 300_000
    warc.write_captures(empty(pages), f"{tmp_dir}/e")
    assert warc.assemble(warc.read_records(spark, f"{tmp_dir}/e")).count() == 0


def test_transactions_through_other_links(spark):
    schema = warc.RECORD_FIELDS
    rec = lambda i, kind, to: (i, kind, None, to, None, None, 0, None)
    rows = [rec("r1", "response", "q1"), rec("q1", "request", None), rec("m1", "metadata", "q1"), rec("q2", "request", "r2"), rec("r2", "response", None),
            rec("m2", "metadata", "q2"), rec("m3", "metadata", "gone"), rec(None, "request", "r2")]
    got = {r.capture_id: (r.response and r.response.record_id, r.request and r.request.record_id, r.metadata and r.metadata.record_id)
           for r in warc.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"r1": ("r1", "q1", "m1"), "r2": ("r2", "q2", "m2"), "gone": (None, None, "m3")}


def test_broken_archives_are_reported():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse_records(good * 2)] == [b"abc"] * 2
    for bad in (b"junk", good[:-9], b"WARC/1.1\r\nA: b\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))


# ---- models --------------------------------------------------------------------------

def test_forward_backward_against_plain_recursion():
    rng = np.random.default_rng(0)
    counts = np.array([3, 0, 64, 65, 1, 200])
    emit, move, start = np.exp(rng.normal(size=(counts.sum(), 3)) * 2), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, at = language_crf.marginals(emit, counts, move, start), 0
    for c in counts[counts > 0]:
        e = emit[at:at + c]
        f, b = [np.exp(start) * e[0]], [np.ones(3)]
        for t in range(1, c):
            f.append((f[-1] @ np.exp(move)) * e[t])
            f[-1] /= f[-1].sum()
        for t in range(c - 2, -1, -1):
            b.append(np.exp(move) @ (b[-1] * e[t + 1]))
            b[-1] /= b[-1].sum()
        p = np.array(f) * np.array(b[::-1])
        assert np.allclose(got[at:at + c], p / p.sum(axis=1, keepdims=True))
        at += c


def test_language_of_held_out_and_odd_texts(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_crf.fit_languages(docs)
    found = language_crf.identify_language(docs.select("doc_id", "text", "lang"), model)
    held = found.filter(crc_mod("doc_id", 4) == 2)
    assert held.filter("lang = lang_pred").count() >= 0.98 * held.count()
    got = language_crf.identify_language(odd.drop("score"), model).select("text", "lang_pred", "score").collect()
    assert all((r.lang_pred == "und" and r.score == 0) == (not re.search(r"[^\W\d_]", r.text or "")) and 0 <= r.score <= 1 for r in got)
    assert language_crf.identify_language(empty(odd).drop("score"), model).count() == 0
    nothing = language_crf.fit_languages(empty(odd))
    assert {r.lang_pred for r in language_crf.identify_language(odd.drop("score"), nothing).collect()} == {"und"}


def test_code_switched_words():
    model = language_crf.train(["der hund und die katze " * 9, "the dog and the cat " * 9], ["de", "en"])
    words_ = "der hund und die katze the dog and the cat".split()
    p = language_crf.marginals(model.potentials(words_), np.array([10]), model.transitions, model.start)
    assert p.argmax(axis=1).tolist() == [0] * 5 + [1] * 5


@pytest.mark.parametrize("fit,score,label,mod,rest", [(toxicity.fit_toxicity, toxicity.score_toxicity, "toxic", 5, 0), (quality_net.fit_quality, quality_net.score_quality, "quality", 4, 2)])
def test_classifiers(spark, odd, labels, fit, score, label, mod, rest):
    sf = "/root/testdata/sf0.01"
    docs, own = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit(docs, own)
    held = score(docs, model, out="p").join(own, "doc_id").filter(crc_mod("doc_id", mod) == rest).selectExpr("p", f"{label} as y").collect()
    assert np.mean([(r.p >= 0.5) == (r.y == 1) for r in held]) >= 0.95
    for m in (model, fit(odd, labels), fit(empty(odd), empty(labels))):
        got = score(odd, m, out="p").collect()
        assert len(got) == odd.count() and all(0 <= r.p <= 1 for r in got)
        assert len({r.p for r in got if not r.text}) == 1
        assert score(empty(odd), m, out="p").count() == 0


def test_misspelt_toxic_words_share_n_grams():
    rng = random.Random(1)
    toxic = [f"{words(i, 15)} horribleperson {words(i + 500, 15)}" for i in range(60)]
    clean = [words(i + 1000, 30) for i in range(120)]
    model = toxicity.train(toxic + clean, np.array([1] * 60 + [0] * 120))
    seen = toxicity.WordTable(model.word_scores)
    p = model.scores([words(7, 20) + " horribbleperson", words(8, 20), ""], seen)
    assert p[0] > 0.5 > p[1] and 0 <= p[2] <= 1 and rng


def test_toxicity_learns_from_long_texts_and_ids_that_have_one(spark):
    def text(i):
        return f"{words(i, 1500)} {'horribleperson' if i % 3 == 0 else 'w1'} {words(i + 5000, 1500)}"
    docs = spark.createDataFrame([(i, text(i)) for i in range(180)], "doc_id long, text string")
    own = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(20_000)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, own)
    got = toxicity.score_toxicity(docs, model, out="p").select("doc_id", "p").collect()
    assert np.mean([(r.p >= 0.5) == (r.doc_id % 3 == 0) for r in got]) >= 0.95


def test_toxicity_without_both_labels_rejects_nothing(spark):
    docs = spark.createDataFrame([(i, words(i, 30)) for i in range(40)], "doc_id long, text string")
    for own in ([(1_000_000, 1)], [(i, 1) for i in range(40)], [(i, 0) for i in range(40)]):
        model = toxicity.fit_toxicity(docs, spark.createDataFrame(own, "doc_id long, toxic int"))
        assert all(r.p < 0.5 for r in toxicity.score_toxicity(docs, model, out="p").collect())


def test_every_sampled_text_is_trained_on_or_left_for_the_logistic_fit():
    sizes, y = np.array([20_000_000, 10] * 40), np.array([1.0] * 40 + [0.0] * 40)
    aside = toxicity.set_aside(y, np.random.default_rng(1))
    taken = toxicity.to_train(sizes, y, aside, {1: 1000, 0: 2000})
    assert aside.sum() == 16 and not (taken & aside).any()
    assert taken[y == 1].sum() == taken[y == 0].sum() == toxicity.TRAIN_LEAST


# ---- quality rules -------------------------------------------------------------------

def test_rule_counts_and_cutoffs(spark, odd, labels):
    got = quality_rules.apply_quality_rules(odd, labels).collect()
    assert len(got) == odd.count() and all(r.base_failed and not r.kept for r in got if not (r.n_words or 0))
    assert quality_rules.apply_quality_rules(empty(odd), empty(labels)).count() == 0
    df = spark.createDataFrame([(i, " ".join(random.Random(i).choice("abc") for _ in range(random.Random(-i).randrange(12)))) for i in range(60)], "doc_id long, text string")
    for r in quality_rules.rule_statistics(df.withColumn("lang", F.lit("x"))).join(df, "doc_id").collect():
        w = r.text.split()
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        assert r.n_repeat_words == len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})
    cdf = spark.createDataFrame([(float(k), float(n)) for n in (1, 50, 2000) for k in range(0, n + 1, max(n // 20, 1))], "k double, n double")
    for r in cdf.withColumn("c", quality_rules.binomial_cdf(F.col("k"), F.col("n"), 0.1)).collect():
        k, n = int(r.k), int(r.n)
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(0.1) + (n - j) * math.log(0.9)) for j in range(k + 1))
        assert r.c == pytest.approx(exact if k < n * 0.1 else 1.0, rel=1e-8)


def test_rules_spare_good_documents_they_were_not_fitted_on(spark):
    sf = "/root/testdata/sf0.1"
    docs, own = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality_rules.apply_quality_rules(docs, own).join(own, "doc_id").filter("not base_failed").filter(crc_mod("doc_id", 2) == 1)
    good = judged.filter("quality = 1")
    assert good.filter("not kept").count() <= 0.05 * good.count()
    assert judged.filter("quality = 0 and not kept").count() >= 0.5 * judged.filter("quality = 0").count()


# ---- tokens --------------------------------------------------------------------------

def test_section_counts_against_character_offsets(odd):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    ranks = token_counts.load_ranks()
    rows = odd.filter("doc_id is not null and doc_id not in (0, 6, 7, 8)").withColumn("spans", F.expr("array(struct(5 as start, 9 as end), struct(0 as start, 3 as end), struct(9 as start, 40 as end))"))
    for rule in token_counts.RULES:
        counts = {}
        for r in token_counts.section_token_counts(rows, ranks=ranks, sections="spans", rule=rule).collect():
            counts.setdefault(r.doc_id, {})[r.section] = r.n_tokens
        for r in rows.collect():
            total = len(tok.encode(r.text or "", add_special_tokens=False).ids)
            assert sum(counts[r.doc_id].values()) == pytest.approx(total)
    plain = odd.filter("doc_id = 1").withColumn("spans", F.expr("array(struct(0 as start, 7 as end))"))
    text = plain.first().text
    want = sum(a < 7 for a, _ in tok.encode(text, add_special_tokens=False).offsets)
    assert token_counts.section_token_counts(plain, ranks=ranks, sections="spans", rule="first").filter("section = 0").first().n_tokens == want
    lines = token_counts.section_token_counts(odd, ranks=ranks)
    assert lines.filter("section < 0").count() == 0 and token_counts.section_token_counts(empty(odd), ranks=ranks).count() == 0
    joined = token_counts.joined_fields(odd.filter("doc_id = 9"), ["lang", "text", "score"])
    assert [r.n_tokens for r in token_counts.section_token_counts(joined, text_col="joined", ranks=ranks, sections="sections").filter("section = 1").collect()] == [1.0]
    with pytest.raises(ValueError):
        token_counts.section_token_counts(odd, ranks=ranks, rule="last")


def test_allocation_rules():
    left, right = np.array([0, 5, 10]), np.array([5, 8, 20])
    starts, ends = np.array([0, 3, 7, 9, 19]), np.array([3, 7, 9, 19, 22])
    assert token_counts.allocate(starts, ends, left, right, "first").tolist() == [2, 1, 1, 1]
    assert token_counts.allocate(starts, ends, left, right, "majority").tolist() == [2, 1, 1, 1]
    assert token_counts.allocate(starts, ends, left, right, "split") == pytest.approx([1.5, 1.0, 0.9 + 1 / 3, 0.5 + 0.1 + 2 / 3])


def test_sentencepiece_parity_and_round_trip(odd):
    import sentencepiece
    model = sentencepiece_ops.load_model()
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = odd.drop("ids")
    coded = sentencepiece_ops.encode(rows, model=model)
    back = sentencepiece_ops.decode(coded, model=model).collect()
    for r in back:
        assert r.ids == theirs.encode(r.text or "") and r.decoded == theirs.decode(r.ids) == (r.text or "").replace("▁", " ")
    report = sentencepiece_ops.encoding_report(odd, model=model).collect()
    assert len(report) == odd.count() and all(r.round_trip and r.parity for r in report)
    assert sentencepiece_ops.encoding_report(empty(odd), model=model).count() == 0
    assert len(parse_model(model).pieces) == theirs.get_piece_size()
    with pytest.raises(ValueError):
        parse_model(b"\x0a\xff\x01")


# ---- pages ---------------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"),
    ("<div class=ad>buy</div><div><h1>T</h1><p>Hello &amp; b&#233;</p><p>short</p></div><div id=comments><p>" + "c " * 300 + "</p></div>", "T\nHello & bé\nshort"),
    ("<body><nav><a href=x>m</a></nav><main><section><h2>A</h2><p>" + "word " * 50 + "</p></section><section><p>Be.</p></section></main><footer>f</footer>", "A\n" + "word " * 49 + "word\nBe."),
    ("<article><h1>H</h1><p><b>x  y<br><p>z</article><form>f</form><article class=comment><p>" + "r " * 99 + "</p></article>", "H\nx y\nz"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes it is</p>", "yes it is"),
    ("<div>" * 5000 + "deep text", "deep text"),
]


def test_main_text(spark, odd):
    assert [html_text.main_text(h) if h else "" for h, _ in PAGES] == [t for _, t in PAGES]
    df = spark.createDataFrame([(i, None, h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, n_chars string")
    assert [r.text for r in html_text.extract_main_text(df).orderBy("page_id").collect()] == [t for _, t in PAGES]
    assert html_text.extract_main_text(empty(df)).count() == 0


def test_articles_of_the_test_pages():
    import html
    for page, source in duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", source, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert html_text.main_text(source) == "\n".join(filter(None, blocks)), page


def test_lexicon_words_cut_no_article_text():
    long = " ".join(["word"] * 60)
    page = lambda inner: f"<body><article><h1>T</h1><p>{long}</p>{inner}<p>{long}</p></article></body>"
    kept = [('<section id="related-work"><h2>Related work</h2><p>Short text.</p><p>More text here.</p></section>', "Related work\nShort text.\nMore text here."),
            ('<h2 id="how-to-search">How to search</h2>', "How to search"), ('<p class="notice">Note this.</p>', "Note this."),
            (f'<div class="sidebar-layout"><p>{long}</p><p>{long} {long}</p></div>', f"{long}\n{long} {long}"),
            ('<p data-id="ad" title="x id=ad">Data.</p>', "Data."), ("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> then.</p>", "If x=2 then."),
            ('<div class="elementor-widget elementor-widget-text"><p>Plain.</p></div>', "Plain.")]
    for inner, want in kept:
        assert html_text.main_text(page(inner)) == f"T\n{long}\n{want}\n{long}", inner
    kept += [('<pre><code>x = 1 <span class="hljs-comment"># one</span></code></pre>', "x = 1 # one"), ('<pre><span class="token comment">// c</span> f()</pre>', "// c f()"),
             ('<p class="comment">An aside.</p>', "An aside."), ('<p>The <span class="reply">answer</span> came.</p>', "The answer came."),
             ('<div class="share-prices"><p>Up.</p></div>', "Up."), ('<div role="alert"><p>Mind it.</p></div>', "Mind it."),
             ("<p>Press <button>OK</button> or <label>Cancel</label>.</p>", "Press OK or Cancel."), ("<noscript><p>Plain.</p></noscript>", "Plain.")]
    for inner, want in kept:
        assert html_text.main_text(page(inner)) == f"T\n{long}\n{want}\n{long}", inner
    for shell in ('<div class="post"><h2>Title</h2><div class="meta">by A</div><div class="body"><p>{0}</p><p>{0}</p></div></div>',
                  '<div><div><h1>Title</h1></div><div class="meta">by A</div><div><p>{0}</p><p>{0}</p></div></div>'):
        assert html_text.main_text(f"<body><nav><h2>Menu</h2></nav>{shell.format(long)}</body>").startswith("Title\n")
    for inner in ('<div class="ad">Buy now.</div>', '<p class="ad">Buy now.</p>', '<div class="related"><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>',
                  f'<div id="comments"><p>{long}</p></div>'):
        assert html_text.main_text(page(inner)) == f"T\n{long}\n{long}", inner
    assert html_text.main_text(f'<body><h1 class="page-header">Title</h1><div><p>{long}</p><h2 id="search">S</h2><p>{long}</p></div></body>').endswith(f"{long}\nS\n{long}")
    assert "Title" in html_text.main_text(f'<body><div><h1 class="page-header">Title</h1><p>{long}</p></div></body>')
    built = "".join(f'<div class="elementor-element elementor-widget"><p>{long}</p></div>' for _ in range(3))
    assert html_text.main_text(f"<body><div class=ad>buy</div><div>{built}</div></body>") == "\n".join([long] * 3)


def test_long_and_repeated_pages(spark):
    long = "".join(f"<p>Sentence {i} of the text, as long as others are.</p>" for i in range(20_000))
    source = f"<body><nav><a href=x>m</a></nav><article>{long}</article><footer>f</footer></body>"
    df = spark.createDataFrame([(1, source), (1, source), (2, None)], "page_id long, html string")
    texts = [r.text for r in html_text.extract_main_text(df).orderBy("page_id").collect()]
    assert texts[0] == texts[1] and texts[0].count("\n") == 19_999 and texts[0].endswith("Sentence 19999 of the text, as long as others are.") and texts[2] == ""
    with pytest.raises(ValueError):
        html_text.extract_main_text(df.withColumn("TEXT", F.lit(1)))


# ---- pipeline and registry -----------------------------------------------------------

def test_stages_on_odd_and_empty_tables(spark, odd, labels, tmp_dir):
    import corpus_pipeline
    labels.write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([(1, words(2, 40, 5000)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        docs = odd.drop("ids") if name == "sentencepiece" else odd
        out = stage(spark, docs, tmp_dir)
        assert out.columns == docs.columns + ["ids"] * (name == "sentencepiece") and out.count() <= odd.count()
        assert stage(spark, empty(docs), tmp_dir).count() == 0


@pytest.mark.parametrize("name", sorted(__import__("lakeloom.llm.registry").llm.registry.llm_oracles()))
def test_queries_against_their_oracles(spark, name):
    from lakeloom.llm.registry import llm_queries
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).to_arrow_table()
    columns = sorted(want.column_names)
    rows = sorted(map(str, ([r[c] for c in columns] for r in want.to_pylist())))
    got = llm_queries()[name](spark, SF)
    assert sorted(got.columns) == columns and sorted(str([r[c] for c in columns]) for r in got.collect()) == rows
    assert query
