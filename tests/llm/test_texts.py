"""Classifier, rules, repeated strings, token counts, near duplicates and the pipeline."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from eventflow.llm import order_minhash, quality_model, quality_rules, suffix_dedup, suffix_sort, token_counts
from eventflow.llm.queries import QUERIES
from eventflow.session import pin


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def want_removed(texts):
    out = {}
    for key, gone in brute.repeats({k: (t or "").encode() for k, t in texts.items()}).items():
        body = (texts[key] or "").encode()
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def removed(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_repeats(spark, sf_dir, docs):
    assert removed(QUERIES["op5_suffix_dedup"](spark, sf_dir)) == want_removed(docs)


def test_repeats_with_crowded_anchors(spark, monkeypatch):
    """A line in every text between different ones, copies, and a text that repeats itself."""
    rng = random.Random(5)
    line = "".join(rng.choices("abcdefgh ", k=90))

    def noise(n):
        return "".join(rng.choices("abcdefgh ", k=n))

    texts = {i: noise(rng.randint(0, 60)) + line + noise(rng.randint(0, 60)) for i in range(60)}
    texts |= {100 + i: texts[i][5:] + "é" for i in range(20)}
    texts |= {200: "x" * 700, 201: "ab" * 300, 202: "", 203: None}
    monkeypatch.setattr(suffix_dedup, "MOST", 3)
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    assert removed(suffix_dedup.remove_repeats(table)) == want_removed(texts)


def test_repeats_of_odd_rows(odd, odd_rows, none):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd_rows)
    tail = next(r for r in got if r.doc_id == 5)
    assert tail.n_bytes - tail.n_removed < 6
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffixes_are_sorted_by_their_bytes_alone():
    """No hashes are asked on the way; equal suffixes keep their order, and a shorter one comes first."""
    data = np.frombuffer(b"ab\x00ab\x00\x00\xffab", np.uint8)
    at, size = np.array([3, 0, 0, 7, 2, 8]), np.array([2, 2, 3, 3, 1, 2])
    order, shared = suffix_sort.sorted_suffixes(SimpleNamespace(bytes=data), at, size)
    assert order.tolist() == [4, 0, 1, 5, 2, 3]
    assert shared.tolist() == [0, 0, 2, 2, 2, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30), min_size=1, max_size=30))
def test_suffix_order(bodies):
    buffer = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(b) for b in bodies])
    at = np.cumsum(size) - size
    order, shared = suffix_sort.sorted_suffixes(suffix_sort.Hashed(buffer), at, size)
    got = [bodies[i] for i in order]
    assert got == sorted(bodies)
    for a, b, n in zip(got, got[1:], shared[1:]):
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_rules(spark, sf_dir, docs):
    got = QUERIES["op4_gram_ratio_rules"](spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        n, *_, repeats = want = brute.base_rules(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert r.kept == (not r.base_failed and r.score >= quality_rules.MIN_SCORE)


def test_rules_of_odd_rows(odd, odd_rows, none):
    ratios = quality_rules.log_ratios(odd, F.col("doc_id") == 4)
    got = quality_rules.judge(odd, ratios).collect()
    want = Counter((r.doc_id, *brute.base_rules(r.text)) for r in odd_rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert quality_rules.judge(none, quality_rules.log_ratios(none, F.lit(True))).count() == 0


def test_scores_against_counted_grams(spark):
    """Ratios and scores from a count of the n-grams themselves, on texts with few of them."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("aa Bb cc dd ee ff gg".split(), k=rng.randint(0, 70))) for _ in range(60)] + [None]
    rows = [(i, t, "x", -1.0) for i, t in enumerate(texts)] * 2
    table = spark.createDataFrame(rows, "doc_id bigint, text string, words string, score double")
    good = {i for i in range(0, 60, 3)}

    def grams(text):
        low = (text or "").lower().split()
        return [*low, *zip(low, low[1:], strict=False)]

    n, g = Counter(), Counter()
    for i, text, *_ in rows:
        n.update(grams(text))
        g.update(grams(text) if i in good else [])
    share = sum(g.values()) / sum(n.values())
    prior = quality_rules.PRIOR
    ratio = {x: np.log((g[x] + prior) / (n[x] * share + prior)) for x in n}
    got = quality_rules.judge(table, quality_rules.log_ratios(table, F.col("doc_id") % 3 == 0), -0.01).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [ratio[x] for x in grams(texts[r.doc_id])]
        assert (r.score is None) if not mine else r.score == pytest.approx(sum(mine) / len(mine), abs=6e-4)
        assert r.kept == (not r.base_failed and r.score >= -0.01)


def test_a_filter_on_the_verdict_ends(odd):
    judged = quality_rules.judge(odd, quality_rules.log_ratios(odd, F.col("doc_id") == 4))
    assert judged.where("kept").count() == sum(r.kept for r in judged.collect())


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_rules_reject_bad_rows_at_any_size(spark, folder):
    folder = f"/root/testdata/{folder}"
    flags = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    judged = QUERIES["op4_gram_ratio_rules"](spark, folder).where("not base_failed").join(flags, "doc_id")
    shares = judged.agg(
        F.avg(F.when((F.col("q") == 0) & (F.col("t") == 0), F.col("kept").cast("int"))).alias("bad"),
        F.avg(F.when((F.col("q") == 1) & (F.col("t") == 0), F.col("kept").cast("int"))).alias("good"),
    ).first()
    assert shares.bad <= 0.1
    assert shares.good >= 0.97


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    rows = pin(quality_model.rated(table, spark.read.parquet(f"{folder}/labels.parquet")))
    model = quality_model.train(rows.where("doc_id % 4 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    got = quality_model.grade(rows.where("doc_id % 4 = 0"), model).collect()
    right = sum((r.tail_probability >= 0.3) == (r.grade == 2) for r in got)
    assert right / len(got) > 0.85
    assert all(0 <= r.expected_grade <= 2 for r in got)


def test_classifier_of_odd_rows(odd, odd_rows, none):
    model = quality_model.train(odd.withColumn("grade", F.col("doc_id") % 3))
    assert len(quality_model.grade(odd, model).collect()) == len(odd_rows)
    blank = quality_model.train(none.withColumn("grade", F.lit(1)))
    assert quality_model.grade(none, blank).count() == 0


def test_token_counts(spark, sf_dir, docs):
    scores = token_counts.load_scores(public_tokenizers.path("piece_bpe_32k.model"))
    trie = token_counts.Trie(scores)

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode())
            found = (best[-1][0] + size * trie.byte_score, -best[-1][1] - size)
            for start in range(end):
                if word[start:end] in scores:
                    found = max(found, (best[start][0] + scores[word[start:end]], -best[start][1] - 1))
            best.append((found[0], -found[1]))
        return best[-1][1]

    got = QUERIES["op6_trie_token_counts"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got[:40]:
        words = brute.WORD.findall(docs[r.doc_id] or "")
        assert (r.n_words, r.n_tokens) == (len(words), sum(plain("▁" + w) for w in words))


def test_token_counts_of_odd_rows(odd, odd_rows, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = Counter((r.doc_id, r.n_words) for r in token_counts.count_tokens(odd, path).collect())
    assert got == Counter((r.doc_id, len(brute.WORD.findall(r.text or ""))) for r in odd_rows)
    assert token_counts.count_tokens(none, path).count() == 0


def ordered_classes(texts):
    """Components of all pairs whose five-word runs align to 0.8."""
    runs = {}
    for k, t in texts.items():
        w = brute.WORD.findall(t or "")
        runs[k] = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = runs[a], runs[b]
        common = sum((Counter(x) & Counter(y)).values())
        if len(x) + len(y) and common < 0.8 * (len(x) + len(y) - common):
            continue
        row = [0] * (len(y) + 1)
        for p in x:
            last = 0
            for j, q in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if p == q else max(row[j], row[j - 1])
        if not x and not y or row[-1] >= 0.8 * (len(x) + len(y) - row[-1]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(set)
    for k in texts:
        groups[find(k)].add(k)
    return groups


def test_near_duplicates(spark, sf_dir, docs):
    got = QUERIES["op9_order_minhash"](spark, sf_dir).collect()
    groups = ordered_classes(docs)
    assert {r.doc_id: r.class_id for r in got} == {k: min(g) for g in groups.values() for k in g}
    assert sum(r.kept for r in got) == len(groups)


def test_near_duplicates_of_one_text(spark):
    """Many texts, each near the one they were made from and not near each other."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(300)]
    texts = {0: " ".join(base)}
    for i in range(1, 120):
        words = list(base)
        for at in rng.sample(range(300), 5):
            words[at] = f"x{rng.randint(0, 9999)}"
        texts[i] = " ".join(words)
    texts |= {500: " ".join(base[::-1]), 501: "a b", 502: "a b", 503: "", 504: None}
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(table).collect()}
    assert got == {k: min(g) for g in ordered_classes(texts).values() for k in g}


def star(rng, n, name):
    """A text and ``n`` variants, each near it and none near another."""
    base = [f"{name}{rng.randint(0, 9999)}" for _ in range(300)]
    out = [" ".join(base)]
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(300), 5):
            words[at] = f"x{rng.randint(0, 99999)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_that_heads_miss(spark):
    """Stars whose middle is not the most popular, chains, and pairs in a passage that many texts have."""
    rng = random.Random(11)
    texts = [t for i in range(2) for t in star(rng, 90, f"s{i}_")]
    for i in range(1):  # each text near the next one only
        words = [f"c{i}_{rng.randint(0, 9999)}" for _ in range(200)]
        for at in range(0, 60, 4):
            texts.append(" ".join(words))
            words[at : at + 4] = [f"y{rng.randint(0, 99999)}" for _ in range(4)]
            words[(at * 7) % 200] = f"z{rng.randint(0, 99999)}"
    passage = [f"p{i}" for i in range(150)]
    for i in range(30):
        words = [f"q{rng.randint(0, 99999)}" for _ in range(100)]
        texts.append(" ".join(passage + words))
        if i % 3 == 0:
            texts.append(" ".join([*passage, *words[:50], "other", *words[51:]]))
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(table).collect()}
    want = {k: min(g) for g in ordered_classes(texts).values() for k in g}
    assert sum(got[k] != want[k] for k in want) == 0


def test_sketch_of_a_repeat():
    """A k-mer that comes twice changes what the second one counts as, not the others."""
    runs = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    twice = np.concatenate([runs, runs[:1]])
    assert (order_minhash.sketch(runs) == order_minhash.sketch(twice)).sum() >= 9


def test_near_duplicates_of_odd_rows(odd, odd_rows, none):
    got = order_minhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    of = {r.doc_id: r.class_id for r in got}
    assert of[4] == of[5] and of[3] == of[10] == of[2]
    assert order_minhash.near_duplicates(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40))
def test_alignment(a, b):
    row = [0] * (len(b) + 1)
    for p in a:
        last = 0
        for j, q in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if p == q else max(row[j], row[j - 1])
    assert order_minhash.matched(a, b, 80) == row[-1]
    before, order_minhash.BLOCK_BITS = order_minhash.BLOCK_BITS, 7
    try:
        assert order_minhash.matched(a, b, 80) == row[-1]
    finally:
        order_minhash.BLOCK_BITS = before


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = pin(stage(spark, docs, sf_dir))
        if name != names[-1]:
            assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0


def test_pipeline_stages_on_odd_rows(spark, sf_dir, odd, none):
    for name, stage in corpus_pipeline.STAGES[1:]:
        for table in (odd, none):
            out = stage(spark, table, sf_dir)
            assert out.count() <= 40 or name == "best_fit_packing"  # which cuts the long texts
            if name in ("exact_dedup", "near_dedup"):
                assert out.columns == table.columns
    clashing = odd.withColumns({n: F.lit(-1.0) for n in ("score", "tail_probability", "_number", "_row", "grade", "q")})
    for table in (clashing, none):
        out = corpus_pipeline.quality_classifier(spark, table, sf_dir)
        assert out.columns == table.columns
        rows = out.collect()
        assert all(r.score == r.tail_probability == r._number == -1.0 for r in rows if table is clashing)
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup, corpus_pipeline.source_mix):
        assert all(r._row == r.q == -1.0 for r in stage(spark, clashing, sf_dir).collect())
    kept = corpus_pipeline.exact_dedup(spark, odd, sf_dir).collect()
    assert sum(r.text == "same row" for r in kept) == 1
