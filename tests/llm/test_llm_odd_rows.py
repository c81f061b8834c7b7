"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loyaltide.llm import (
    bpe,
    graph,
    jaccard_join,
    language_id,
    lm_scoring,
    mixing,
    quality_mil,
    quality_rules,
    sharding,
    topk,
    toxicity,
)
from loyaltide.llm.common import draw, tokenizer_path
from tests.llm import brute
from tests.llm.conftest import ODD

def every():
    return F.lit(True)


IDS = Counter(r[0] for r in ODD)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 0, 1), (2, 0, 0), (4, 1, 0), (6, 1, 1), (6, 1, 1), (7, None, None), (None, 1, 1),
         (8, 1, 0), (9, 0, 1)], "doc_id bigint, quality int, toxic int")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


# -- scores ------------------------------------------------------------------------------------------

def test_quality_scores(odd, none, labels):
    network = quality_mil.train(odd, labels, every())
    got = quality_mil.score(odd, network).collect()
    assert Counter(r.doc_id for r in got) == IDS and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1
    assert quality_mil.score(none, network).count() == 0
    assert set(quality_mil.keep_good(odd, network).columns) == set(odd.columns)
    prior = quality_mil.train(odd, labels.filter("false"), every())
    assert {r.score for r in quality_mil.score(odd, prior).collect()} == {0.5}


def test_attention_gradients():
    """Analytic gradients of the network agree with differences."""
    r = np.random.default_rng(0)
    net = quality_mil.Network()
    bags = [r.standard_normal((n, quality_mil.FEATURES)).astype(np.float32) for n in (1, 3, 5)]
    y = np.array([0.0, 1.0, 1.0], np.float32)
    net.fit(bags, y)
    net.weights = {k: np.asarray(v, np.float64) for k, v in net.weights.items()}
    x = np.concatenate(bags).astype(np.float64)
    starts = np.array([0, 1, 4])

    def loss():
        s = net.forward(x, starts)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grads = net.gradients(x, starts, y)
    for name, at in (("W", (3, 2)), ("V", (1, 4)), ("U", (5, 0)), ("a", (2,)), ("c", (7,))):
        w, keep = net.weights[name], net.weights[name][at]
        w[at] = keep + 1e-5
        up = loss()
        w[at] = keep - 1e-5
        down = loss()
        w[at] = keep
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_language_model_scores(odd, none):
    model = lm_scoring.train(odd, every())
    got = lm_scoring.score(odd, model).collect()
    want = brute.unigram([r[:2] for r in ODD], lambda d: False)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9))
                  for r in got) == sorted((d or -1, *w[:3], round(w[3], 9))
                                          for (d, *_), w in zip(ODD, want, strict=True))
    assert all(np.isfinite(r.score) for r in got)
    assert lm_scoring.score(none, model).count() == 0
    empty = lm_scoring.train(none, every())
    assert all(r.n_known == 0 and np.isfinite(r.score) and r.train_tokens == 0
               for r in lm_scoring.score(odd, empty).collect())


def test_rare_words_meet_their_counts_in_the_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole, short = (lm_scoring.score(docs, lm_scoring.train(docs, every(), lookup=k)).orderBy("doc_id")
                    .toPandas() for k in (200_000, 500))
    assert (whole.n_known == short.n_known).all()
    assert np.allclose(whole.base_score, short.base_score)
    assert np.allclose(whole.score, short.score, rtol=1e-6)


def test_probabilities_add_up(spark, sf_dir):
    """Over all symbols, and over all words of a bucket with one share for unseen ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    model = lm_scoring.train(docs, every())
    k = model.vocabulary.symbols
    symbols, ends = np.arange(k), np.full(k, 1).cumsum()
    for before in (0, 5, k - 1):
        texts = np.stack([np.full(k, before), symbols], axis=1).ravel()
        logs = model.network.log10(texts, np.arange(2, 2 * k + 1, 2), model.network.no_norms())[1::2]
        assert (10 ** logs).sum() == pytest.approx(1.0, rel=1e-4)
    own = set(model.vocabulary.hashes[:lm_scoring.WORDS].tolist())
    tail = [r for r in model.counts.collect() if r.word not in own]
    per = Counter()
    for r in tail:
        per[r.bucket] += r.n + 1
    v = model.vocabulary
    for b in range(lm_scoring.BUCKETS):
        assert per[b] == v.bucket_tokens[b] + v.bucket_words[b]


def test_languages(odd, none):
    model = language_id.train(odd, every())
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got
    assert {p for d, p in got if d not in (1, 2, 3)} <= {"en", "de"}
    assert ids(language_id.predict(odd, model)) == IDS
    assert language_id.predict(none, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(
        odd, language_id.train(none, every())).collect()} == {"und"}
    assert not {1, 2, 3} & set(ids(language_id.keep_known(odd, model)))


def test_every_language_is_learnt(make):
    """More languages than the limit of 256 there was."""
    def text(k, i):
        return " ".join(chr(0x4E00 + 40 * k + (7 * i + j) % 40) * 2 for j in range(30))

    rows = [(1000 * k + i, text(k, i), f"l{k:03d}", "a") for k in range(260)
            for i in range(3)]
    docs = make(rows)
    model = language_id.train(docs, every())
    assert model.languages == sorted({r[2] for r in rows})
    assert np.count_nonzero(model.weights, axis=1).min() > 0
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert sum(got[d] == la for d, _, la, _ in rows) >= 0.95 * len(rows)


def test_ftrl_is_sparse_and_separates():
    rows = [(np.array([i % 2, 2 + i % 7]), np.array([3, 1]), i % 2) for i in range(200)]
    model = language_id.Model(["x", "y"], np.ones(language_id.BUCKETS),
                              np.zeros((2, language_id.BUCKETS)), np.zeros(2))
    language_id.fit_ftrl(model, rows)
    assert np.count_nonzero(model.weights) <= 18
    assert all(model.logits(a, n).argmax() == y for a, n, y in rows)
    wrong = [(a, n, 1 - y if i % 10 == 0 else y) for i, (a, n, y) in enumerate(rows)]
    sure = language_id.calibrate(model, rows)
    assert language_id.calibrate(model, wrong) > sure


def test_toxicity(odd, none, labels):
    chain = toxicity.train(odd, labels, every())
    got = toxicity.score(odd, chain)
    assert ids(got) == IDS and got.columns == ["doc_id", "toxic_junk", "toxic_prose", "toxic"]
    assert all(0 <= r.toxic <= 1 for r in got.collect())
    assert toxicity.score(none, chain).count() == 0
    assert {r.toxic for r in toxicity.score(
        odd, toxicity.train(odd, labels.filter("false"), every())).collect()} == {0.0}


def test_chain_uses_out_of_fold_predictions():
    """The second category is the first one's complement of a word the models do not see."""
    r = np.random.default_rng(1)
    x = (r.random((400, 6)) < 0.5).astype(np.float32)
    first = x[:, 0] > 0
    marks = np.stack([first, first & (x[:, 1] > 0)], axis=1)
    chain = toxicity.Chain(["a", "b"])
    chain.fit(x, marks, np.arange(400) % toxicity.FOLDS)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    p = chain.probabilities(x)
    assert ((p > 0.5) == marks).mean() > 0.97


# -- search ------------------------------------------------------------------------------------------

def plain_search(rows, k):
    whole = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in whole:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, a in asked.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i)
                        for i, b in whole if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_search(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(12).round(2).tolist()) for i in range(350)]
    rows += [(i, rows[7][1]) for i in range(400, 440)]                # ties
    rows += [(13, rows[13][1]), (100, rows[100][1])]                  # repeated rows
    rows += [(500, None), (501, [float("nan")] * 12), (502, [None] * 12), (None, rows[0][1]),
             (503, []), (504, [9.0]), (600, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn(
        "score", F.lit("x"))
    for block, queries in ((4096, 4096), (50, 2)):
        got = topk.top_k(df, df.filter("vec_id % 100 = 0"), 10, candidate_block=block,
                         query_block=queries)
        assert sorted(map(tuple, got.collect())) == plain_search(rows, 10)
    assert topk.top_k(df.filter("false"), df.filter("false")).count() == 0
    few = df.filter("vec_id IN (100, 101, 102)")
    assert [x.vec_id for x in topk.top_k(few, few.filter("vec_id = 100")).collect()] != []


def test_search_prunes_exactly_and_beyond_doubles():
    r = np.random.default_rng(3)
    points = np.floor(1024 * r.standard_normal((700, 64)) / 8)
    ids_ = np.arange(700)
    got = topk.search_block(points[:9], ids_[:9], points, ids_, 10)
    want = []
    for q in range(9):
        s = sorted((-int(points[q] @ points[i]), i) for i in range(700) if i != q)[:10]
        want += [(q, i, -v) for v, i in s]
    assert got == want
    huge = np.floor(points[:30] * 2.0 ** 40)
    got = topk.search_block(huge[:2], ids_[:2], huge, ids_[:30], 3)
    assert len(got) == 6 and all(abs(s) <= 2 ** 63 - 1 for *_, s in got)


# -- near duplicates ---------------------------------------------------------------------------------

def test_join_odd_rows(odd, none):
    got = [tuple(r) for r in jaccard_join.jaccard_components(odd).collect()]
    want = brute.jaccard_components([r[:2] for r in ODD], 4, 85)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert jaccard_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_join_equals_brute_force(make, percent):
    """Edits of a few texts of many lengths: similarities on both sides of every bound."""
    r = np.random.default_rng(percent)
    rows, i = [], 0
    for length in (1, 2, 3, 4, 5, 6, 7, 9, 12, 17, 25, 40, 80, 160, 300):
        text = [f"w{x}" for x in r.integers(0, 400, length)]
        for edits in (0, 0, 1, 1, 1, 2, 2, 3, 4, 6, 9):
            t = list(text)
            for _ in range(edits):
                t[r.integers(len(t))] = f"n{r.integers(1000)}"
            rows.append((i, " ".join(t[:max(1, len(t) - int(r.integers(3)))]), "en", "a"))
            i += 1
    got = [tuple(x) for x in jaccard_join.jaccard_components(make(rows), 4, percent).collect()]
    assert sorted(got) == sorted(brute.jaccard_components([x[:2] for x in rows], 4, percent))


def test_join_blocks_and_large_groups(make, monkeypatch):
    """A group of near copies over several verification blocks, and one of exact copies."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    r = np.random.default_rng(5)
    text = [f"w{x}" for x in range(120)]
    rows = []
    for i in range(70):
        t = list(text)
        for at in r.integers(0, 120, 3):
            t[at] = f"n{r.integers(10 ** 6)}"
        rows.append((i, " ".join(t), "en", "a"))
    rows += [(100 + i, " ".join(text), "en", "b") for i in range(40)]
    got = [tuple(x) for x in jaccard_join.jaccard_components(make(rows)).collect()]
    assert sorted(got) == sorted(brute.jaccard_components([x[:2] for x in rows], 4, 85))


def test_lanes_bound_the_symmetric_difference():
    r = np.random.default_rng(6)
    for n in (6, 40, 300):
        a = np.unique(r.integers(0, 2 ** 63, n).astype(np.uint64))
        d = jaccard_join.most_different(len(a), 85)
        b = np.unique(np.concatenate([a[d // 2:], r.integers(0, 2 ** 63, d // 2).astype(np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            assert np.intersect1d(jaccard_join.lanes(a, 85), jaccard_join.lanes(b, 85)).size


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(
        spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_bitmap_keeps_what_is_wanted(spark):
    df, wanted = spark.range(5000).toDF("k"), spark.range(0, 5000, 50).toDF("w")
    got = {r.k for r in graph.keep_marked(df, "k", wanted, "w", 12).collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 1000


def test_keep_one(odd):
    got = jaccard_join.keep_one(odd)
    assert set(got.columns) == set(odd.columns)
    assert ids(got) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 7: 1, 8: 1, None: 1})


# -- mixing, sharding, rules, encoding ----------------------------------------------------------------

def test_mix(odd, none):
    got = mixing.mix_report(odd).collect()
    assert Counter(r.doc_id for r in got) == IDS
    sizes = Counter()
    for _, text, _, source in ODD:
        sizes[source] += len(brute.words(text))
    targets = brute.mix_targets(sizes)
    assert all(r.target == pytest.approx(float(targets[r.source])) and r.taken <= 2 * r.size
               for r in got)
    assert mixing.mix_report(none).count() == 0


def test_mix_meets_targets_through_the_tree(make, monkeypatch):
    """Many blocks and several levels; shares stay right on average."""
    monkeypatch.setattr(mixing, "FAN", 4)
    r = np.random.default_rng(8)
    rows = [(i, "w " * int(r.integers(1, 60)), "en", "abc"[min(2, i % 5)]) for i in range(600)]
    docs = make(rows)
    got = mixing.mix_report(docs).toPandas()
    for _, part in got.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 60
    copies = [mixing.mix_report(docs, seed=s).toPandas().set_index("doc_id")["copies"]
              for s in range(3)]
    assert not copies[0].equals(copies[1]) and not copies[1].equals(copies[2])


def test_apply_mix(odd):
    decisions = mixing.mix(odd)
    got = mixing.apply_mix(odd, decisions)
    want = decisions.select(F.sum(F.col("m") * F.col("copies") + F.col("more"))).first()[0]
    assert got.count() == want and got.columns == odd.columns


@pytest.mark.parametrize("seed", [11, 12, 13, 14])
def test_mix_divides_equal_rows(make, seed):
    """Half of a source's rows are one row: its words come as near the target as any other's."""
    rows = [(i, "w " * (5 + i % 7), "en", "a") for i in range(600)]
    rows += [(9, "w " * 7, "en", "a")] * 600
    rows += [(2000 + i, "w " * (3 + i % 5), "en", "bc"[i % 2]) for i in range(300)]
    docs = make(rows)
    got = mixing.mix_report(docs, seed=seed).toPandas()
    assert len(got) == len(rows)
    for _, part in got.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 11
    repeated = got[got.doc_id == 9]["copies"]
    assert repeated.max() - repeated.min() <= 1
    mixed = mixing.apply_mix(docs, mixing.mix(docs, seed=seed)).groupBy("doc_id").count()
    want = got.groupby("doc_id")["copies"].sum()
    assert {r.doc_id: r["count"] for r in mixed.collect()} == want[want > 0].to_dict()


def test_mix_with_clashing_names(make):
    rows = [(i // 4, "w " * 5, None, "a") for i in range(40)] + [(99, "x y", None, "b")]
    docs = make(rows).withColumnsRenamed({"size": "_size", "score": "_copies", "n_chars": "_key0"})
    got = mixing.apply_mix(docs, mixing.mix(docs))
    assert got.columns == docs.columns
    report = mixing.mix_report(docs).agg(F.sum("copies")).first()[0]
    assert got.count() == report and got.filter("_size <> 7 OR _copies <> 'x'").isEmpty()


def test_shards(odd, none):
    got = sharding.shard(odd, 5).collect()
    assert Counter(r.doc_id for r in got) == IDS
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert sharding.shard(none, 5).count() == 0


def test_shards_are_even_and_keep_groups(make):
    """A third of the rows share one text; other groups stay whole."""
    r = np.random.default_rng(9)
    rows = [(i, "x" * int(r.integers(20, 400)), "en", f"s{i % 7}") for i in range(1200)]
    rows += [(5000 + i, "y" * 200, "en", f"s{i % 3}") for i in range(600)]
    rows += [(9000 + i, f"{i // 3} " * 20, "en", "s1") for i in range(90)]
    got = sharding.shard(make(rows), 24).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 24 and size.max() <= 1.06 * size.mean() and size.min() >= 0.94 * size.mean()
    small = got[got.doc_id >= 9000]
    assert (small.groupby(small.doc_id // 3)["shard"].nunique() == 1).all()


def test_rules(odd, none):
    got = quality_rules.apply_rules(odd).collect()
    assert Counter(r.doc_id for r in got) == IDS
    for d, text, *_ in ODD:
        r = next(x for x in got if x.doc_id == d)
        assert tuple(r)[1:6] == brute.rule_counts(text)
    assert quality_rules.apply_rules(none).count() == 0


def test_sketch_quantiles(spark):
    df = spark.range(1, 20001).select((F.col("id") / 100).alias("v"), F.lit("g").alias("g"))
    s = quality_rules.sketch(df, ["v"], ["g"])
    q = quality_rules.quantiles(s, ["g"], {"q1": 0.25, "q3": 0.75}).first()
    assert q.q1 == pytest.approx(50, rel=0.011) and q.q3 == pytest.approx(150, rel=0.011)
    halves = [quality_rules.sketch(df.filter(f), ["v"], ["g"]) for f in ("v < 70", "v >= 70")]
    merged = quality_rules.merge(halves[0].unionByName(halves[1]), ["g"])
    assert quality_rules.quantiles(merged, ["g"], {"q1": 0.25, "q3": 0.75}).first() == q


def test_repeats_are_judged_by_their_group(make):
    """A fifth of repeated words is odd where nothing repeats, usual where many documents do."""
    r = np.random.default_rng(3)

    def text(repeated):
        w = [f"w{x}" for x in r.permutation(100_000)[:200 - repeated]]
        return " ".join(w + w[:repeated])

    rows = [(i, text(0), "en", "clean") for i in range(1200)]
    rows += [(i, text(0 if i % 10 else 10 + i % 15), "en", "usual") for i in range(2000, 3200)]
    rows += [(5000, text(20), "en", "clean"), (5001, text(20), "en", "usual")]
    got = {x.doc_id: x for x in quality_rules.apply_rules(make(rows)).collect()}
    for d in (5000, 5001):
        assert (got[d].n_words, got[d].n_repeat_words, got[d].base_failed) == (200, 40, False)
    assert not got[5000].kept and got[5001].kept
    assert all(x.kept for d, x in got.items() if d < 5000)


def test_two_groups_give_one_document_different_verdicts(spark, make, tmp_path):
    """The same document in a clean group and in one where such rates are usual, and SQL agrees."""
    from catalog.compare import compare, connect
    r = np.random.default_rng(6)

    def text(repeated, symbols=0):
        w = [f"w{x}" for x in r.permutation(100_000)[:200 - repeated]] + ["###"] * symbols
        return " ".join(w + w[:repeated])

    rows = [(i, text(0), "en", "clean") for i in range(300)]
    rows += [(i, text(0 if i % 4 else 25, i % 3), "en", "usual") for i in range(1000, 1300)]
    rows += [(i, text(0), lang, source) for i, (lang, source) in enumerate(
        [("de", None), (None, "clean"), (None, None)] * 5, 2000)]
    odd_one = text(23)
    rows += [(5000, odd_one, "en", "clean"), (5001, odd_one, "en", "usual")]
    docs = make(rows)
    docs.coalesce(1).write.parquet(f"{tmp_path}/part")
    spark.read.parquet(f"{tmp_path}/part").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.kept for x in quality_rules.apply_rules(docs).collect()}
    assert not got[5000] and got[5001]
    assert compare(spark, connect(str(tmp_path)), lambda s, d: quality_rules.apply_rules(
        s.read.parquet(f"{d}/documents.parquet")), quality_rules.SQL, str(tmp_path)).startswith("ok")


def test_quantiles_of_the_part_that_is_not_zero(spark):
    df = spark.range(0, 1000).select(F.when(F.col("id") < 100, F.col("id") + 1.0).otherwise(0.0)
                                     .alias("v"), F.lit("g").alias("g"))
    s = quality_rules.sketch(df, ["v"], ["g"])
    q = quality_rules.quantiles(s, ["g"], {"q3": 0.75}, {"t1": 0.25, "t3": 0.75}).first()
    assert (q.n, q.n_tail, q.q3) == (1000, 100, 0.0)
    assert q.t1 == pytest.approx(25, rel=0.06) and q.t3 == pytest.approx(75, rel=0.03)


def test_repeated_windows(make):
    r = np.random.default_rng(10)
    rows = []
    for i in range(60):
        w = [str(x) for x in r.integers(0, 3, int(r.integers(0, 60)))]
        rows.append((i, " ".join(w) + "\n" + " ".join(w[:20]), "en", "a"))
    got = {x.doc_id: x for x in quality_rules.measure(make(rows)).collect()}
    assert all((got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines,
                got[d].n_repeat_words) == brute.rule_counts(t) for d, t, *_ in rows)


def test_encoding_round_trip(odd, none):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path())
    coded = bpe.encode(odd, tokenizer_path())
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in coded.collect())
    want = Counter()
    for d, text, *_ in ODD:
        x = library.encode(text or "", add_special_tokens=False).ids
        want[(d, np.array(x, "<u4").tobytes(), library.decode(x, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.encode_report(none, tokenizer_path()).count() == 0


def test_trie_equals_the_library_on_random_texts():
    import random
    from tokenizers import Tokenizer
    library, own = Tokenizer.from_file(tokenizer_path()), bpe.Tokenizer(tokenizer_path())
    random.seed(4)
    pool = "abcdefghij \n\t'stremlldv0123<|>endoftext!?éèßΣσİıǺ  😀漢字ẞ՘ﬀ𐐀"
    texts = ["".join(random.choices(pool, k=random.randint(0, 60))) for _ in range(3000)]
    texts += ["x<|endoftext|>y <|startoftext|>", "Σίσυφος ΟΔΥΣΣΕΥΣ", "a" * 5000]
    coded = own.encode(texts, {})
    for text, code in zip(texts, coded, strict=True):
        assert np.frombuffer(code, "<u4").tolist() == library.encode(
            text, add_special_tokens=False).ids, repr(text)


# -- pipeline ----------------------------------------------------------------------------------------

def test_stages_on_odd_rows(spark, odd, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, odd, str(tmp_path))
        assert set(kept.columns) == set(odd.columns), name
        if name != "mixing sources to target weights":
            assert not ids(kept) - IDS, name
        assert step(spark, none, str(tmp_path)).count() == 0, name
    assert ids(corpus_pipeline.encode(spark, odd, str(tmp_path))) == IDS
    assert corpus_pipeline.encode(spark, none, str(tmp_path)).count() == 0


def test_pipeline_equals_stages(spark, sf_dir):
    """Each stage against a plain version or its own operator's full result, then the whole run."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = corpus_pipeline.quality(spark, docs, sf_dir).cache()
    kept = set(ids(good))
    assert sum((q == 1) == (d in kept) for d, q in marks.items()) >= 0.95 * len(marks)
    told = corpus_pipeline.language(spark, good, sf_dir).cache()
    assert told.count() >= 0.98 * good.count()
    one = corpus_pipeline.near_duplicates(spark, told, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in told.collect()]
    want = {c for d, n, c in brute.jaccard_components(rows, 5, 80)}
    assert ids(one) == Counter(want)
    mixed = corpus_pipeline.mix(spark, one, sf_dir).cache()
    sizes = Counter()
    for r in one.collect():
        sizes[r.source] += len(brute.words(r.text))
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += len(brute.words(r.text))
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)
    final = corpus_pipeline.run(spark, sf_dir)
    assert ids(final) == ids(mixed)


def test_sample_by_label_is_bounded(spark):
    """Proportional, rare labels in full, never more than the bound; a hash decides."""
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 400 == 0).cast("int").alias("y"))
    got = {r.y: r["count"] for r in draw(df, "id", ["y"], 1000).groupBy("y").count().collect()}
    assert got[1] == 50 and 990 <= got[0] <= 1000
    few = draw(df.filter("id < 300"), "id", ["y"], 1000)
    assert few.count() == 300
    assert draw(df.filter("false"), "id", ["y"], 10).count() == 0


def test_a_repeated_row_is_one_sample_row(make, spark, monkeypatch):
    """A third of the rows are one document: the driver gets it once."""
    rows = [(i, f"word{i % 7} of some text number {i} and more", "en" if i % 2 else "de", "a")
            for i in range(300)]
    docs = make(rows + [(7, "the very same text again and again", "en", "a")] * 400)
    marks = spark.createDataFrame([(i, i % 2, int(i % 10 == 0)) for i in range(300)],
                                  "doc_id bigint, quality int, toxic int")
    seen = []
    for module, name in ((quality_mil.Network, "fit"), (toxicity.Chain, "fit")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda self, x, *a, real=real: (
            seen.append(len(x)), real(self, x, *a))[1])
    quality_mil.train(docs, marks, every())
    toxicity.train(docs, marks, every())
    assert seen == [300, 300]
    real = language_id.fit_ftrl
    monkeypatch.setattr(language_id, "fit_ftrl", lambda m, rows: (seen.append(len(rows)), real(m, rows))[1])
    language_id.train(docs, every())
    assert seen[2] <= 301


@pytest.mark.parametrize("languages", [2, 4, 30])
def test_doubt_is_relative_to_the_number_of_languages(make, languages):
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçøåłşğıőűčřžšđþæœ"
    rows = [(100 * k + i, " ".join(letters[(k + j) % 50] * (2 + j % 3) for j in range(i % 5 + 6)),
             f"l{k:02}", "a") for k in range(languages) for i in range(30)]
    docs = make(rows)
    model = language_id.train(docs, every())
    got = language_id.keep_known(docs, model)
    assert got.count() >= 0.9 * len(rows) and got.columns == docs.columns
    doubtful = make([(1, "12345 67890", None, None), (2, None, None, None), (3, "漢字漢字", None, None)])
    assert language_id.keep_known(doubtful, model).count() <= 1


def test_filters_leave_any_columns_alone(make, labels):
    docs = make(ODD).withColumnsRenamed({"size": "_text", "score": "_has", "n_chars": "_p"}) \
        .withColumn("_lang_found", F.lit(5)).withColumn("_word", F.lit("w"))
    network = quality_mil.train(docs, labels, every())
    model = language_id.train(docs, every())
    for got in (jaccard_join.keep_one(docs), quality_mil.keep_good(docs, network, 0.0),
                language_id.keep_known(docs, model)):
        assert got.columns == docs.columns and got.count() > 0
        assert got.filter("_text <> 7 OR _has <> 'x' OR _lang_found <> 5 OR _word <> 'w'").isEmpty()
