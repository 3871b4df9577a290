"""Closed-form values of functions and statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dapple.functions import geometry, hashing, parse, stats
from dapple.operators import decide, fusion, metrics, retrieval


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


@pytest.mark.parametrize("h,n,lo,hi", [(28, 112, 0.179, 0.3376), (50, 112, 0.3577, 0.5388), (26, 112, 0.1636, 0.3184), (47, 112, 0.3324, 0.5122), (0, 0, 0.0, 0.0)])
def test_wilson(spark, h, n, lo, hi):
    r = one(spark, stats.wilson(F.lit(h), F.lit(n)))[0]
    assert (round(r["lo"], 4), round(r["hi"], 4)) == (lo, hi)


def test_wilson_clamps_hits(spark):
    assert one(spark, stats.wilson(F.lit(5), F.lit(3)))[0]["hi"] == 1.0


def test_mcnemar():
    assert stats.mcnemar_p(0, 8) == 0.0078125
    assert stats.mcnemar_p(2, 2) > 0.05
    assert stats.mcnemar_p(0, 0) == 1.0
    assert stats.mcnemar_p(500, 700) < 0.05
    assert math.isclose(stats.mcnemar_p(480, 520), 0.2174, abs_tol=0.003)


def test_mcnemar_of_any_size(spark):
    counts = spark.createDataFrame([(0, 0), (1, 5), (13, 14), (20, 20), (400, 300), (600, 500)], "b long, c long")
    got = {(r["b"], r["c"]): r["p"] for r in metrics.mcnemar(counts).collect()}
    for (b, c), p in got.items():
        n = b + c
        exact = 1.0 if n == 0 else min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(min(b, c) + 1)))
        assert math.isclose(p, exact, rel_tol=1e-9 if n <= 1000 else 0.02)


def test_bootstrap():
    d, lo, hi = stats.bootstrap(np.zeros(40), np.array([1, 0] * 20))
    assert d == 0.5 and 0 < lo < 0.5 <= hi


@pytest.mark.parametrize("text,want", [("1224", "2024-12"), ("01725", "2025-01"), ("1322", None), ("1222", None), ("ab12", None), ("124", None), ("", None), (None, None)])
def test_mmyy(spark, text, want):
    assert one(spark, parse.normalize_mmyy(F.lit(text).cast("string")))[0] == want


def test_file_names(spark):
    r = one(spark, parse.tk_filename(F.lit("01-02-0125.JPG")), parse.tk_filename(F.lit("IMG_1.JPG")), parse.pw_filename(F.lit("12-3 (4).jpeg")), parse.lab_stem(F.lit("03.1")), parse.lab_stem(F.lit("x")))
    assert tuple(r[0]) == (1, "02", "2025-01") and tuple(r[1]) == (None, None, None)
    assert tuple(r[2]) == (12, "03", 4) and tuple(r[3]) == (3, 1) and r[4]["id"] is None


def test_dates_and_rle(spark):
    r = one(spark, parse.lab_date(F.lit("05.08.2025")), parse.lab_date(F.lit("30.02.2025")), parse.lab_date(F.lit("5.8.2022")), parse.tk_subfolder_date(F.lit("a 0225 b")), parse.tk_subfolder_date(F.lit("none")))
    assert tuple(r) == ("2025-08-05", None, None, "2025-02", None)
    r = one(spark, *(parse.rle_prefix(F.lit(t).cast("string")) for t in ("2048x1536:abcd", "1536x2048:", "x", None)))
    assert [tuple(x) for x in r] == [(2048, 1536, False), (1536, 2048, True), (None, None, True), (None, None, True)]


def test_long_ids_are_not_cut(spark):
    assert one(spark, parse.namespaced_id(F.lit("TK"), F.lit(1234)), parse.namespaced_id(F.lit("TK"), F.lit(7))) == ("TK-1234", "TK-007")


def test_confidence(spark):
    r = one(spark, *(geometry.calibrated(F.lit(s), F.lit(0.15), F.lit(0.55)) for s in (0.10, 0.60)))
    assert tuple(r) == (0.0, 99.0)


def test_exact_coin(spark):
    import hashlib

    want = int.from_bytes(hashlib.blake2b(b"42-fold:a", digest_size=8).digest(), "big") / 2**64
    assert one(spark, hashing.coin(F.lit("42-fold:a"), "exact"))[0] == want


def test_photo_and_identity_level_differ(spark):
    gallery = spark.createDataFrame([(1, "W", [1.0]), (2, "W", [0.98]), (3, "T", [0.6]), (4, "X", [-1.0])], "id long, identity string, embedding array<double>")
    probes = spark.createDataFrame([(0, "T", [1.0])], "id long, identity string, embedding array<double>")
    truth = probes.select(F.col("id").alias("pid"), "identity")
    photo = retrieval.photo_hits(retrieval.photo_ranks(probes, gallery), truth, (1, 2)).first()
    ident = retrieval.identity_hits(retrieval.identity_photos(probes, gallery), truth, (1, 2)).first()
    assert not photo["hit_at_2"] and photo["rank"] == 3 and ident["hit_at_2"] and not ident["hit_at_1"]


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_ranks_and_best_photos_against_all_pairs(spark, monkeypatch, limit):
    """Ties, absent identities and blocks of three rows."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(3)
    rows = [(i, f"i{i % 4}" if i else "none", rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, identity string, embedding array<double>")
    probes, gallery = df.where("id < 9"), df.where("id >= 9")
    ranks = {r["pid"]: r["rank"] for r in retrieval.photo_ranks(probes, gallery, broadcast_bytes=limit).collect()}
    best = {(r["pid"], r["identity"]): (r["sim"], r["best_photo"], r["n_photos"]) for r in retrieval.identity_photos(probes, gallery, broadcast_bytes=limit).collect()}
    assert len(best) == 9 * 4
    for p in range(9):
        order = sorted(((-float(np.dot(rows[p][2], rows[g][2])), g) for g in range(9, 40)))
        own = [k + 1 for k, (_, g) in enumerate(order) if rows[g][1] == rows[p][1]]
        assert ranks[p] == (own[0] if own else None)
        for who in ("i0", "i1", "i2", "i3"):
            of = [(s, g) for s, g in order if rows[g][1] == who]
            assert best[p, who] == (-of[0][0], of[0][1], len(of))


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_blocked_and_broadcast_similarities_agree(spark, limit):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist(), f"i{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, who string")
    found = {(r["pid"], r["identity"]): r["sim"] for r in retrieval.similarities(df.where("id < 5"), df.where("id >= 5"), identity="who", broadcast_bytes=limit).collect()}
    for p in range(5):
        for who in ("i0", "i1", "i2"):
            want = max(float(np.dot(rows[p][1], rows[g][1])) for g in range(5, 30) if rows[g][2] == who)
            assert math.isclose(found[p, who], want, abs_tol=1e-8)


def _scores(spark):
    rows = [(0, i, e, m) for i, e, m in (("A", 0.9, 0.1), ("B", 0.8, 0.2), ("C", 0.7, 0.9), ("D", 0.6, 0.95), ("E", 0.5, 0.99))]
    return spark.createDataFrame(rows, "pid long, identity string, es double, ms double"), spark.createDataFrame([(0, "C")], "pid long, identity string")


def test_fusion(spark):
    scores, truth = _scores(spark)
    r = fusion.fuse_hits(fusion.fuse(scores, 3), truth, (1,)).first()
    assert not r["embed_at_1"] and r["hybrid_at_1"]
    zero = fusion.fuse(scores.withColumn("ms", F.lit(0.0)), 3)
    assert zero.where("embed_rank <> hybrid_rank").count() == 0
    assert fusion.fuse(scores, 3).where("identity = 'E'").first()["hybrid_rank"] == 5  # outside the shortlist
    with pytest.raises(ValueError):
        fusion.fuse(scores, 3, "other")
    with pytest.raises(ValueError, match="seed"):
        fusion.check_provenance({"seed": 1}, {"seed": 2})


def test_open_set(spark):
    df = spark.createDataFrame([(s, n) for s, n in ((0.95, False), (0.92, False), (0.90, False), (0.30, True), (0.25, True), (0.20, True))], "score double, is_new boolean")
    assert metrics.auroc(df).first()["auroc"] == 1.0
    t = metrics.youden(df).first()
    assert 0.30 < t["threshold"] <= 0.90 and t["j"] == 1.0
    assert metrics.auroc(df.where("NOT is_new")).first()["auroc"] is None
    assert metrics.youden(df.where("NOT is_new")).first()["threshold"] == 0.92


def test_coverage_split(spark):
    hits = spark.createDataFrame([(0, True, True, True), (1, True, True, True), (2, False, False, False)], "pid long, hit_at_1 boolean, hit_at_5 boolean, known boolean")
    r = metrics.recall_split(hits, "known", 4).first()
    assert (r["closed_at_1"], r["pipeline_at_1"], r["n_excluded"]) == (1.0, 0.5, 1)


def test_adopt_needs_gain_and_no_regression(spark):
    pairs = lambda base, var: spark.createDataFrame([(i, b, b, v, v) for i, (b, v) in enumerate(zip(base, var, strict=True))], "pid long, base_at_1 boolean, base_at_5 boolean, var_at_1 boolean, var_at_5 boolean")
    better = decide.compare(pairs([False] * 10, [True] * 8 + [False] * 2), (1, 5))
    assert decide.adopt_challenger(better, 5).first()["adopt"]
    worse = decide.compare(pairs([True] * 10, [False] * 8 + [True] * 2), (1, 5))
    assert decide.adopt_challenger(worse, 5).first()["reason"] == "regression"
    with pytest.raises(Exception, match="no recall at k=7"):
        decide.adopt_challenger(better, 7).collect()


def test_verdict(spark):
    rows = [(0, 1, 92.0), (0, 2, 55.0), (1, 1, 58.0), (1, 2, 54.0), (2, 1, 85.0), (2, 2, 83.0), (4, 1, 75.0)]
    ranked = spark.createDataFrame(rows, "pid long, rank int, confidence double")
    got = {r["pid"]: r["verdict"] for r in retrieval.verdict(ranked, spark.range(5).withColumnRenamed("id", "pid")).collect()}
    assert got == {0: "known", 1: "new_candidate", 2: "new_candidate", 3: "new_candidate", 4: "known"}


def test_scaled_bootstrap_agrees_with_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, bool(a), bool(b)) for i, (a, b) in enumerate(zip(rng.random(2000) < 0.4, rng.random(2000) < 0.5, strict=True))]
    df = spark.createDataFrame(rows, "k long, a boolean, b boolean")
    exact, scaled = metrics.paired_bootstrap(df, "a", "b", "k", 500).first(), metrics.scaled_bootstrap(df, "a", "b", "k", 500).first()
    assert scaled["diff"] == pytest.approx(exact["diff"])
    assert scaled["lo"] == pytest.approx(exact["lo"], abs=0.012) and scaled["hi"] == pytest.approx(exact["hi"], abs=0.012)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    from dapple.operators.prefix import running_sums

    rows = [(float((i * 37) % 1000), i % 5) for i in range(1000)]
    got = {r["k"]: (r["s"], r["e"]) for r in running_sums(running_sums(spark.createDataFrame(rows, "k double, v long"), "k", {"s": "v"}, descending), "k", {"e": "v"}, descending, inclusive=False).collect()}
    total = 0
    for k, v in sorted(rows, reverse=descending):
        assert got[k] == (total + v, total)
        total += v


@pytest.mark.parametrize("n,people", [(40, 8), (40, 40), (2, 1), (12, 1)])
def test_gallery_calibration_equals_that_of_pairs(spark, n, people):
    rng = np.random.default_rng(n + people)
    v = rng.standard_normal((n, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, v[i].tolist(), f"i{i % people}") for i in range(n)]
    g = spark.createDataFrame(rows, "id long, embedding array<double>, identity string")
    pairs = [(float(np.round(v[a] @ v[b], 9)), rows[a][2] == rows[b][2]) for a in range(n) for b in range(a + 1, n)]
    want = metrics.pair_calibration(spark.createDataFrame(pairs, "sim double, same boolean"), n).first()
    for bins in (8, 1 << 16):
        got = metrics.gallery_calibration(g, bins=bins).first()
        assert got["lo"] == pytest.approx(want["lo"], abs=1e-8) and got["hi"] == pytest.approx(want["hi"], abs=1e-8)
