"""Constellations, raster kernels, model boundaries and the stream."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dapple import queries as Q
from dapple.operators import constellation as C
from dapple.operators import models
from dapple.operators import raster as R
from dapple.schema import CropConfig, SpotConfig
from dapple.streaming.identify import identify_stream


def moved(p, degrees=37.0, scale=1.6, shift=(12.0, -5.0)):
    z = (p[:, 0] + 1j * p[:, 1]) * scale * np.exp(1j * np.radians(degrees)) + complex(*shift)
    return np.column_stack([z.real, z.imag])


@pytest.mark.parametrize("matcher", ["guided", "ransac", "nn"])
def test_matcher_is_invariant_and_penalises_mirrors(matcher):
    cfg, rng = SpotConfig(matcher=matcher), np.random.default_rng(0)
    a, other = rng.uniform(0, 100, (8, 2)), rng.uniform(0, 100, (8, 2))
    score, pairs = C.match(a, moved(a), cfg)
    assert score >= 0.8 and len(pairs) >= 6
    assert C.match(a, other, cfg)[0] <= 0.5
    assert C.match(a, moved(a) * [-1, 1], cfg)[0] < score
    assert C.match(a, moved(a), cfg) == C.match(a, moved(a), cfg)
    assert abs(score - C.match(moved(a), a, cfg)[0]) <= 0.15


def test_matcher_limits():
    a = np.random.default_rng(0).uniform(0, 1, (2, 2))
    assert C.match(a, a) == (0.0, [])
    with pytest.raises(ValueError):
        C.match(a, a, SpotConfig(matcher="x"))


def test_match_pairs_agrees_with_kernel(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 100, (6, 2)), rng.uniform(0, 100, (2, 2))
    rows = lambda p: [(float(x), float(y)) for x, y in p]
    df = spark.createDataFrame([(0, 1, rows(a), rows(moved(a))), (0, 2, rows(a), rows(b))], "pid long, gid long, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    got = {r["gid"]: r["score"] for r in C.match_pairs(df).collect()}
    assert got[1] == C.match(a, moved(a))[0] and got[2] == 0.0


def test_straightening_and_pattern():
    image, mask, axis, spots = R.synthetic_body()
    assert R.pattern_safe() == ["debend", "ribbon"]
    assert R.straighten(image, None, axis, "debend")[1] == "no_mask"
    assert R.straighten(image, mask, None, "debend")[1] == "no_axis"
    assert R.straighten(image, mask, ((0, 50), (0, 60)), "debend")[1] == "axis_too_short"
    assert R.straighten(image, mask, ((0, 50), (0, 50)), "debend")[1] == "degenerate_centerline"
    assert R.straighten(image, mask, axis, "other")[1] == "bad_method"
    rows, line, width = R.centerline(mask, axis)
    true = 60 + 14 * np.sin((rows - 20) / 160 * np.pi)
    assert np.abs(line - true).max() < 2.5 and (width > 0).all()
    for method in ("debend", "ribbon", "wnorm"):
        straight, status = R.straighten(image, mask, axis, method)
        assert status == "ok" and straight.shape == image.shape
        body = straight.sum(axis=2) > 60
        after = R.centerline(body, axis)
        assert R.curvature(after[0], after[1]) < 0.3 * R.curvature(rows, line) and abs(after[1].mean() - 60) < 1.5
        assert not straight[:18].any()  # black outside the moved mask
    straight, _ = R.straighten(image, mask, axis, "debend")
    found = R.detect_spots(straight, straight.sum(axis=2) > 0, SpotConfig(erode_px=0))
    for x, y in spots:  # rows and distances from the axis stay
        off = x - (60 + 14 * np.sin((y - 20) / 160 * np.pi))
        assert min(abs(s["x"] - 60 - off) + abs(s["y"] - y) for s in found) < 4


def test_centerline_of_loops_and_holes():
    two = np.zeros((80, 60), dtype=bool)
    two[10:70, 5:20] = two[10:70, 35:46] = True  # a second run of 11 to 15
    assert R.centerline(two, None) is None
    two[:, 35:46] = False
    two[30:40] = False
    rows, line, width = R.centerline(two, None)
    assert len(rows) == 60 and np.allclose(line, 12) and np.allclose(width, 15)
    assert R.centerline(two, ((12, 20), (12, 24))) is not None and len(R.centerline(two, ((12, 20), (12, 29)))[0]) == 10


def test_even_light_keeps_hue_and_spreads_lightness():
    image, mask, _, _ = R.synthetic_body()
    faint = (image * 0.25 + 40 * mask[..., None]).astype(np.uint8)
    out = R.even_light(faint, 2.0, 8)
    assert out.shape == image.shape and out.dtype == np.uint8 and out[mask].std() > faint[mask].std()
    assert np.abs(R._from_lab(R._to_lab(image)).astype(int) - image).max() <= 1
    near = lambda found: max(min(np.hypot(s["x"] - x, s["y"] - y) for s in found) for x, y in R.synthetic_body()[3])
    assert near(R.detect_spots(faint, mask, SpotConfig(erode_px=2, illum_norm=True))) < 8


def test_selection_of_spots():
    spots = [{"x": 1.0, "y": 1.0, "area": 100.0, "score": 0.1}, {"x": 2.0, "y": 2.0, "area": 9.0, "score": 2.0}, {"x": 3.0, "y": 3.0, "area": 16.0, "score": 0.05}]
    by = lambda how: [s["x"] for s in R.select_spots(spots, SpotConfig(select_by=how, top_n=2))]
    assert by("salience") == [2.0, 1.0] and by("area") == [1.0, 3.0]


def test_random_matcher_draws_pairs_of_points():
    draws = C._draws(6, 8, 50, 42)
    assert draws.shape == (100, 4) and (draws[:, 0] != draws[:, 2]).all() and (draws[:, 1] != draws[:, 3]).all()
    assert (draws[:50, [1, 3]] == draws[50:, [3, 1]]).all() and (draws[:50, [0, 2]] == draws[50:, [0, 2]]).all()


def test_pruned_hypotheses_are_those_of_all():
    rng = np.random.default_rng(5)
    for _ in range(15):
        a, b = rng.standard_normal((12, 2)), rng.standard_normal((14, 2))
        c = np.array(C.correspondences(a, b, 5, 4))
        f, g = np.triu_indices(len(c), 1)
        ok = (c[f, 0] != c[g, 0]) & (c[f, 1] != c[g, 1])
        seeds, tol = np.column_stack([c[f[ok]], c[g[ok]]]), 0.08 * C.rms(b)
        za, zb = a @ [1, 1j], b @ [1, 1j]
        best: tuple = (-1, 0.0)
        for i1, j1, i2, j2 in seeds:
            d = np.abs(((zb[j2] - zb[j1]) / (za[i2] - za[i1]) * (za - za[i1]) + zb[j1])[:, None] - zb[None, :]) ** 2
            to, fro = d.argmin(1), d.argmin(0)
            pairs = [(i, int(to[i])) for i in range(12) if fro[to[i]] == i and d[i, to[i]] <= tol * tol]
            key = (len(pairs), -sum(d[i, j] for i, j in pairs) / max(1, len(pairs)))
            if key[0] > best[0] or (key[0] == best[0] and key[1] > best[1] + 1e-12):
                best, chosen = key, pairs
        assert C.best_hypothesis(a, b, seeds, tol) == chosen


@pytest.mark.parametrize("method", ["deviation", "darkness", "log", "dog"])
def test_spots(method):
    image, mask, _, spots = R.synthetic_body()
    found = R.detect_spots(image, mask, SpotConfig(detect_method=method, erode_px=2))
    near = [min(np.hypot(s["x"] - x, s["y"] - y) for s in found) for x, y in spots]
    assert max(near) < 4


def test_ladder():
    image, mask, axis, _ = R.synthetic_body()
    status = lambda *a: (lambda c: (c.variant, c.status))(R.belly_crop(image, *a))
    assert status(None, 0.9, axis, 0.9) == ("full", "empty_mask")
    assert status(mask, 0.1, axis, 0.9) == ("full", "low_seg_conf")
    assert status(mask & (np.arange(200) < 23)[:, None], 0.9, axis, 0.9) == ("full", "tiny_mask")
    assert status(mask, 0.9, None, 0.9) == ("belly_mask", "no_pose")
    assert status(mask, 0.9, axis, 0.1) == ("belly_mask", "low_pose_conf")
    crop = R.belly_crop(image, mask, 0.9, axis[::-1], 0.9)
    assert crop.variant == "belly_oriented" and crop.image.shape == (384, 384, 3) and abs(abs(crop.degrees) - 180) < 1
    clipped = R.belly_crop(image, mask, 0.9, ((10.0, 100.0), (110.0, 100.0)), 0.9)
    assert clipped.status == "clipped_after_rotation"


def test_masks():
    _, mask, _, _ = R.synthetic_body()
    assert (R.rle_decode(R.rle_encode(mask)) == mask).all()
    outline = R.mask_polygon(mask)
    assert (R.fill_polygon(outline, mask.shape) ^ mask).mean() < 0.01
    assert R.mask_polygon(np.zeros((9, 9), dtype=bool)) is None
    assert R.tight_box(np.zeros((5, 7), dtype=bool)) == (0, 0, 7, 5)
    image = np.zeros((20, 20, 3), dtype=np.uint8)
    image[5:15, 5:15] = 200
    image[9:11, 9:11] = 5
    assert R.foreground(image).sum() == 100
    assert R.erode(np.ones((5, 5), dtype=bool), 1).all() and R.erode(np.pad(np.ones((5, 5), dtype=bool), 2), 1).sum() == 9


def test_labels_without_model():
    _, mask, _, _ = R.synthetic_body()
    found = R.pseudo_label(mask)
    assert R.polygon_contains(found["belly_polygon"], tuple(np.mean([found["head_xy"], found["cloaca_xy"]], axis=0)))
    gray = np.random.default_rng(0).uniform(0, 255, mask.shape)
    assert R.pick_animal([np.ones_like(mask), mask, np.zeros_like(mask)], gray) == 1
    assert R.pick_animal([], gray) is None


def test_pseudo_label_points():
    """A tapering body with a broad head, tip at row 20 and end at row 220: head at the tip, cloaca at 0.66, the band inside the middle half."""
    y, x = np.mgrid[0:240, 0:130]
    half = np.where(y < 80, 22.0, np.clip(16 - (y - 80) * 0.09, 3, None))
    mask = (np.abs(x - 65) <= half) & (y >= 20) & (y <= 220)
    legs = mask | ((np.abs(y - 110) < 6) & (np.abs(x - 65) < 40))
    for body, flip in ((legs, False), (legs[::-1], True)):
        found = R.pseudo_label(body)
        head, cloaca = (np.array(found[k]) * (130, 240) for k in ("head_xy", "cloaca_xy"))
        at = (lambda v: 239 - v) if flip else (lambda v: v)
        assert abs(at(head[1]) - 20) < 2 and abs(at(cloaca[1]) - (20 + 0.66 * 200)) < 2 and abs(head[0] - 65) < 3
        band = np.array(found["belly_polygon"]) * (130, 240)
        rows = at(band[:, 1])
        assert abs(rows.min() - (20 + 0.18 * 200)) < 3 and abs(rows.max() - (20 + 0.66 * 200)) < 3
        assert np.abs(band[:, 0] - 65).max() < 22 and len(band) == 48
        assert 0.3 < found["head_conf"] < 0.95 and 0 <= found["band_conf"] <= 1 and found["notes"] in ("", "band_suspect")
    assert R.pseudo_label(np.zeros((9, 9), dtype=bool)) is None


def test_spots_of_image_rows(spark):
    image, _, _, _ = R.synthetic_body()
    data = image[:, :, ::-1].tobytes()
    spec = "md5 string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    df = spark.createDataFrame([("a", ("x", 200, 120, 3, 16, bytearray(data))), ("b", None)], spec)
    rows = R.spots_of_crops(df, SpotConfig(erode_px=2)).collect()
    assert len(rows) == 1 and rows[0]["n_spots"] >= 4


def test_mock_embedder_and_cross_fit(spark):
    rows = [(f"m{i}", f"i{i % 4}", "gallery" if i % 3 else "probe", i % 4 % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "md5 string, individual_id string, role string, fold int")
    vectors = {r["md5"]: np.array(r["embedding"]) for r in models.embed(df).collect()}
    assert vectors["m0"] @ vectors["m4"] > vectors["m0"] @ vectors["m1"]

    def train(part: pd.DataFrame, fold: int):
        assert (part["fold"] != fold).all() and (part["role"] == "gallery").all()
        return models.MockEmbedder()

    out = models.cross_fit(df, train).collect()
    assert sorted(r["md5"] for r in out) == sorted(r[0] for r in rows)
    assert models.isolate(lambda r: 1 / 0)({})["err"].startswith("ZeroDivisionError")


def test_stream(spark, sf, tmp_path):
    s = Q.V.sides(spark, sf)
    s.probes.select("id", "embedding").where("id < 50").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id bigint, embedding array<float>").parquet(str(tmp_path / "in"))
    q = identify_stream(stream, s.gallery, lambda ranked, verdicts, n: seen.append((n, verdicts.count(), ranked.agg(F.max("rank")).first()[0])), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(n for _, n, _ in seen) == 10 and seen[0][2] == 7


def test_crop_config_ignores_unknown_keys():
    from dapple.schema import from_mapping

    assert from_mapping(CropConfig, {"canon_size": 256, "other": 1, "unroll_methods": ["debend"]}).unroll_methods == ("debend",)


def test_constellation_match_is_the_whole_matrix(spark, tmp_path):
    from dapple.operators.constellation import match
    from dapple.queries import QUERIES

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(64)], i % 3) for i in range(15)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    points = {r["vec_id"]: np.array(r["embedding"][:40], dtype=np.float64).reshape(20, 2) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    got = {(r["pid"], r["gid"]): (r["score"], r["n"]) for r in QUERIES["constellation_match"](spark, str(tmp_path)).collect()}
    want = {(p, g): match(points[p], points[g]) for p in points for g in points if p % 5 == 0 and g % 5}
    assert got == {k: (round(score, 6), len(pairs)) for k, (score, pairs) in want.items()} and len(got) == 36


def test_matrix_gives_counts_for_pairs_and_parses_spots_once_a_block(spark):
    rng = np.random.default_rng(4)
    spots = lambda n: [(float(x), float(y)) for x, y in rng.standard_normal((n, 2))]
    rows = [(i, None if i == 5 else spots([9, 2, 0, 12, 7][i % 5])) for i in range(14)]
    df = spark.createDataFrame(rows, "id long, spots array<struct<x:double,y:double>>")
    probes, gallery = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    full = C.match_matrix(probes, gallery)
    counts = {(r["pid"], r["gid"]): (r["score"], r["n"]) for r in C.match_matrix(probes, gallery, pairs=False).collect()}
    assert counts == {(r["pid"], r["gid"]): (r["score"], len(r["pairs"])) for r in full.collect()}
    assert counts == {(p, g): (lambda m: (m[0], len(m[1])))(C.match(s, t)) for p, s in rows for g, t in rows if p % 2 == 0 and g % 2 == 1}
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_blocks_make_one_grid_a_photo(monkeypatch):
    from dapple.schema import SpotConfig

    rng = np.random.default_rng(8)
    cfg, made = SpotConfig(), []
    sets = [rng.standard_normal((n, 2)) for n in (20, 12, 2, 0, 7, 20)]
    sets += [sets[0] * 1e-3 + 5, np.round(sets[1]), np.full((4, 2), 3.0)]
    rows = [(i, p, C.descriptors(p, cfg.descriptor_knn) if len(p) >= cfg.min_spots else None) for i, p in enumerate(sets)]

    class Counted(C.Near):
        def __init__(self, b, tol):
            made.append(len(b))
            super().__init__(b, tol)

    monkeypatch.setattr(C, "Near", Counted)
    full, counts = C._met(rows, rows, cfg, True), C._met(rows, rows, cfg, False)
    assert len(made) == 2 * sum(len(p) >= cfg.min_spots for p in sets)
    monkeypatch.undo()
    assert {(p, g): (s, m) for p, g, s, m in full} == {(p, g): C.match(sets[p], sets[g], cfg) for p in range(len(sets)) for g in range(len(sets))}
    assert [(p, g, s, len(m)) for p, g, s, m in counts] == [(p, g, s, len(m)) for p, g, s, m in full]


def test_bound_of_inliers_holds_for_maps_of_any_size():
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal((20, 2)), rng.standard_normal((20, 2))
    za, zb = a @ [1, 1j], b @ [1, 1j]
    i, j = rng.integers(0, 20, 3000), rng.integers(0, 20, 3000)
    scale = 10 ** rng.uniform(-8, 12, 3000) * np.exp(1j * rng.uniform(0, 7, 3000))
    scale[:3] = np.nan, np.inf, 1e300
    shift = zb[j] - scale * za[i]
    with np.errstate(invalid="ignore", over="ignore"):
        d = np.abs(za[None, :, None] * scale[:, None, None] + shift[:, None, None] - zb)
        most = C.Near(b, 0.1).most(a, scale, shift)
    # a hundredth of the tolerance is left to the rounding of large numbers
    assert (most >= np.minimum((d.min(axis=2) <= 0.099).sum(axis=1), (d.min(axis=1) <= 0.099).sum(axis=1))).all()
    assert (most[:3] == 20).all() and most[np.abs(scale) > 1e3].mean() < 20


def test_bound_of_inliers_holds_and_is_close():
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((20, 2)), rng.standard_normal((20, 2))
    scale, shift = rng.standard_normal(400) + 1j * rng.standard_normal(400), rng.standard_normal(400) + 1j * rng.standard_normal(400)
    d = np.abs((a @ [1, 1j])[None, :, None] * scale[:, None, None] + shift[:, None, None] - (b @ [1, 1j])[None, None, :])
    true = ((d <= 0.1) & (d == d.min(axis=2, keepdims=True)) & (d == d.min(axis=1, keepdims=True))).sum(axis=(1, 2))
    most = C.most_inliers(a, b, scale, shift, 0.1)
    assert (most >= true).all() and (most - true).mean() < 3


def test_dot_matrix_rounds_as_sql_and_keeps_odd_vectors(spark):
    import duckdb

    from dapple.operators.retrieval import dot_matrix

    ties = [(10 * k + 5) / 1e6 * (-1) ** k for k in range(3000)]
    rows = [(i, [x]) for i, x in enumerate(ties)] + [(9001, None), (9002, [None]), (9003, [2.0, 3.0]), (9004, [float("nan")]), (9005, [])]
    photos = spark.createDataFrame(rows, "id long, embedding array<double>")
    probes = spark.createDataFrame([(1, [1.0]), (2, [4.0, 5.0]), (3, None)], "id long, embedding array<double>")
    got = {(r["pid"], r["gid"]): r["sim"] for r in dot_matrix(probes, photos, 5).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?::DOUBLE[]) AS x", [ties])
    want = [x for (x,) in con.execute("SELECT round(round(x, 9), 5) FROM t").fetchall()]
    assert len(got) == 3 * len(rows) and [got[1, i] for i in range(len(ties))] == want
    assert [got[1, i] for i in (9001, 9002, 9003)] == [None] * 3 and np.isnan(got[1, 9004])
    assert got[2, 9003] == 23.0 and got[2, 0] is None and got[3, 0] is None
