"""Commands end to end on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from dapple import cli
from dapple import queries as Q
from dapple.operators import metrics, models, raster, retrieval, splits
from dapple.operators.constellation import match_matrix
from dapple.plans import pipelines
from dapple.plans.pipelines import Sides
from dapple.schema import SpotConfig

from .test_manifest import png


@pytest.fixture(scope="module")
def catalogue(spark):
    """Photos of ten individuals by the mock embedder: two sessions each, one individual out of the gallery."""
    rows = [(i, f"m{i}", f"{'PW' if i % 10 % 2 else 'TK'}-{i % 10:03d}", "PW" if i % 10 % 2 else "TK", i // 10 % 2, "probe" if i >= 30 else "gallery") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, md5 string, individual_id string, cohort string, session int, role string")
    return models.embed(df).withColumn("identity", F.col("individual_id")).cache()


def sides(catalogue, known=True):
    gallery = catalogue.where("role = 'gallery' AND individual_id <> 'PW-009'")
    return Sides(gallery, catalogue.where(f"role = 'probe' AND individual_id {'<>' if known else '='} 'PW-009'"))


def test_retrieval_finds_mock_individuals(catalogue):
    s = sides(catalogue)
    r = retrieval.recall(pipelines.hits(s)).first()
    assert r["recall_at_1"] > 0.9 and r["n_probe"] == 18
    ranked, verdicts = pipelines.identify(s.probes, s.gallery, 3)
    assert ranked.groupBy("pid").count().where("count <> 3").count() == 0 and verdicts.count() == 18


def test_open_set_and_sealed_report(catalogue):
    area, tuned, rates = pipelines.open_set(sides(catalogue), sides(catalogue, False))
    assert area.first()["auroc"] > 0.9 and rates.first()["known_kept"] > 0.8
    with pytest.raises(ValueError):
        pipelines.embed_test(sides(catalogue), sides(catalogue, False), sides(catalogue), sides(catalogue, False), 20, unseal=False)
    report = pipelines.embed_test(sides(catalogue), sides(catalogue, False), sides(catalogue), sides(catalogue, False), 20, unseal=True).first()
    assert report["n"] == 18 and report["n_excluded"] == 0 and report["pipeline_at_1"] == pytest.approx(report["recall_at_1"] * 18 / 20, abs=1e-5)


def test_comparisons(catalogue):
    s = sides(catalogue)
    noise = Sides(s.gallery, s.probes.withColumn("embedding", F.transform("embedding", lambda x: -x)))
    compared, decision = pipelines.ab(noise, s)
    assert decision.first()["adopt"] and {r["k"] for r in compared.collect()} == {1, 5}
    per, chosen = pipelines.finetuned_ab({"a": noise, "b": noise}, {"a": noise, "b": s}, "a", ["b"])
    assert chosen.first()["decision"] == "b" and set(per) == {"a", "b"}
    good, bad = s.identity_scores(), noise.identity_scores()
    _, verdict, audit = pipelines.spot_ab(s, bad, good)
    assert verdict.first()["adopt"] and audit.where("match_hit AND NOT embed_hit").count() > 10
    grid = pipelines.hybrid(bad, good, s.truth, provenance=({"seed": 1}, {"seed": 1}))
    assert grid.where("best").first()["method"] == "rerank"


def test_ab_analysis_excludes_probes_without_true_id(spark):
    spec = "id long, identity string, cohort string, seg_conf double, raw array<double>, belly_oriented array<double>, unroll_debend array<double>"
    gallery = spark.createDataFrame([(0, "A", "TK", 0.9, [1.0, 0.0], [1.0, 0.0], None), (1, "B", "TK", 0.9, [0.0, 1.0], [0.0, 1.0], [0.0, 1.0])], spec)
    probes = spark.createDataFrame([(10, "A", "TK", 0.9, [0.0, 1.0], [1.0, 0.0], [1.0, 0.0]), (11, "B", "TK", 0.9, [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]), (12, "Z", "PW", 0.1, [0.0, 1.0], None, None)], spec)
    out = pipelines.ab_analysis(gallery, probes, ["belly_oriented", "unroll_debend"], sweep=(0.15,), ks=(1,))
    assert tuple(out["closed_set"].first()) == (3, 2, 1)
    paired = {r["variant"]: (r["n"], r["recall_at_1"]) for r in out["paired"].where("slice = 'overall'").collect()}
    assert paired == {"raw": (2, 0.0), "belly_oriented": (2, 1.0), "unroll_debend": (2, 1.0)}
    stats = {r["pair"]: (r["n"], r["b"], r["c"], r["diff"]) for r in out["stats"].collect()}
    assert stats == {"belly_oriented vs raw": (2, 0, 2, 1.0), "unroll_debend vs belly_oriented": (2, 0, 0, 0.0)}
    assert {r["slice"] for r in out["summary"].collect()} == {"overall", "TK", "PW"} and out["sensitivity"].count() == 2


def test_bootstrap_of_many_rows_has_the_same_law(spark, monkeypatch):
    pairs = spark.range(4000).select("id", (F.col("id") % 3 == 0).alias("a"), (F.col("id") % 5 < 2).alias("z"))
    exact = metrics.paired_bootstrap(pairs, "a", "z", "id").first()
    monkeypatch.setattr(metrics, "SEED_ROWS", 10)
    drawn = metrics.paired_bootstrap(pairs, "a", "z", "id").first()
    assert drawn["diff"] == pytest.approx(exact["diff"]) and drawn["lo"] == pytest.approx(exact["lo"], abs=2e-3) and drawn["hi"] == pytest.approx(exact["hi"], abs=2e-3)


def test_embedding_audit(catalogue):
    s = sides(catalogue)
    spark = catalogue.sparkSession
    true = retrieval.recall(pipelines.hits(s, "photo")).first()
    target = spark.createDataFrame([], "md5 string, dup_keep boolean, is_new_open boolean, kpi_scope string, split_fold string")
    e = catalogue.withColumn("variant", F.lit("v"))
    stated = lambda r1: spark.createDataFrame([(1, r1), (5, true["recall_at_5"])], "k int, recall double")
    assert pipelines.embed_verify(e, target, stated(true["recall_at_1"]), s).where("NOT ok").count() == 0
    assert pipelines.embed_verify(e, target, stated(0.1), s).where("NOT ok").first()["name"] == "recall_at_1"


def test_match_command_and_scopes(spark, catalogue):
    rng = np.random.default_rng(1)
    pts = [rng.uniform(0, 100, (7, 2)) for _ in range(3)]
    spots = lambda p: [(float(x), float(y), 9.0, 1.0) for x, y in p]
    spec = "id long, spots array<struct<x:double,y:double,area:double,score:double>>"
    gallery = spark.createDataFrame([(i, spots(p)) for i, p in enumerate(pts)], spec)
    probes = spark.createDataFrame([(7, spots(pts[1] * 2 + 3))], spec)
    assert pipelines.match(probes, gallery, 1).first()["gid"] == 1
    short = spark.createDataFrame([(7, 2)], "pid long, gid long")
    assert match_matrix(probes, gallery, SpotConfig(), short).count() == 1
    assert retrieval.filter_scope(catalogue, "PW").count() == 25 and retrieval.filter_scope(catalogue, None).count() == 50
    g, p = retrieval.align(catalogue.where("role = 'gallery'"), catalogue.where("role = 'probe'"), catalogue.where("id > 5"), catalogue.where("id < 40"))
    assert g.count() == 24 and p.count() == 10


def test_spots_of_a_stage(spark):
    image, _, _, _ = raster.synthetic_body()
    struct = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    images = spark.createDataFrame([("m1", ("x", 200, 120, 3, 16, bytearray(image[:, :, ::-1].tobytes()))), ("m2", None)], f"md5 string, image {struct}")
    rows = spark.createDataFrame([(m, "TK-001", "TK", "target", True, False, "kpi_core", "gallery", "train") for m in ("m1", "m2", "m3")], "md5 string, individual_id string, cohort string, role string, dup_keep boolean, is_new_open boolean, kpi_scope string, split_role string, split_fold string")
    crops = spark.createDataFrame([("m1", "belly_oriented", "a"), ("m2", "unroll_debend", "b")], "md5 string, variant string, crop_path string")
    out = pipelines.detect_spots(rows, crops, images, "gallery", cfg=SpotConfig(erode_px=2)).collect()
    assert [(r["md5"], r["detect_variant"]) for r in out] == [("m1", "belly_oriented")] and out[0]["n_spots"] >= 4
    with pytest.raises(ValueError):
        pipelines.detect_spots(rows, crops, images, "test")


def test_consistent_labels(spark):
    p = "struct<x:double,y:double>"
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    df = spark.createDataFrame([("in", square, (0.2, 0.5), (0.8, 0.5)), ("edge", square, (1.0, 0.5), (1.04, 0.5)), ("out", square, (2.0, 0.5), (2.2, 0.5)), ("none", None, None, None)], f"k string, belly_polygon array<{p}>, head_xy {p}, cloaca_xy {p}")
    assert {r["k"]: r["consistent"] for r in raster.belly_consistent(df).collect()} == {"in": True, "edge": True, "out": False, "none": False}


def test_embed_build_and_crop_rows(spark, sf):
    target = splits.assign_splits(Q.V.shots(spark, sf))
    crops = target.select("md5", F.lit("v").alias("variant"), F.col("md5").alias("crop_path"))
    out = pipelines.embed_build(target, crops, ["v"], 3)
    assert out.groupBy("individual_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        pipelines.embed_build(target, crops, ["v"], 3, ("gallery", "test"))
    rows = pipelines.crop_rows(target, target.limit(0), ["train", "gallery", "dev"], None)
    assert rows.count() == rows.select("md5").distinct().count()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "ws/tk/1").mkdir(parents=True)
    for i, name in enumerate(("01-01-1224.JPG", "01-02-0125.JPG")):
        (tmp_path / "ws/tk/1" / name).write_bytes(png(4032, 1, i))
    (tmp_path / "c.json").write_text(json.dumps({"workspace_root": str(tmp_path / "ws"), "datasets": [{"name": "t", "dir": "tk", "id_prefix": "TK", "role": "target"}]}))
    assert cli.main(["build", str(tmp_path / "c.json"), str(tmp_path / "m")], spark) == 0
    assert cli.main(["validate", str(tmp_path / "m")], spark) == 0
    assert "warning: g10_dimensions: 2" in capsys.readouterr().out
    assert cli.main(["eda", str(tmp_path / "m")], spark) == 0
    assert cli.main(["embed-pack", str(tmp_path / "ws"), str(tmp_path / "p")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    broken = spark.read.parquet(str(tmp_path / "m/target")).withColumn("split_fold", F.lit("train"))
    broken.write.parquet(str(tmp_path / "b/target"))
    spark.read.parquet(str(tmp_path / "m/external")).write.parquet(str(tmp_path / "b/external"))
    assert cli.main(["validate", str(tmp_path / "b")], spark) == 1


def test_summary_without_probes(spark):
    empty = spark.createDataFrame([], "cohort string, hit_at_1 boolean, hit_at_5 boolean")
    r = metrics.summarize(empty).first()
    assert r["n"] == 0 and r["recall_at_1"] == 0.0
