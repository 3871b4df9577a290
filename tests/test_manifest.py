"""Scans of a synthetic tree, duplicates, splits, stages, gates and variants."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from dapple import queries as Q
from dapple.operators import dedup, gates, splits, variants
from dapple.plans import pipelines
from dapple.schema import ConfigError
from dapple.sources import files, sinks


def png(w, h, salt=0):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + bytes([salt % 256]) * (3 * w) for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def jpeg(w, h, turn=1):
    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0" + struct.pack("<HHII", 0x0112, 3, 1, turn) + b"\0\0\0\0"
    sof = struct.pack(">BHHB", 8, h, w, 3) + b"\x01\x11\0" * 3
    return b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">H", len(sof) + 2) + sof + b"\xff\xd9"


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")
    salt = 0
    for p in ("tk/1/01-01-1224.JPG", "tk/1/01-02-0125.JPG", "tk/1/trip 0225/IMG_1000.JPG", "tk/2/02-01-1224.JPG", "tk/66/66-01-1224.JPG", "tk/66/visit 0125/IMG_2000.JPG", "tk/99 (skip)/1.JPG", "tk/1/.hidden.JPG",
              "lab/05.08.2025/03.jpg", "lab/25.10.2025/03.jpg", "lab/25.10.2025/10.jpg", "lab/25.10.2025/x.jpg", "pw/1/01-01 (1).JPG", "pw/1/01-01 (2).JPG", "pw/2/02-01 (1).JPG", "gcn/Raw_Data/1/a.JPG"):
        salt += 1
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(png(20, 16, salt))
    (root / "lab/05.08.2025/03.1.jpg").write_bytes((root / "lab/05.08.2025/03.jpg").read_bytes())
    (root / "lab/25.10.2025/1.jpg").write_bytes((root / "lab/25.10.2025/10.jpg").read_bytes())
    (root / "gcn/metadata.csv").write_text("index,identity,file_name,recapture_id,survey,bbox,segmentation_mask_rle\n0,1,Raw_Data/1/a.JPG,r,s,\"[1.0, 2.0]\",2048x1536:abcd\n1,10,Raw_Data/10/gone.JPG,r,s,,1536x2048:\n")
    return root


def config(root):
    names = [("TK", "tk", "target", ["99 (skip)"]), ("LAB", "lab", "target", []), ("PW", "pw", "target", []), ("GCN", "gcn", "external", [])]
    return files.load_config({"workspace_root": str(root), "image_extensions": [".jpg", ".JPG"], "datasets": [{"name": n, "dir": d, "id_prefix": n, "role": r, "layout": d, "skip_dirs": s} for n, d, r, s in names]})


def test_build(spark, workspace, tmp_path):
    target, external = pipelines.build_manifest(spark, config(workspace))
    rows = {r["rel_path"]: r for r in target.collect()}
    assert len(rows) == 14 and external.count() == 2
    assert sorted(r["cohort"] for r in rows.values()) == ["LAB"] * 5 + ["PW"] * 3 + ["TK"] * 6
    assert sorted(p for p, r in rows.items() if not r["dup_keep"]) == ["lab/05.08.2025/03.1.jpg", "lab/25.10.2025/1.jpg"]
    assert rows["tk/1/trip 0225/IMG_1000.JPG"]["date"] == "2025-02" and rows["tk/1/01-01-1224.JPG"]["date_source"] == "filename"
    assert rows["tk/1/01-01-1224.JPG"]["width"] == 20 and rows["tk/1/01-01-1224.JPG"]["height"] == 16
    assert [rows[p]["split_role"] for p in ("tk/1/01-01-1224.JPG", "tk/1/01-02-0125.JPG", "tk/1/trip 0225/IMG_1000.JPG")] == ["gallery", "probe", "probe"]
    gone = external.where("md5 LIKE 'MISSING:%'").first()
    assert gone["width"] == 0 and gone["mask_empty"] and gone["rle_h"] == 1536
    warnings = pipelines.validate(target, external)
    assert [w[0] for w in warnings] == ["g10_dimensions"]
    again, _ = pipelines.build_manifest(spark, config(workspace))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, target.collect()), key=str)
    assert "## Cohorts" in pipelines.eda(target, external)
    sinks.write_manifest(target, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 14


def test_config_errors(workspace):
    with pytest.raises(ConfigError):
        files.load_config("/no/such/file.json")
    bad = {"workspace_root": str(workspace), "datasets": [{"name": "a", "dir": "tk", "id_prefix": "A", "role": "other"}]}
    with pytest.raises(ConfigError):
        files.load_config(bad)
    twice = {"workspace_root": str(workspace), "datasets": [{"name": n, "dir": "tk", "id_prefix": "A", "role": "target"} for n in "ab"]}
    with pytest.raises(ConfigError):
        files.load_config(twice)


def test_headers():
    assert files.header_stats(png(20, 16)) == (20, 16, None)
    assert files.header_stats(jpeg(40, 30)) == (40, 30, 1)
    assert files.header_stats(jpeg(40, 30, 6)) == (30, 40, 6)
    assert files.header_stats(b"nothing") is None


def test_survivor_rules(spark):
    rows = [("TK", "a/IMG_1.JPG", "m1"), ("TK", "a/b/01-01-1224.JPG", "m1"), ("LAB", "d/03.1.jpg", "m2"), ("LAB", "d/03.jpg", "m2"), ("LAB", "d/1.jpg", "m3"), ("LAB", "d/10.jpg", "m3"), ("PW", "x.jpg", "m4")]
    df = spark.createDataFrame(rows, "cohort string, rel_path string, md5 string").withColumn("notes", F.lit(""))
    for parts in (1, 5):
        out = {r["rel_path"]: r for r in dedup.deduplicate(df.repartition(parts), dedup.media_priority(), "rel_path", notes="notes").collect()}
        assert {p for p, r in out.items() if r["dup_keep"]} == {"a/b/01-01-1224.JPG", "d/03.jpg", "d/10.jpg", "x.jpg"}
        assert [out[p]["dup_group"] for p in ("a/IMG_1.JPG", "d/03.jpg", "d/1.jpg", "x.jpg")] == [0, 1, 2, -1]
        assert out["a/IMG_1.JPG"]["notes"] == "duplicate"


def test_splits_hold_and_do_not_depend_on_order(spark, sf):
    rows = Q.V.shots(spark, sf)
    a = splits.assign_splits(rows)
    b = splits.assign_splits(rows.orderBy(F.rand(3)).repartition(7))
    key = ["event_id", "split_role", "split_fold", "split_scheme", "is_new_open"]
    assert sorted(map(tuple, a.select(key).collect())) == sorted(map(tuple, b.select(key).collect()))
    external = rows.limit(0).withColumn("dup_group", F.lit(-1))
    full = a.withColumn("dup_group", F.lit(-1)).withColumn("date_source", F.lit("none"))
    assert all(n.startswith("g10") for n, _ in gates.run_gates({"target": full, "external": external}, [n for n in gates.GATES if n.startswith("g")]))


def test_gates_bite(spark, sf):
    full = splits.assign_splits(Q.V.shots(spark, sf)).withColumn("dup_group", F.lit(-1)).withColumn("date_source", F.lit("none"))
    external = full.limit(0)
    for name, change in {"g6_folds": {"split_fold": F.lit("train")}, "g7_paths": {"rel_path": F.concat(F.lit("/"), "rel_path")}, "g9_dates": {"date": F.lit("2031-01-01")}, "g11_unique_survivors": {"md5": F.lit("x")}, "g12_stage_rules": {"kpi_scope": F.lit("external")}, "g5_complete": {"split_scheme": F.lit(None).cast("string")}}.items():
        with pytest.raises(gates.GateError, match=name):
            gates.run_gates({"target": full.withColumns(change), "external": external}, [name])


def test_sealed_photos_of_open_individuals_are_seen(spark):
    rows = [("a", "TK-1", "TK", True, True, "kpi_core", "probe", "test"), ("b", "TK-2", "TK", False, False, "kpi_core", "probe", "test"), ("c", "TK-3", "TK", False, True, "kpi_core", "gallery", "train"), ("d", "LAB-1", "LAB", False, True, "temporal_aux", "probe", "test")]
    target = spark.createDataFrame(rows, "md5 string, individual_id string, cohort string, is_new_open boolean, dup_keep boolean, kpi_scope string, split_role string, split_fold string")
    crops = target.select("md5", F.lit("belly_oriented").alias("variant"), F.when(F.col("md5") == "a", "fallback").otherwise("ok").alias("crop_status"), F.lit(384).alias("canon_size"), F.lit("v1").alias("pipeline_version"))
    t = {"target": target, "external": target.limit(0), "crops": crops, "spots": crops, "embeddings": crops.withColumn("embedding", F.array(F.lit(1.0))), "config": spark.createDataFrame([(384,)], "canon_size int")}
    keys = lambda name: sorted(r["key"] for r in gates.violations(t, [name]).collect())
    assert keys("c9_sealed_crops") == keys("s7_sealed_spots") == keys("e1_embedding_audit") == ["a", "b"]
    assert len(keys("c7_fallback_budget")) == 1 and keys("c4_one_geometry") == []  # one of three core crops
    t["config"] = spark.createDataFrame([(256,)], "canon_size int")
    assert keys("c4_one_geometry") == ["canon_size 384"]
    t["external"] = spark.createDataFrame([("x", "TK-9", "GCN")], "md5 string, individual_id string, cohort string")
    assert keys("g8_one_cohort") == ["TK-9"]


def test_decisions_are_recomputed(spark):
    """A tampered decision, a missing variant and a foreign name are found."""
    crops = spark.createDataFrame([("a", "unroll_debend"), ("a", "unroll_ribbon"), ("a", "belly_oriented")], "md5 string, variant string")
    spec = "variant string, pattern_safe boolean, recall_1 double, recall_5 double, p_1 double, p_5 double"
    ab = spark.createDataFrame([("belly_oriented", True, 0.5, 0.8, 1.0, 1.0), ("unroll_debend", True, 0.55, 0.86, 1.0, 0.2), ("unroll_ribbon", True, 0.52, 0.9, 0.01, 0.01)], spec)
    say = lambda x: spark.createDataFrame([(x, "belly_oriented", 0.05, False)], "stated string, baseline string, alpha double, allow_at_1 boolean")
    keys = lambda t, n: sorted(r["key"] for r in gates.violations(t, [n]).collect())
    c8 = lambda ab, x: keys({"crops": crops, "ab_metrics": ab, "ab_decision": say(x)}, "c8_decision_stands")
    assert c8(ab, "unroll_ribbon") == [] and c8(ab, "unroll_debend") == ["recomputed unroll_ribbon"] and c8(ab, "belly_oriented") == ["recomputed unroll_ribbon"]
    assert c8(ab.where("variant <> 'unroll_debend'"), "unroll_ribbon") == ["unroll_debend"] and "raw" in c8(ab, "raw")
    assert keys({"crops": crops}, "c8_decision_stands") and keys({"crops": crops.where("variant = 'belly_oriented'")}, "c8_decision_stands") == []
    compared = spark.createDataFrame([(1, 0.2, 0.4, 1, 9, 0.02), (5, 0.5, 0.6, 2, 9, 0.07)], "k int, base double, challenger double, b long, c long, p double")
    s5 = lambda x, c: keys({"spots": crops, "matcher_compare": c, "matcher_decision": spark.createDataFrame([(x, 1)], "stated string, primary_k int")}, "s5_matcher_decision")
    assert s5("matcher", compared) == [] and s5("embedder", compared) == ["recomputed matcher"] and s5("both", compared)
    assert s5("matcher", compared.withColumn("challenger", F.lit(0.1))) == ["recomputed embedder"]


def test_stage_rules(spark, sf):
    full = splits.assign_splits(Q.V.shots(spark, sf))
    with pytest.raises(ValueError):
        splits.select_stage(full, "other")
    with pytest.raises(ValueError):
        splits.assert_unsealed(["dev", "test"], False)
    splits.assert_unsealed(["dev", "test"], True)
    with pytest.raises(ValueError):
        splits.assert_not_reported([True], False)
    assert splits.select_stage(full, "train", "kpi_core").count() == splits.select_stage(full, "train", None).count()


def test_variant_uniqueness_and_fallback(spark):
    rows = spark.createDataFrame([("a", "i"), ("b", "i"), ("c", "j")], "md5 string, individual_id string")
    crops = spark.createDataFrame([("a", "r", "ar"), ("a", "o", "ao"), ("b", "o", "bo")], "md5 string, variant string, crop_path string")
    got = {r["md5"]: r["variant_used"] for r in variants.select_with_fallback(rows, crops, "r", "o").collect()}
    assert got == {"a": "r", "b": "o", "c": None}
    with pytest.raises(Exception, match="not unique"):
        variants.select_crops(rows, crops.union(crops), "r").collect()


def test_labels_round_trip(spark, tmp_path):
    point = "struct<x:double,y:double>"
    labels = spark.createDataFrame([("a", [(0.1, 0.1), (0.5, 0.1), (0.3, 0.6)], (0.1, 0.2), (0.4, 0.5), "manual", "auto", ["f"], 0.9, 0.8, "I-1")], f"md5 string, belly_polygon array<{point}>, head_xy {point}, cloaca_xy {point}, source string, status string, flags array<string>, seg_conf double, head_conf double, individual_id string")
    sinks.write_labels(labels.drop("individual_id"), str(tmp_path / "l"))
    back = files.read_labels(spark, str(tmp_path / "l"))
    assert back.first()["flags"] == ["f"] and back.first()["source"] == "manual"
    line = sinks.yolo_lines(labels).first()
    assert line["seg"].startswith("0 0.100000 0.100000") and line["pose"].endswith(" 2")
    flipped = variants.flip_label(labels).first()
    assert flipped["head_xy"]["x"] == 0.4 and flipped["source"] == "manual"
    merged = variants.edit_label(labels, status=F.lit("skip"), flags=F.array(F.lit("f"), F.lit("g"))).first()
    assert merged["flags"] == ["f", "g"] and merged["status"] == "skip"


def test_provenance_cache(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.write_with_provenance(spark.range(3), path, {"seed": 42})
    assert sinks.read_provenance(spark, path) == {"seed": "42"} and spark.read.parquet(path).count() == 3


def test_batches(spark, sf):
    rows = Q.V.shots(spark, sf)
    plan = splits.pk_batches(rows, 4, 3)
    assert plan.groupBy("batch").count().where("count <> 12").count() == 0
    with pytest.raises(ValueError):
        splits.pk_batches(rows, 100_000, 2)
    with pytest.raises(ValueError):
        splits.folds_by_individual(rows, 1)


def test_npy_set(spark, tmp_path):
    import numpy as np

    values = np.arange(12, dtype=np.float32).reshape(3, 4)
    for name, array in {"md5": np.array(["a", "b", "c"]), "role": np.array(["probe", "gallery", "probe"]), "individual_id": np.array(["x", "y", "z"]), "cohort": np.array(["TK"] * 3), "raw": values, "belly": values + 1}.items():
        np.save(tmp_path / f"{name}.npy", array)
    rows = files.read_npy_set(spark, str(tmp_path), ["raw", "belly"])
    got = {(r["md5"], r["variant"]): r["embedding"] for r in rows.collect()}
    assert len(got) == 6 and got["b", "belly"] == [5.0, 6.0, 7.0, 8.0]
    assert files.held_out(rows).where("is_new").count() == 0 and files.held_out(rows).count() == 4
    assert files.with_crop_paths(rows, "/c/").first()["crop_path"].startswith("/c/")
    np.save(tmp_path / "raw.npy", values[:2])
    with pytest.raises(Exception, match="lengths differ"):
        files.read_npy_set(spark, str(tmp_path), ["raw"]).collect()


def test_readers_of_csv_and_reports(spark, tmp_path):
    (tmp_path / "manifest_target.csv").write_text("cohort,md5,dup_keep,is_new_open,session\nTK,a,True,,01\nTK,b,0,false,02\n")
    (tmp_path / "manifest_external.csv").write_text("cohort,md5,dup_keep,mask_empty\nGCN,c,true,false\n")
    target, external = files.read_manifests(spark, str(tmp_path))
    assert [(r["md5"], r["dup_keep"], r["is_new_open"], r["session"]) for r in target.orderBy("md5").collect()] == [("a", True, False, "01"), ("b", False, False, "02")]
    assert external.first()["mask_empty"] is False
    (tmp_path / "manifest_target.csv").write_text("cohort,md5,dup_keep\nTK,a,perhaps\n")
    with pytest.raises(Exception, match="no boolean"):
        files.read_manifests(spark, str(tmp_path))[0].collect()
    (tmp_path / "crops.csv").write_text("md5,variant,mirrored\na,full,perhaps\n")
    row = files.read_crops(spark, str(tmp_path / "crops.csv")).first()
    assert row["mirrored"] is False and row["canon_size"] is None
    (tmp_path / "spots_a.csv").write_text('md5,n_spots,spots\na,1,"[[1.5, 2.0, 9.0, 0.25]]"\n')
    assert files.read_spots(spark, str(tmp_path / "spots_*.csv")).first()["spots"][0]["score"] == 0.25
    (tmp_path / "r.json").write_text('{"overall": {"n": 3}}')
    assert files.read_headline(spark, str(tmp_path / "r.json"), "overall struct<n:int>").first()["overall"]["n"] == 3
    assert files.read_headline(spark, str(tmp_path / "none.json"), "overall struct<n:int>") is None


def test_image_reader(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(6, 4, 7))
    (tmp_path / "b.png").write_bytes(b"broken")
    got = {r["md5"]: r["image"] for r in files.read_images(spark, str(tmp_path)).collect()}
    assert (got["a"]["width"], got["a"]["height"]) == (6, 4) and got["b"] is None
