"""The commands: each builds DataFrames from operators; guards run before any plan is made."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dapple.operators import decide, dedup, fusion, gates, metrics, reports, retrieval, splits, variants
from dapple.operators.constellation import match_matrix
from dapple.operators.raster import belly_consistent, spots_of_crops
from dapple.schema import SWEEP, Config, SpotConfig
from dapple.sources import files, sinks

D_GATES = [f"g{k}" for k in range(1, 13)]
C_GATES = ["c1", "c2", "c3", "c4", "c6", "c7", "c8", "c9"]
S_GATES = ["s1", "s5", "s6", "s7"]


def names_of(prefixes: list[str]) -> list[str]:
    return [n for p in prefixes for n in gates.GATES if n.split("_")[0] == p]


def build_manifest(spark: SparkSession, cfg: Config, mode: str = "sql") -> tuple[DataFrame, DataFrame]:
    """Scan every cohort, find duplicates over all of them, merge individuals, assign splits; target and external manifest."""
    found = None
    for spec in cfg.datasets:
        rows = files.SCANS[spec.layout](spark, cfg, spec)
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    kept = dedup.deduplicate(found.drop("dup_group", "dup_keep"), dedup.media_priority(), "rel_path", notes="notes")
    if cfg.merge_individuals:
        table = F.create_map(*(F.lit(x) for pair in cfg.merge_individuals for x in pair))
        kept = kept.withColumn("individual_id", F.coalesce(table[F.col("individual_id")], F.col("individual_id")))
    base = kept.drop("kpi_scope", "split_role", "split_fold", "split_scheme", "is_new_open")
    out = splits.assign_splits(base, seed=cfg.seed, mode=mode)
    pick = lambda role, spec: out.where(F.col("role") == role).select(*((F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in files.schema(spec).fields))
    return pick("target", files.TARGET_SPEC), pick("external", files.EXTERNAL_SPEC)


def build(spark: SparkSession, cfg: Config, out: str) -> DataFrame:
    target, external = build_manifest(spark, cfg)
    sinks.write_manifest(target, f"{out}/target")
    sinks.write_manifest(external, f"{out}/external")
    return reports.cohort_counts(target, external)


def validate(target: DataFrame, external: DataFrame, files_seen: DataFrame | None = None) -> list[tuple[str, int]]:
    tables = {"target": target, "external": external} | ({"files": files_seen} if files_seen is not None else {})
    return gates.run_gates(tables, names_of(D_GATES))


def validate_crops(tables: dict[str, DataFrame], unseal: bool = False) -> list[tuple[str, int]]:
    return gates.run_gates(tables, names_of([g for g in C_GATES if not (unseal and g == "c9")]))


def validate_spots(tables: dict[str, DataFrame], unseal: bool = False) -> list[tuple[str, int]]:
    return gates.run_gates(tables, names_of([g for g in S_GATES if not (unseal and g == "s7")]))


def eda(target: DataFrame, external: DataFrame) -> str:
    """The manifest report as Markdown."""
    noted, more = reports.anomaly_log(target.unionByName(external, allowMissingColumns=True), "md5")
    parts = [
        ("Cohorts", reports.cohort_counts(target, external)), ("Photos per individual", reports.photos_per_individual(target)), ("Dates", reports.date_coverage(target).orderBy("cohort", "date")),
        ("Resolutions", reports.resolution_counts(target)), ("Duplicates", dedup.dup_report(target)), ("Splits", reports.split_summary(target)), ("Notes", noted), ("Further notes", more),
    ]
    return "\n".join(reports.markdown(df, title) for title, df in parts)


def bootstrap_pool(target: DataFrame, labels: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The pilot's rows with a manual label, and those to label."""
    return variants.reuse_labels(splits.even_spaced(target.where("dup_keep"), n), labels)


def crop_rows(target: DataFrame, external: DataFrame, stages: list[str], scope: str | None, unseal: bool = False) -> DataFrame:
    """Rows to crop of several stages, each md5 once."""
    splits.assert_unsealed(stages, unseal)
    both = target.unionByName(external, allowMissingColumns=True)
    out = None
    for i, stage in enumerate(stages):
        rows = splits.select_stage(both, stage, scope).withColumn("_ord", F.lit(i))
        out = rows if out is None else out.union(rows)
    return out.withColumn("_rn", F.row_number().over(Window.partitionBy("md5").orderBy("_ord", "rel_path"))).where("_rn = 1").drop("_rn", "_ord")


def embed_build(target: DataFrame, crops: DataFrame, variant_names: list[str], n_folds: int, stages: tuple[str, ...] = ("gallery", "dev"), unseal: bool = False) -> DataFrame:
    splits.assert_unsealed(list(stages), unseal)
    gallery, probes = (splits.select_stage(target, s) for s in stages)
    folds = splits.folds_by_individual(gallery.union(probes), n_folds)
    return variants.oof_records(gallery, probes, crops, variant_names, folds)


@dataclass
class Sides:
    """Gallery and probes: id (long), identity, cohort, session and embedding."""

    gallery: DataFrame
    probes: DataFrame

    @property
    def truth(self) -> DataFrame:
        return self.probes.select(F.col("id").alias("pid"), "identity", "cohort")

    def identity_scores(self, how: str = "max") -> DataFrame:
        return retrieval.similarities(self.probes, self.gallery, identity="identity", how=how)

    def photos(self) -> DataFrame:
        return retrieval.identity_photos(self.probes, self.gallery)

    def photo_ranks(self) -> DataFrame:
        return retrieval.photo_ranks(self.probes, self.gallery)


def hits(sides: Sides, level: str = "identity", ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    if level == "identity":
        return retrieval.identity_hits(sides.identity_scores(), sides.truth, ks)
    return retrieval.photo_hits(sides.photo_ranks(), sides.truth, ks)


def ab(base: Sides, challenger: Sides, ks: tuple[int, ...] = (1, 5), level: str = "photo", primary_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Comparison for each k, and the adopt decision."""
    a, b = hits(base, level, ks), hits(challenger, level, ks)
    pairs = a.select("pid", *(F.col(f"hit_at_{k}").alias(f"base_at_{k}") for k in ks)).join(b.select("pid", *(F.col(f"hit_at_{k}").alias(f"var_at_{k}") for k in ks)), "pid")
    compared = decide.compare(pairs, ks)
    return compared, decide.adopt_challenger(compared, primary_k)


def ab_analysis(gallery: DataFrame, probes: DataFrame, variant_names: list[str], threshold: float = 0.15, sweep: tuple[float, ...] = SWEEP, ks: tuple[int, ...] = (1, 5)) -> dict[str, DataFrame]:
    """The whole comparison of raw photos with crop variants at photo level, the first variant being the one that others are held against.

    Both sides have id, identity, cohort, seg_conf, raw and an array column for
    each variant (null: no such crop, the raw one stands in).  Returns
    ``perprobe`` (hits of every variant), ``summary`` and ``paired`` (all probes,
    and those whose identity is in the gallery), ``closed_set``, ``stats``
    (McNemar and bootstrap on the closed set: first against raw, others against
    the first) and ``sensitivity`` (recall at each confidence threshold).
    """

    def found(v: str | None, t: float) -> DataFrame:
        vector = F.col("raw") if v is None else F.coalesce(retrieval.variant_embeddings("raw", v, "seg_conf", t), "raw")
        turn = lambda df: df.withColumn("embedding", vector)
        return hits(Sides(turn(gallery), turn(probes)), "photo", ks)

    named = lambda df, v: df.select("pid", *(F.col(f"hit_at_{k}").alias(f"{v}_at_{k}") for k in ks))
    known = retrieval.in_gallery(probes, gallery).select(F.col("id").alias("pid"), F.lit(True).alias("known")).distinct()
    per = probes.select(F.col("id").alias("pid"), "identity", "cohort", "seg_conf").join(known, "pid", "left").withColumn("in_gallery", F.coalesce("known", F.lit(False))).drop("known")
    per = per.join(named(found(None, 0.0), "raw"), "pid")
    for v in variant_names:
        per = per.join(named(found(v, threshold), v), "pid")

    def summaries(rows: DataFrame) -> DataFrame:
        out = None
        for v in ["raw", *variant_names]:
            one = metrics.summarize(rows.select("cohort", *(F.col(f"{v}_at_{k}").alias(f"hit_at_{k}") for k in ks)), ks).withColumn("variant", F.lit(v))
            out = one if out is None else out.union(one)
        return out

    closed = per.where("in_gallery")
    swept = None
    for v in variant_names:
        for t in sweep:
            share = retrieval.recall(found(v, t), ks).select(F.lit(v).alias("variant"), F.lit(float(t)).alias("threshold"), *(F.round(f"recall_at_{k}", 4).alias(f"recall_at_{k}") for k in ks))
            swept = share if swept is None else swept.union(share)
    covered = per.select(F.explode(F.array(*(F.lit(float(t)) for t in sweep))).alias("threshold"), "seg_conf").groupBy("threshold").agg(F.round(F.avg((F.coalesce(F.col("seg_conf"), F.lit(-1.0)) >= F.col("threshold")).cast("double")), 3).alias("coverage"))
    against = {f"{variant_names[0]} vs raw": ("raw", variant_names[0])} | {f"{v} vs {variant_names[0]}": (variant_names[0], v) for v in variant_names[1:]}
    return {
        "perprobe": per, "summary": summaries(per), "paired": summaries(closed), "stats": decide.paired_table(closed, against, ks, "pid"), "sensitivity": swept.join(F.broadcast(covered), "threshold"),
        "closed_set": per.agg(F.count("*").alias("n_probe"), F.count_if("in_gallery").alias("n_true"), F.count_if(~F.col("in_gallery")).alias("n_excluded")),
    }


def open_set(known: Sides, new: Sides) -> tuple[DataFrame, DataFrame, DataFrame]:
    """AUROC, threshold, and policy rates at that threshold."""
    scores = retrieval.known_new_scores(known.photos()).withColumn("is_new", F.lit(False)).union(retrieval.known_new_scores(new.photos()).withColumn("is_new", F.lit(True)))
    tuned = metrics.youden(scores, "max_sim")
    return metrics.auroc(scores, "max_sim"), tuned, metrics.policy_rates(metrics.policy(scores.crossJoin(F.broadcast(tuned)), F.col("threshold")))  # tuned is one row


def embed_test(test: Sides, opened: Sides, dev: Sides, dev_open: Sides, official: int, *, unseal: bool, reported: list[bool] = (), force: bool = False, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """The sealed report; its threshold comes from the development sets alone."""
    splits.assert_unsealed(["test", "open_test"], unseal)
    splits.assert_not_reported(list(reported), force)
    threshold = open_set(dev, dev_open)[1].first()["threshold"]
    found = hits(test, "identity", ks)
    known = retrieval.in_gallery(test.probes, test.gallery).select(F.col("id").alias("pid"), F.lit(True).alias("k")).distinct()
    flagged = found.join(known, "pid", "left").withColumn("known", F.coalesce("k", F.lit(False))).join(test.truth.select("pid", "cohort"), "pid")
    scores = retrieval.known_new_scores(test.photos()).withColumn("is_new", F.lit(False)).union(retrieval.known_new_scores(opened.photos()).withColumn("is_new", F.lit(True)))
    return metrics.sealed_report(flagged, "known", scores, threshold, official, ks)


def hybrid(embed_scores: DataFrame, match_scores: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5), provenance: tuple[dict, dict] | None = None) -> DataFrame:
    """The fusion grid over embedder and matcher scores of one provenance."""
    if provenance:
        fusion.check_provenance(*provenance)
    scores = embed_scores.withColumnRenamed("sim", "es").join(match_scores.withColumnRenamed("sim", "ms"), ["pid", "identity"], "left").na.fill(0.0, ["ms"])
    return fusion.fuse_grid(scores, truth, ks)


def hybrid_stats(fused: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Paired statistics of a fusion against the embedder alone on the same probes, for each k."""
    return decide.paired_table(fusion.fuse_hits(fused, truth, ks), {"hybrid vs embedder": ("embed", "hybrid")}, ks, "pid")


def match(probes: DataFrame, gallery: DataFrame, k: int = 5, cfg: SpotConfig = SpotConfig(), shortlist: DataFrame | None = None) -> DataFrame:
    """The k best gallery photos of each probe by constellation; photos, not individuals.

    Every gallery photo is tried, unless a ``shortlist`` (pid, gid) from the embedder says which.
    """
    scores = match_matrix(probes, gallery, cfg, shortlist, pairs=False).drop("n")
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("score"), "gid"))).where(F.col("rank") <= k)


def identify(probes: DataFrame, gallery: DataFrame, k: int = 7, band: tuple[float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranked individuals with confidence, and the verdict, for each probe. ``band``: the confidence range, else the gallery's."""
    sides = Sides(gallery, probes)
    lo, hi = band or metrics.gallery_calibration(gallery).first()
    ranked = retrieval.rank_individuals(sides.photos(), k, F.lit(lo), F.lit(hi))
    return ranked, retrieval.verdict(ranked, probes.select(F.col("id").alias("pid")))


def export(labels: DataFrame, val_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Training lines of usable labels whose axis lies in their belly."""
    return sinks.yolo_lines(belly_consistent(labels).where("consistent"), val_frac, seed)


def detect_spots(rows: DataFrame, crops: DataFrame, images: DataFrame, stage: str, *, scope: str | None = "kpi_core", variant: str = "unroll_debend", fallback: str = "belly_oriented", cfg: SpotConfig = SpotConfig(), unseal: bool = False) -> DataFrame:
    """Spots of a stage's crops (variant, else fallback); rows without a readable crop are left out."""
    splits.assert_unsealed([stage], unseal)
    chosen = variants.select_with_fallback(splits.select_stage(rows, stage, scope), crops, variant, fallback).where("variant_used IS NOT NULL")
    found = spots_of_crops(chosen.select("md5").join(images, "md5"), cfg)
    who = rows.select("md5", "individual_id", "cohort", "split_fold").dropDuplicates(["md5"])
    kept = found.join(who, "md5").join(chosen.select("md5", F.col("variant_used").alias("detect_variant")), "md5")
    return kept.withColumns({"detect_method": F.lit(cfg.detect_method), "illum_norm": F.lit("clahe" if cfg.illum_norm else "off"), "stage": F.lit(stage)})


def spot_ab(sides: Sides, embed_scores: DataFrame, match_scores: DataFrame, ks: tuple[int, ...] = (1, 5)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matcher against embedder at identity level: comparison, decision (at k = 1) and per-probe audit."""
    a, b = (retrieval.identity_hits(s, sides.truth, ks) for s in (embed_scores, match_scores))
    pairs = a.select("pid", *(F.col(f"hit_at_{k}").alias(f"base_at_{k}") for k in ks)).join(b.select("pid", *(F.col(f"hit_at_{k}").alias(f"var_at_{k}") for k in ks)), "pid")
    compared = decide.compare(pairs, ks)
    return compared, decide.adopt_challenger(compared, ks[0]), retrieval.detailed_pair(embed_scores, match_scores, sides.truth)


def finetuned_ab(zero_shot: dict[str, Sides], finetuned: dict[str, Sides], baseline: str, safe: list[str], ks: tuple[int, ...] = (1, 5)) -> tuple[dict[str, DataFrame], DataFrame]:
    """For each variant the fine-tuned model against the zero-shot one (photo level), and which variant of the fine-tuned model to use."""
    compared = {v: ab(zero_shot[v], finetuned[v], ks)[0] for v in finetuned if v in zero_shot}
    rows = None
    for v, sides in finetuned.items():
        c = ab(finetuned[baseline], sides, ks)[0]
        at = lambda k, n: F.max(F.when(F.col("k") == k, F.col(n)))
        row = c.agg(at(ks[0], "challenger").alias("recall_1"), at(ks[-1], "challenger").alias("recall_5"), at(ks[0], "p").alias("p_1"), at(ks[-1], "p").alias("p_5")).withColumns({"variant": F.lit(v), "pattern_safe": F.lit(v in safe)})
        rows = row if rows is None else rows.union(row)
    return compared, decide.adopt_variant(rows, baseline)


def embed_verify(embeddings: DataFrame, target: DataFrame, stated: DataFrame, sides: Sides, ks: tuple[int, ...] = (1, 5), tolerance: float = 1e-4) -> DataFrame:
    """The audit of an embedding set: stated recall (k, recall) against its recomputation, and the embedding gate."""
    now = retrieval.recall(hits(sides, "photo", ks), ks)
    found = now.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"recall_at_{k}").alias("found")) for k in ks))).alias("r")).select("r.*")
    checks = stated.join(found, "k", "left").select(F.concat(F.lit("recall_at_"), F.col("k").cast("string")).alias("name"), F.col("recall").alias("expected"), "found", F.lit(tolerance).alias("tolerance"))
    faults = gates.violations({"embeddings": embeddings, "target": target}, ["e1_embedding_audit"]).agg(F.count("*").cast("double").alias("found"))
    more = faults.select(F.lit("embedding_gate").alias("name"), F.lit(0.0).alias("expected"), "found", F.lit(0.0).alias("tolerance"))
    return decide.audit(checks.union(more))


def embed_pack(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.pack_manifest(spark, folder)
