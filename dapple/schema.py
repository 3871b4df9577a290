"""Table schemas, enumerations and defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import types as T

# Enumerations of the data model.
ROLES = ("gallery", "probe")
FOLDS = ("train", "dev", "test")
SCHEMES = ("temporal", "random", "gallery_only", "external", "open_new")
SCOPES = ("kpi_core", "temporal_aux", "external")
DATE_SOURCES = ("filename", "subfolder", "none", "unparsed")
CROP_STATUS = ("ok", "empty_mask", "low_seg_conf", "tiny_mask", "no_pose", "low_pose_conf", "clipped_after_rotation")
STRAIGHTEN_STATUS = ("ok", "no_mask", "no_axis", "axis_too_short", "degenerate_centerline", "bad_method")
STAGES = ("train", "gallery", "dev", "test", "open_dev", "open_test", "pretrain")
SEALED = ("test", "open_test")
# Defaults that change results.
SEED, TEST_FRAC, OPEN_NEW_FRAC = 42, 0.5, 0.15
FIRST_YEAR, LAST_YEAR = 2023, 2026
EXPECTED_DIMS = {"TK": (3024, 4032), "PW": (3024, 4032), "LAB": (3000, 4000)}
KS, ALPHA, SWEEP = (1, 5), 0.05, (0.15, 0.20, 0.25, 0.30, 0.35)
PIPELINE_VARIANTS = ("belly_oriented", "belly_mask", "full", "unroll_debend", "unroll_ribbon", "unroll_wnorm")


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


_COMMON = "cohort string, species string, role string, kpi_scope string, individual_id string, local_id string, rel_path string, md5 string, width int, height int, orientation int, date string, date_source string, session string, shot int"
TARGET_SPEC = _COMMON + ", dup_group int, dup_keep boolean, split_role string, split_fold string, split_scheme string, is_new_open boolean, notes string"
EXTERNAL_SPEC = "cohort string, species string, role string, kpi_scope string, individual_id string, local_id string, rel_path string, md5 string, width int, height int, orientation int, recapture_id string, survey string, bbox string, rle_h int, rle_w int, mask_empty boolean, dup_group int, dup_keep boolean, notes string"
CROPS_SPEC = "md5 string, variant string, crop_status string, crop_path string, head_x double, head_y double, cloaca_x double, cloaca_y double, axis_ax double, axis_ay double, axis_bx double, axis_by double, orientation_deg double, head_up_conf double, seg_conf double, canon_size int, mirrored boolean, pipeline_version string, unroll_method string"
SPOT = "struct<x:double,y:double,area:double,score:double>"
SPOTS_SPEC = f"md5 string, individual_id string, cohort string, split_fold string, n_spots int, spots array<{SPOT}>, detect_variant string, detect_method string, illum_norm string, stage string"
OOF_SPEC = "md5 string, role string, individual_id string, cohort string, session string, variant string, embedding array<float>"
LABEL_SPEC = "md5 string, belly_polygon array<struct<x:double,y:double>>, head_xy struct<x:double,y:double>, cloaca_xy struct<x:double,y:double>, source string, status string, flags array<string>, seg_conf double, head_conf double"


def schema(spec: str) -> T.StructType:
    """The StructType of one of the specs above (needs an active session)."""
    return _struct(spec)


class ConfigError(ValueError):
    """A configuration that cannot be used."""


def from_mapping(kind: type, values: dict[str, Any] | None):
    """A config of ``kind``; unknown keys are ignored and lists become tuples."""
    known = {f.name for f in fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in (values or {}).items() if k in known})


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    dir: str
    species: str
    id_prefix: str
    role: str
    layout: str = ""
    skip_dirs: tuple[str, ...] = ()
    extra: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Config:
    workspace_root: str
    seed: int
    image_extensions: tuple[str, ...]
    datasets: tuple[DatasetSpec, ...]
    merge_individuals: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class CropConfig:
    canon_size: int = 384
    margin: float = 0.06
    seg_conf_min: float = 0.35
    pose_conf_min: float = 0.30
    min_area_frac: float = 0.01
    background: str = "black"
    unroll_poly: int = 3
    unroll_min_rows: int = 24
    unroll_max_shift: float = 0.45
    pattern_tol: float = 0.04
    clip_tol: float = 0.02
    unroll_methods: tuple[str, ...] = ("debend", "ribbon", "wnorm")


@dataclass(frozen=True)
class EmbedConfig:
    n_folds: int = 5
    p: int = 8
    k: int = 4
    ks: tuple[int, ...] = KS
    margin_min: float = 0.0
    seed: int = SEED


@dataclass(frozen=True)
class SpotConfig:
    detect_method: str = "deviation"
    k_mad: float = 4.0
    darkness: float = 0.62
    erode_px: int = 4
    min_area: int = 6
    min_score: float = 0.0
    top_n: int = 20
    select_by: str = "salience"
    illum_norm: bool = False
    clahe_clip: float = 2.0
    clahe_grid: int = 8
    log_min_sigma: float = 2.0
    log_max_sigma: float = 8.0
    log_num_sigma: int = 5
    log_threshold: float = 0.05
    matcher: str = "guided"
    descriptor_knn: int = 5
    match_knn: int = 4
    inlier_tol: float = 0.08
    min_inliers: int = 3
    min_spots: int = 3
    ransac_iters: int = 500
    score_norm: str = "max"
