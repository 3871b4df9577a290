"""Leakage-free gallery/probe roles, folds and open-set individuals, and the selection of rows by stage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dapple.functions.hashing import coin, fold_coin, hex_key
from dapple.schema import OPEN_NEW_FRAC, SEALED, SEED, STAGES, TEST_FRAC


def kpi_scope(cohort: Column, role: Column) -> Column:
    return F.when(role == "external", "external").when(cohort.isin("TK", "PW"), "kpi_core").when(cohort == "LAB", "temporal_aux")


def dates_of(rows: DataFrame) -> DataFrame:
    """individual_id, cohort, n_dates, first_date, n_photos."""
    return rows.groupBy("individual_id", "cohort").agg(F.count_distinct("date").alias("n_dates"), F.min("date").alias("first_date"), F.count("*").alias("n_photos"))


def select_fraction(people: DataFrame, frac: float, salt: str, mode: str = "sql") -> DataFrame:
    """The first ceil(frac * n) individuals of each cohort by hash of ``salt:id``."""
    keyed = people.withColumn("hash_key", hex_key(F.concat(F.lit(salt + ":"), F.col("individual_id")), mode))
    w = Window.partitionBy("cohort")
    ranked = keyed.withColumn("rn", F.row_number().over(w.orderBy("hash_key", "individual_id"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("rn") <= F.ceil(F.lit(frac) * F.col("n"))).select("individual_id", "cohort")


def open_new(rows: DataFrame, frac: float = OPEN_NEW_FRAC, seed: int = SEED, mode: str = "sql") -> DataFrame:
    """Individuals without dates to split by that are held out as new."""
    return select_fraction(dates_of(rows).where("n_dates < 2").select("individual_id", "cohort"), frac, f"{seed}-open", mode)


def random_probe(rows: DataFrame, seed: int = SEED, mode: str = "sql") -> DataFrame:
    """individual_id and the rel_path of its probe: of the least frequent session (ties: the smaller name), else of all photos."""
    per_session = rows.groupBy("individual_id", "session").agg(F.count("*").alias("k"))
    w = Window.partitionBy("individual_id")
    least = per_session.where("session IS NOT NULL").withColumn("rn", F.row_number().over(w.orderBy("k", "session"))).withColumn("n", F.count("*").over(w)).where("rn = 1 AND n >= 2")
    pool = rows.join(least.select("individual_id", F.col("session").alias("least_session")), "individual_id", "left")
    pool = pool.where(F.col("least_session").isNull() | (F.col("session") == F.col("least_session")))
    ranked = pool.withColumn("rn", F.row_number().over(w.orderBy("rel_path", "md5"))).withColumn("n", F.count("*").over(w))
    pick = F.floor(coin(F.concat(F.lit(f"{seed}-probe:"), F.col("individual_id")), mode) * F.col("n")) + 1
    return ranked.where(F.col("rn") == pick).select("individual_id", F.col("rel_path").alias("probe_path"), F.col("md5").alias("probe_md5"))


def assign_splits(rows: DataFrame, test_frac: float = TEST_FRAC, open_frac: float = OPEN_NEW_FRAC, seed: int = SEED, mode: str = "sql") -> DataFrame:
    """Adds kpi_scope, split_role, split_fold, split_scheme and is_new_open.

    Duplicates that were dropped keep null split columns; external rows have
    scheme external.  An individual is, in this order, open_new (all photos
    probes), temporal (two dates or more: the first date and undated photos are
    gallery), random (two photos or more: one probe), or gallery_only.
    """
    rows = rows.withColumn("kpi_scope", kpi_scope(F.col("cohort"), F.col("role")))
    work = rows.where((F.col("role") == "target") & F.col("dup_keep"))
    people = dates_of(work)
    opened = open_new(work, open_frac, seed, mode).select("individual_id", "cohort", F.lit(True).alias("is_open"))
    chance = work.join(people.where("n_dates < 2 AND n_photos >= 2").select("individual_id"), "individual_id", "left_semi")
    probes = random_probe(chance, seed, mode)
    info = people.join(opened, ["individual_id", "cohort"], "left").select("individual_id", "cohort", "n_dates", "first_date", "n_photos", F.coalesce("is_open", F.lit(False)).alias("is_open"))
    placed = rows.join(info, ["individual_id", "cohort"], "left").join(probes, "individual_id", "left")
    live = (F.col("role") == "target") & F.coalesce(F.col("dup_keep"), F.lit(False))
    scheme = F.when(F.col("is_open"), "open_new").when(F.col("n_dates") >= 2, "temporal").when(F.col("n_photos") >= 2, "random").otherwise("gallery_only")
    scheme = F.when(F.col("role") == "external", "external").when(live, scheme)
    later = F.col("date").isNotNull() & (F.col("date") > F.col("first_date"))
    is_probe = F.when(scheme == "open_new", True).when(scheme == "temporal", later).when(scheme == "random", (F.col("rel_path") == F.col("probe_path")) & (F.col("md5") == F.col("probe_md5"))).otherwise(False)
    role = F.when(live, F.when(is_probe, "probe").otherwise("gallery"))
    fold = F.when(live, F.when(is_probe, fold_coin(F.col("rel_path"), test_frac, seed, mode)).otherwise("train"))
    out = placed.select(*rows.columns, role.alias("split_role"), fold.alias("split_fold"), scheme.alias("split_scheme"), F.when(live, F.col("is_open")).otherwise(False).alias("is_new_open"))
    return out


def in_scope(scope: str | None) -> Column:
    return F.lit(True) if scope in (None, "all_target") else F.col("kpi_scope") == scope


def select_stage(rows: DataFrame, stage: str, scope: str | None = "kpi_core") -> DataFrame:
    """The rows of a stage; the one place that decides which rows a step may see.

    train and the open stages ignore ``scope``; every stage but pretrain starts
    from kept target rows.
    """
    kept = F.coalesce(F.col("dup_keep"), F.lit(False))
    opened = F.coalesce(F.col("is_new_open"), F.lit(False))
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    if stage == "pretrain":
        return rows.where((F.col("role") == "external") & kept)
    base = rows.where((F.col("role") == "target") & kept)
    if stage == "train":
        return base.where("split_fold = 'train'")
    if stage == "gallery":
        return base.where((F.col("split_role") == "gallery") & ~opened & in_scope(scope))
    if stage in ("dev", "test"):
        return base.where((F.col("split_role") == "probe") & ~opened & in_scope(scope) & (F.col("split_fold") == stage))
    return base.where(opened & (F.col("split_fold") == stage.removeprefix("open_")))


def assert_unsealed(stages: list[str], unseal: bool) -> None:
    """Raises before any work if a sealed stage is asked for without ``unseal``."""
    sealed = sorted(set(stages) & set(SEALED))
    if sealed and not unseal:
        raise ValueError(f"sealed stages {', '.join(sealed)} need unseal")


def assert_not_reported(exists: list[bool], force: bool) -> None:
    """Raises if a sealed report was already written, unless forced."""
    if any(exists) and not force:
        raise ValueError("the sealed test has been reported; it is not run again without force")


def even_spaced(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows of each cohort, evenly spaced by rank of md5."""
    w = Window.partitionBy("cohort")
    ranked = rows.withColumn("i", F.row_number().over(w.orderBy("md5")) - 1).withColumn("total", F.count("*").over(w))
    m = F.least(F.lit(n), F.col("total"))
    # the i-th point of linspace(0, total - 1, m), rounded half to even; a rank is taken if some point rounds to it
    step = (F.col("total") - 1) / F.greatest(m - 1, F.lit(1))
    points = F.transform(F.sequence(F.lit(0), (m - 1).cast("int")), lambda k: F.bround(k * step).cast("int"))
    return ranked.where(F.array_contains(points, F.col("i"))).drop("i", "total")


def folds_by_individual(rows: DataFrame, n_folds: int, seed: int = SEED) -> DataFrame:
    """individual_id and fold, round robin over individuals in hash order."""
    people = rows.select("individual_id").distinct()
    count = people.count()
    if not 2 <= n_folds <= count:
        raise ValueError(f"n_folds must lie in [2, {count}]")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("individual_id")))
    return people.withColumn("fold", (F.row_number().over(Window.orderBy(key, "individual_id")) - 1) % n_folds)


def label_encode(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column and their dense index in order."""
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias(column)).distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)


def pk_batches(rows: DataFrame, p: int, k: int, epoch: int = 0, seed: int = SEED, session: str | None = None) -> DataFrame:
    """A plan of P x K batches: batch, slot_p, slot_k, individual_id, md5.

    Individuals are dealt to batches in hash order (an incomplete last batch is
    left out).  Each gives K photos in hash order, taken again from the first
    when it has fewer; with ``session`` one photo of each session comes before
    second ones.
    """
    salt = f"{seed}-{epoch}:"
    people = rows.select("individual_id").distinct()
    total = people.count()
    if p > total:
        raise ValueError(f"P={p} exceeds {total} individuals")
    key = F.md5(F.concat(F.lit(salt), F.col("individual_id")))
    dealt = people.withColumn("i", F.row_number().over(Window.orderBy(key, "individual_id")) - 1).where(F.col("i") < (total // p) * p)
    photo_key = F.md5(F.concat(F.lit(salt), F.col("md5")))
    w = Window.partitionBy("individual_id")
    photos = rows.select("individual_id", "md5", *([session] if session else [])).withColumn("pk", photo_key)
    if session:
        photos = photos.withColumn("turn", F.row_number().over(Window.partitionBy("individual_id", session).orderBy("pk", "md5"))).withColumn("sk", F.md5(F.concat(F.lit(salt), F.coalesce(F.col(session).cast("string"), F.lit("")))))
        order = ["turn", "sk", "pk", "md5"]
    else:
        order = ["pk", "md5"]
    photos = photos.withColumn("j", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w)).where(F.col("j") < k)
    slots = photos.withColumn("slot_k", F.explode(F.expr(f"sequence(j, {k} - 1, cast(least(n, {k}) as int))")))
    out = slots.join(dealt, "individual_id")
    return out.select(F.floor(F.col("i") / p).cast("int").alias("batch"), (F.col("i") % p).cast("int").alias("slot_p"), F.col("slot_k").cast("int").alias("slot_k"), "individual_id", "md5")


def ceil_share(frac: float, n: int) -> int:
    return math.ceil(frac * n)
