"""The engine's own queries: one for each operator or family, with the SQL that must give the same rows."""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple import views as V
from dapple.functions import geometry, hashing, parse, stats
from dapple.operators import constellation, decide, dedup, fusion, gates, metrics, models, raster, reports, retrieval, splits, variants
from dapple.plans import pipelines
from dapple.schema import LABEL_SPEC, OOF_SPEC, SWEEP, TARGET_SPEC, Config, DatasetSpec, SpotConfig, schema
from dapple.session import put, shared_folder, ship
from dapple.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


HITS = "bool_or(rk <= 1 AND gind = pind) AS hit_at_1, bool_or(rk <= 5 AND gind = pind) AS hit_at_5"
#: Identity ranks of every probe, and hits.
IDN = f"""{V.sims_sql()},
idn AS (SELECT pid, pind, cohort, gind, max(sim) AS sim FROM sims GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, gind) AS rk FROM idn),
hits AS (SELECT pid, any_value(pind) AS pind, any_value(cohort) AS cohort, {HITS} FROM ranked GROUP BY pid)"""


# --- retrieval ---------------------------------------------------------------


@query(f"WITH {V.PHOTOS}, {V.sims_sql()}, ranked AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, gid) AS rk FROM sims) SELECT pid, {HITS} FROM ranked GROUP BY pid")
def photo_topk_hits(spark, d):
    return pipelines.hits(V.sides(spark, d), "photo").select("pid", "hit_at_1", "hit_at_5")


@query(f"WITH {V.PHOTOS}, {IDN} SELECT pid, hit_at_1, hit_at_5 FROM hits")
def identity_topk_hits(spark, d):
    return pipelines.hits(V.sides(spark, d)).select("pid", "hit_at_1", "hit_at_5")


@query(f"WITH {V.PHOTOS}, {V.sims_sql()} SELECT pid, gind AS identity, round(avg(sim), 6) AS score FROM sims GROUP BY ALL")
def identity_scores_mean(spark, d):
    return V.sides(spark, d).identity_scores("mean").select("pid", "identity", F.round("sim", 6).alias("score"))


def _wilson_sql(k: int) -> str:
    h, n, z = f"sum(CAST(hit_at_{k} AS INT))", "CAST(count(*) AS DOUBLE)", 1.96
    half = f"{z} * sqrt({h} / {n} * (1 - {h} / {n}) / {n} + {z * z} / (4 * {n} * {n}))"
    centre = f"({h} / {n} + {z * z} / (2 * {n}))"
    return f"round(greatest(0, ({centre} - {half}) / (1 + {z * z} / {n})), 4) AS lo_{k}, round(least(1, ({centre} + {half}) / (1 + {z * z} / {n})), 4) AS hi_{k}"


_RECALL = ", ".join(f"round(avg(CAST(hit_at_{k} AS DOUBLE)), 6) AS recall_at_{k}" for k in (1, 5))


@query(
    f"WITH {V.PHOTOS}, {IDN} SELECT 'overall' AS slice, count(*) AS n, {_RECALL}, {_wilson_sql(1)}, {_wilson_sql(5)} FROM hits "
    f"UNION ALL SELECT cohort, count(*), {_RECALL}, NULL, NULL, NULL, NULL FROM hits GROUP BY cohort"
)
def recall_grouping_sets(spark, d):
    s = V.sides(spark, d)
    return metrics.summarize(pipelines.hits(s).join(s.truth.select("pid", "cohort"), "pid"))


OPEN_SIMS = V.sims_sql(gallery_where="label <> 9")


@query(
    f"""WITH {V.PHOTOS}, {OPEN_SIMS}, idn AS (SELECT pid, pind, gind, max(sim) AS sim FROM sims GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, gind) AS rk FROM idn), hits AS (SELECT pid, any_value(pind) AS pind, {HITS} FROM ranked GROUP BY pid),
k AS (SELECT *, pind IN (SELECT gind FROM idn) AS known FROM hits)
SELECT count(*) AS n_probe, count_if(known) AS n_closed, count_if(NOT known) AS n_excluded,
{', '.join(f"round(count_if(hit_at_{k} AND known) / CAST(count_if(known) AS DOUBLE), 6) AS closed_at_{k}, round(count_if(hit_at_{k} AND known) / CAST(count(*) + 3 AS DOUBLE), 6) AS pipeline_at_{k}" for k in (1, 5))} FROM k"""
)
def recall_split_coverage(spark, d):
    s = V.sides(spark, d, gallery_where="label <> 9")
    found = retrieval.in_gallery(s.probes, s.gallery).select(F.col("id").alias("pid"), F.lit(True).alias("k"))
    hits = pipelines.hits(s).join(found, "pid", "left").withColumn("known", F.coalesce("k", F.lit(False)))
    return metrics.recall_split(hits, "known", hits.count() + 3)


KNOWN_NEW = f"""{OPEN_SIMS}, top AS (SELECT pid, any_value(label = 9) AS is_new, max(sim) AS max_sim, arg_max(gind, sim) AS pred_id FROM sims GROUP BY pid),
scores AS (SELECT t.pid, t.is_new, t.max_sim, t.pred_id, coalesce(any_value(t.max_sim) - max(s.sim) FILTER (WHERE s.gind <> t.pred_id), 0) AS margin FROM top t JOIN sims s ON t.pid = s.pid GROUP BY t.pid, t.is_new, t.max_sim, t.pred_id)"""


def _open_scores(spark, d) -> DataFrame:
    s = V.sides(spark, d, gallery_where="label <> 9")
    return retrieval.known_new_scores(s.photos()).join(s.probes.select(F.col("id").alias("pid"), (F.col("label") == 9).alias("is_new")), "pid")


@query(f"WITH {V.PHOTOS}, {KNOWN_NEW} SELECT pid, is_new, round(max_sim, 6) AS max_sim, pred_id, round(margin, 6) AS margin FROM scores")
def known_new_scores(spark, d):
    return _open_scores(spark, d).select("pid", "is_new", "pred_id", *r6("max_sim", "margin"))


@query(
    f"""WITH {V.PHOTOS}, {KNOWN_NEW} SELECT count(*) FILTER (WHERE NOT is_new) AS n_known, count(*) FILTER (WHERE is_new) AS n_new,
round((SELECT avg(CASE WHEN a.max_sim > b.max_sim THEN 1.0 WHEN a.max_sim = b.max_sim THEN 0.5 ELSE 0.0 END) FROM scores a, scores b WHERE NOT a.is_new AND b.is_new), 6) AS auroc FROM scores"""
)
def open_set_auroc(spark, d):
    return metrics.auroc(_open_scores(spark, d), "max_sim").select("n_known", "n_new", *r6("auroc"))


YOUDEN = """per AS (SELECT score, sum(CAST(NOT is_new AS INT)) AS k, sum(CAST(is_new AS INT)) AS w FROM openset GROUP BY score),
run AS (SELECT *, sum(k) OVER down AS tp, sum(w) OVER down AS fp, lead(k) OVER down AS nk, lead(w) OVER down AS nw FROM per WINDOW down AS (ORDER BY score DESC)),
tot AS (SELECT sum(k) AS pos, sum(w) AS neg FROM per),
tuned AS (SELECT score AS threshold, round(tp / CAST(pos AS DOUBLE) - fp / CAST(neg AS DOUBLE), 12) AS j FROM run, tot WHERE coalesce(k * nw <> w * nk, true) ORDER BY j DESC, score DESC LIMIT 1)"""


@query(f"WITH openset AS (SELECT value AS score, event_type IN ('error', 'purchase') OR user_id % 7 = 0 AS is_new FROM events WHERE value IS NOT NULL), {YOUDEN} SELECT round(threshold, 6) AS threshold, round(j, 6) AS j FROM tuned")
def youden_threshold(spark, d):
    e = V.table(spark, d, "events").where("value IS NOT NULL")
    scores = e.select(F.col("value").alias("score"), (F.col("event_type").isin("error", "purchase") | (F.col("user_id") % 7 == 0)).alias("is_new"))
    return metrics.youden(scores).select(*r6("threshold", "j"))


@query(
    f"""WITH {V.PHOTOS}, {KNOWN_NEW} SELECT round(avg(CAST(max_sim >= 0.35 AND margin >= 0.01 AS DOUBLE)) FILTER (WHERE NOT is_new), 6) AS known_kept,
round(avg(CAST(max_sim >= 0.35 AND margin >= 0.01 AS DOUBLE)) FILTER (WHERE is_new), 6) AS new_falsely_known FROM scores"""
)
def policy_rates(spark, d):
    return metrics.policy_rates(metrics.policy(_open_scores(spark, d), F.lit(0.35), 0.01))


_PAIRS = "pairs AS (SELECT round(list_dot_product(a.e, b.e), 9) AS sim, a.identity = b.identity AS same FROM photos a JOIN photos b ON a.id < b.id WHERE a.role = 'gallery' AND b.role = 'gallery')"
BAND = f"""{_PAIRS}, c AS (SELECT count_if(same) AS g, count_if(NOT same) AS i, quantile_cont(sim, 0.95) FILTER (WHERE NOT same) AS pi, quantile_cont(sim, 0.90) FILTER (WHERE same) AS pg,
  quantile_cont(sim, 0.75) AS p75, quantile_cont(sim, 0.995) AS p995 FROM pairs),
b AS (SELECT CASE WHEN g >= 5 AND i >= 5 THEN pi ELSE p75 END AS lo, CASE WHEN g >= 5 AND i >= 5 THEN pg ELSE p995 END AS hi0 FROM c), band AS (SELECT lo, CASE WHEN hi0 <= lo THEN lo + 1e-3 ELSE hi0 END AS hi FROM b)"""


@query(f"WITH {V.PHOTOS}, {BAND} SELECT round(lo, 6) AS lo, round(hi, 6) AS hi FROM band")
def calibration_range(spark, d):
    return metrics.gallery_calibration(V.sides(spark, d).gallery).select(*r6("lo", "hi"))


INDIVIDUALS = f"""{V.sims_sql()}, per AS (SELECT pid, gind AS identity, max(sim) AS sim, count(*) AS n_photos, arg_max(gid, (sim, -gid)) AS best_photo FROM sims GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, identity) AS rank FROM per),
ranked AS (SELECT *, round(least(99.0, 100 * least(greatest((sim - 0.15) / (0.55 - 0.15), 0.0), 1.0)), 1) AS confidence FROM rk WHERE rank <= 7)"""


@query(f"WITH {V.PHOTOS}, {INDIVIDUALS} SELECT pid, identity, rank, confidence, best_photo, n_photos FROM ranked")
def rank_individuals(spark, d):
    ranked = retrieval.rank_individuals(V.sides(spark, d).photos(), 7, F.lit(0.15), F.lit(0.55))
    return ranked.select("pid", "identity", "rank", "confidence", "best_photo", "n_photos")


@query(
    f"""WITH {V.PHOTOS}, {INDIVIDUALS}, t AS (SELECT pid, max(confidence) FILTER (WHERE rank = 1) AS top1, coalesce(max(confidence) FILTER (WHERE rank = 2), 0) AS top2 FROM ranked GROUP BY pid)
SELECT pid, top1, top2, CASE WHEN top1 >= 70 AND round(top1 - top2, 6) >= 8 THEN 'known' ELSE 'new_candidate' END AS verdict FROM t"""
)
def verdict(spark, d):
    s = V.sides(spark, d)
    return retrieval.verdict(retrieval.rank_individuals(s.photos(), 7, F.lit(0.15), F.lit(0.55)), s.truth)


@query(
    f"""WITH {V.PHOTOS}, {V.sims_sql()}, ph AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, gid) AS prk FROM sims),
idn AS (SELECT pid, pind, gind, max(sim) AS sim FROM sims GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, gind) AS irk FROM idn),
a AS (SELECT pid, any_value(pind) AS identity, coalesce(min(prk) FILTER (WHERE gind = pind), -1) AS photo_rank, count_if(gind = pind) AS n_true, max(sim) FILTER (WHERE gind = pind) AS max_true, max(sim) FILTER (WHERE gind <> pind) AS best_wrong FROM ph GROUP BY pid),
b AS (SELECT pid, coalesce(max(irk) FILTER (WHERE gind = pind), -1) AS identity_rank, string_agg(gind, ',' ORDER BY irk) FILTER (WHERE irk <= 5) AS top5, coalesce(max(sim) FILTER (WHERE irk = 1) - max(sim) FILTER (WHERE irk = 2), 0) AS id_margin FROM rk GROUP BY pid)
SELECT pid, identity, photo_rank, n_true, round(max_true, 6) AS max_true, round(best_wrong, 6) AS best_wrong, identity_rank, top5, round(id_margin, 6) AS id_margin FROM a JOIN b USING (pid)"""
)
def detailed_audit(spark, d):
    s = V.sides(spark, d)
    out = retrieval.detailed(s.photos(), s.photo_ranks(), s.truth.select("pid", "identity"))
    return out.select("pid", "identity", "photo_rank", "n_true", "identity_rank", "top5", *r6("max_true", "best_wrong", "id_margin"))


@query(f"WITH {V.PHOTOS}, {V.sims_sql()} SELECT gid, round(sim, 6) AS score FROM sims WHERE pid = 0 ORDER BY sim DESC, gid LIMIT 5")
def match_top_photos(spark, d):
    return retrieval.top_photos(V.sides(spark, d).probes, V.sides(spark, d).gallery, 0, 5).select("gid", F.round("sim", 6).alias("score"))


# --- fusion and decisions -------------------------------------------------------


def _two_signals(spark, d) -> tuple[DataFrame, DataFrame]:
    e, m = V.sides(spark, d, (1, 32)), V.sides(spark, d, (33, 32))
    scores = e.identity_scores().withColumnRenamed("sim", "es").join(m.identity_scores().withColumnRenamed("sim", "ms"), ["pid", "identity"])
    return scores, e.truth


TWO = f"""{V.sims_sql('es', name='se')}, {V.sims_sql('ms', name='sm')},
a AS (SELECT pid, pind, cohort, gind, max(sim) AS es FROM se GROUP BY ALL), b AS (SELECT pid, gind, max(sim) AS ms FROM sm GROUP BY ALL),
r AS (SELECT a.*, b.ms, row_number() OVER (PARTITION BY pid ORDER BY es DESC, gind) AS er FROM a JOIN b USING (pid, gind))"""


def fused_sql(k: int, method: str, alpha: float = 0.5, name: str = "f") -> str:
    if method == "rerank":
        key = "ms"
        z = f"{name}z AS (SELECT *, CAST(er > {k} AS INT) AS tail, ms AS key FROM r)"
    else:
        part = "PARTITION BY pid, CAST(er > {k} AS INT)".format(k=k)
        zc = lambda c: f"CASE WHEN stddev_pop({c}) OVER ({part}) > 1e-9 THEN ({c} - avg({c}) OVER ({part})) / stddev_pop({c}) OVER ({part}) ELSE 0 END"
        z = f"{name}z AS (SELECT *, CAST(er > {k} AS INT) AS tail, round(CAST({alpha} AS DOUBLE) * ({zc('es')}) + CAST({1 - alpha} AS DOUBLE) * ({zc('ms')}), 9) AS key FROM r)"
    return f"{z}, {name} AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY tail, CASE WHEN tail = 0 THEN key END DESC NULLS LAST, er) AS hr FROM {name}z)"


@query(f"WITH {V.PHOTOS}, {TWO}, {fused_sql(5, 'rerank')} SELECT pid, gind AS identity, er AS embed_rank, hr AS hybrid_rank FROM f")
def fuse_rerank(spark, d):
    return fusion.fuse(_two_signals(spark, d)[0], 5).select("pid", "identity", "embed_rank", "hybrid_rank")


@query(f"WITH {V.PHOTOS}, {TWO}, {fused_sql(5, 'linear', 0.7)} SELECT pid, gind AS identity, er AS embed_rank, hr AS hybrid_rank FROM f")
def fuse_linear(spark, d):
    return fusion.fuse(_two_signals(spark, d)[0], 5, "linear", 0.7).select("pid", "identity", "embed_rank", "hybrid_rank")


def _grid_sql() -> str:
    combos = [(k, "rerank", None) for k in fusion.GRID_K] + [(k, "linear", a) for k in fusion.GRID_K for a in fusion.GRID_ALPHA]
    parts = [fused_sql(k, m, a or 0.5, f"g{i}") for i, (k, m, a) in enumerate(combos)]
    rows = [
        f"SELECT {i} AS ord, {k} AS k, '{m}' AS method, CAST({a if a else 'NULL'} AS DOUBLE) AS alpha, round(avg(CAST(hr <= 1 AS DOUBLE)), 6) AS recall_at_1, round(avg(CAST(hr <= 5 AS DOUBLE)), 6) AS recall_at_5 FROM g{i} WHERE gind = pind"
        for i, (k, m, a) in enumerate(combos)
    ]
    return f"WITH {V.PHOTOS}, {TWO}, {', '.join(parts)}, grid AS ({' UNION ALL '.join(rows)}) SELECT *, row_number() OVER (ORDER BY recall_at_1 DESC, recall_at_5 DESC, ord) = 1 AS best FROM grid"


@query(_grid_sql())
def fuse_grid(spark, d):
    scores, truth = _two_signals(spark, d)
    grid = fusion.fuse_grid(scores, truth)
    return grid.select("ord", "k", "method", "alpha", *r6("recall_at_1", "recall_at_5"), "best")


FLAG = f"{TWO}, {fused_sql(5, 'rerank')}, q AS (SELECT cohort, er <= 1 AS e1, er <= 5 AS e5, hr <= 1 AS h1, hr <= 5 AS h5 FROM f WHERE gind = pind)"
_FLAG = "count(*) AS n, " + ", ".join(f"round(avg(CAST({c} AS DOUBLE)), 6) AS {n}" for c, n in (("e1", "embed_at_1"), ("e5", "embed_at_5"), ("h1", "hybrid_at_1"), ("h5", "hybrid_at_5"))) + ", count_if(e1 AND NOT h1) AS b, count_if(NOT e1 AND h1) AS c"


@query(f"WITH {V.PHOTOS}, {FLAG} SELECT coalesce(cohort, 'overall') AS slice, {_FLAG} FROM q GROUP BY GROUPING SETS ((), (cohort))")
def flagship_hybrid_recall(spark, d):
    """Embedder and matcher signals, identity aggregation, shortlist fusion, recall by grouping sets and McNemar counts."""
    scores, truth = _two_signals(spark, d)
    h = fusion.fuse_hits(fusion.fuse(scores, 5), truth)
    names = ["embed_at_1", "embed_at_5", "hybrid_at_1", "hybrid_at_5"]
    aggs = [F.count("*").alias("n"), *(F.round(F.avg(F.col(n).cast("double")), 6).alias(n) for n in names), F.count_if(F.col("embed_at_1") & ~F.col("hybrid_at_1")).alias("b"), F.count_if(~F.col("embed_at_1") & F.col("hybrid_at_1")).alias("c")]
    return h.groupingSets([[], ["cohort"]], "cohort").agg(*aggs).select(F.coalesce("cohort", F.lit("overall")).alias("slice"), "n", *names, "b", "c")


@query(f"WITH {V.AB} SELECT cohort, count(*) AS n, count_if(base_hit AND NOT var_hit) AS b, count_if(NOT base_hit AND var_hit) AS c FROM ab GROUP BY cohort")
def mcnemar_counts(spark, d):
    return metrics.discordant(V.ab_hits(spark, d), "base_hit", "var_hit", ["cohort"])


#: Two-sided exact p of the discordant counts b and c.
_P = "CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(b, c) AS BIGINT) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))))) END"


@query(
    f"""WITH {V.PHOTOS}, {FLAG}, m AS (SELECT cohort, count_if(e1 AND NOT h1) AS b, count_if(NOT e1 AND h1) AS c FROM q GROUP BY cohort)
SELECT cohort, b, c, round({_P}, 6) AS p FROM m"""
)
def mcnemar_exact_p(spark, d):
    scores, truth = _two_signals(spark, d)
    counts = metrics.discordant(fusion.fuse_hits(fusion.fuse(scores, 5), truth), "embed_at_1", "hybrid_at_1", ["cohort"])
    return metrics.mcnemar(counts).select("cohort", "b", "c", F.round("p", 6).alias("p"))


@query()
def mcnemar_p_any_size(spark, d):
    return metrics.mcnemar(metrics.discordant(V.ab_hits(spark, d), "base_hit", "var_hit", ["cohort"]))


@query(
    f"""WITH {V.PHOTOS}, {FLAG}, m AS (SELECT avg(CAST(e1 AS DOUBLE)) AS a1, avg(CAST(h1 AS DOUBLE)) AS z1, avg(CAST(e5 AS DOUBLE)) AS a5, avg(CAST(h5 AS DOUBLE)) AS z5, count_if(e1 AND NOT h1) AS b, count_if(NOT e1 AND h1) AS c FROM q),
p AS (SELECT *, z1 < a1 OR z5 < a5 AS worse, round({_P}, 4) AS p FROM m)
SELECT NOT worse AND p < 0.05 AND c > b AS adopt, CASE WHEN worse THEN 'regression' WHEN p >= 0.05 THEN 'not significant' WHEN c <= b THEN 'no gain' ELSE 'adopt' END AS reason, p, b, c FROM p"""
)
def adopt_decision(spark, d):
    scores, truth = _two_signals(spark, d)
    h = fusion.fuse_hits(fusion.fuse(scores, 5), truth)
    return decide.adopt_challenger(decide.compare(h, (1, 5), "embed", "hybrid"), 1)


#: Fixed values of the variants that the suppliers stand in for: name, whether it keeps the pattern, balances from which a supplier is a hit at 1 and at 5.
VARIANTS = (("belly_oriented", True, 6000, 3000), ("unroll_debend", True, 5500, 1800), ("unroll_ribbon", True, 5000, 2700), ("unroll_wnorm", False, 1000, 0))
_HIT = "(s_acctbal > {0}) <> (s_suppkey % 17 = {1})"
_VARIANT_ROWS = ", ".join(f"({_HIT.format(a, 0)}) AS {v}_at_1, ({_HIT.format(z, k // 2)}) AS {v}_at_5" for k, (v, _, a, z) in enumerate(VARIANTS))
_VARIANT_METRICS = f"""vh AS (SELECT {_VARIANT_ROWS} FROM supplier),
vc AS ({" UNION ALL ".join(f"SELECT '{v}' AS variant, {str(safe).lower()} AS pattern_safe, {k} AS k, avg(CAST({v}_at_{k} AS DOUBLE)) AS recall, count_if(belly_oriented_at_{k} AND NOT {v}_at_{k}) AS b, count_if(NOT belly_oriented_at_{k} AND {v}_at_{k}) AS c FROM vh" for v, safe, _, _ in VARIANTS for k in (1, 5))}),
vp AS (SELECT *, round({_P}, 4) AS p FROM vc),
vm AS (SELECT variant, any_value(pattern_safe) AS pattern_safe, max(recall) FILTER (WHERE k = 1) AS recall_1, max(recall) FILTER (WHERE k = 5) AS recall_5, max(p) FILTER (WHERE k = 1) AS p_1, max(p) FILTER (WHERE k = 5) AS p_5 FROM vp GROUP BY variant),
vok AS (SELECT v.* FROM vm v, vm b WHERE b.variant = 'belly_oriented' AND v.variant <> 'belly_oriented' AND v.pattern_safe AND v.recall_1 >= b.recall_1 AND v.recall_5 >= b.recall_5 AND v.p_5 < 0.05),
vd AS (SELECT coalesce((SELECT variant FROM vok ORDER BY recall_5 DESC, recall_1 DESC, variant DESC LIMIT 1), 'belly_oriented') AS decision, (SELECT count(*) FROM vok) AS eligible)"""


def _variant_hits(spark, d) -> DataFrame:
    s = V.table(spark, d, "supplier")
    hit = lambda least, k: (F.col("s_acctbal") > least) != (F.col("s_suppkey") % 17 == k)
    return s.select("s_suppkey", *(c for k, (v, _, a, z) in enumerate(VARIANTS) for c in (hit(a, 0).alias(f"{v}_at_1"), hit(z, k // 2).alias(f"{v}_at_5"))))


def _variant_metrics(spark, d) -> DataFrame:
    return decide.variant_metrics(_variant_hits(spark, d), {v: safe for v, safe, _, _ in VARIANTS}, "belly_oriented")


@query(f"WITH {_VARIANT_METRICS} SELECT variant, pattern_safe, round(recall_1, 6) AS recall_1, round(recall_5, 6) AS recall_5, p_1, p_5 FROM vm")
def variant_metrics(spark, d):
    return _variant_metrics(spark, d).select("variant", "pattern_safe", *r6("recall_1", "recall_5"), "p_1", "p_5")


@query(f"WITH {_VARIANT_METRICS} SELECT decision, eligible FROM vd")
def adopt_variant_rule(spark, d):
    return decide.adopt_variant(_variant_metrics(spark, d), "belly_oriented")


def _fused(spark, d) -> tuple[DataFrame, DataFrame]:
    scores, truth = _two_signals(spark, d)
    return fusion.fuse(scores, 5), truth


@query(
    f"""WITH {V.PHOTOS}, {FLAG}, m AS (SELECT 1 AS k, count(*) AS n, count_if(e1 AND NOT h1) AS b, count_if(NOT e1 AND h1) AS c FROM q UNION ALL SELECT 5, count(*), count_if(e5 AND NOT h5), count_if(NOT e5 AND h5) FROM q)
SELECT 'hybrid vs embedder' AS pair, k, n, b, c, round({_P}, 4) AS p, round((c - b) / n, 4) AS diff FROM m"""
)
def hybrid_paired_stats(spark, d):
    return pipelines.hybrid_stats(*_fused(spark, d)).select("pair", "k", "n", "b", "c", "p", "diff")


#: Configurations of the grid: name, first component and number of components that stand in for a surface, detector and matcher.
GRID = (("debend|deviation|guided", 1, 32), ("debend|log|guided", 33, 32), ("oriented|deviation|nn", 1, 16), ("oriented|log|nn", 17, 48))


def _grid_ab_sql() -> str:
    parts = []
    for n, (name, first, size) in enumerate(GRID):
        sim = f"round(list_dot_product(p.e[{first}:{first + size - 1}], g.e[{first}:{first + size - 1}]), 9)"
        parts.append(f"""g{n} AS (SELECT p.id AS pid, p.identity AS pind, g.identity AS gind, max({sim}) AS sim FROM photos p, photos g WHERE p.role = 'probe' AND g.role = 'gallery' GROUP BY ALL),
r{n} AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, gind) AS rk FROM g{n}),
s{n} AS (SELECT {n} AS ord, '{name}' AS name, round(avg(CAST(h1 AS DOUBLE)), 6) AS recall_at_1, round(avg(CAST(h5 AS DOUBLE)), 6) AS recall_at_5, count(*) AS n_probe FROM (SELECT pid, bool_or(rk <= 1 AND gind = pind) AS h1, bool_or(rk <= 5 AND gind = pind) AS h5 FROM r{n} GROUP BY pid))""")
    rows = " UNION ALL ".join(f"SELECT * FROM s{n}" for n in range(len(GRID)))
    return f"WITH {V.PHOTOS}, {', '.join(parts)}, rows AS ({rows}) SELECT *, row_number() OVER (ORDER BY recall_at_1 DESC, recall_at_5 DESC, ord) = 1 AS best FROM rows"


@query(_grid_ab_sql())
def matcher_grid(spark, d):
    sides = {name: V.sides(spark, d, (first, size)) for name, first, size in GRID}
    rows = decide.grid({name: s.identity_scores() for name, s in sides.items()}, next(iter(sides.values())).truth)
    return rows.select("ord", "name", *r6("recall_at_1", "recall_at_5"), "n_probe", "best")


def _ab_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Photos with a confidence and three embeddings: raw, a crop, and a second crop that every ninth photo lacks; one identity is in no gallery."""
    e = F.col("embedding")
    rows = V.photos(spark, d).select("id", "identity", "cohort", "label", "role", ((F.col("id") % 20) / F.lit(20.0)).alias("seg_conf"), F.slice(e, 1, 32).alias("raw"), F.slice(e, 33, 32).alias("belly_oriented"), F.when(F.col("id") % 9 != 0, F.slice(e, 17, 32)).alias("unroll_ribbon"))
    return rows.where("role = 'gallery' AND label <> 9"), rows.where("role = 'probe'")


def _ab_hits_sql(name: str, vector: str) -> str:
    """Photo hits of one way to take the vectors."""
    return f"""{name}v AS (SELECT id, identity, label, role, {vector} AS v FROM photos),
{name} AS (SELECT pid, coalesce(bool_or(rk <= 1 AND pind = gind), false) AS h1, coalesce(bool_or(rk <= 5 AND pind = gind), false) AS h5 FROM (SELECT p.id AS pid, p.identity AS pind, g.identity AS gind, row_number() OVER (PARTITION BY p.id ORDER BY round(list_dot_product(p.v, g.v), 9) DESC, g.id) AS rk
  FROM {name}v p, {name}v g WHERE p.role = 'probe' AND g.role = 'gallery' AND g.label <> 9) GROUP BY pid)"""


_CONF = "(id % 20) / 20.0"
_BO = "CASE WHEN {0} >= {1} THEN e[33:64] ELSE e[1:32] END".format
_RIB = "CASE WHEN {0} >= {1} AND id % 9 <> 0 THEN e[17:48] ELSE e[1:32] END".format
_AB = f"""{_ab_hits_sql('raw', 'e[1:32]')}, {_ab_hits_sql('bo', _BO(_CONF, 0.15))}, {_ab_hits_sql('rib', _RIB(_CONF, 0.15))},
every AS (SELECT p.id, cohort, label <> 9 AS known, raw.h1 AS raw1, raw.h5 AS raw5, bo.h1 AS bo1, bo.h5 AS bo5, rib.h1 AS rib1, rib.h5 AS rib5 FROM photos p JOIN raw ON p.id = raw.pid JOIN bo ON p.id = bo.pid JOIN rib ON p.id = rib.pid)"""
_AB_NAMES = (("raw", "raw"), ("bo", "belly_oriented"), ("rib", "unroll_ribbon"))


def _ab_summary_sql(where: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS variant, coalesce(cohort, 'overall') AS slice, count(*) AS n, round(avg(CAST({s}1 AS DOUBLE)), 6) AS recall_at_1, round(avg(CAST({s}5 AS DOUBLE)), 6) AS recall_at_5 FROM every WHERE {where} GROUP BY GROUPING SETS ((), (cohort))" for s, name in _AB_NAMES)


def _ab(spark, d) -> dict[str, DataFrame]:
    return pipelines.ab_analysis(*_ab_sides(spark, d), ["belly_oriented", "unroll_ribbon"], sweep=(0.15, 0.35))


@query(f"WITH {V.PHOTOS}, {_AB} {_ab_summary_sql('true')}")
def ab_summary(spark, d):
    return _ab(spark, d)["summary"].select("variant", "slice", "n", "recall_at_1", "recall_at_5")


@query(f"WITH {V.PHOTOS}, {_AB} {_ab_summary_sql('known')}")
def ab_paired_success_only(spark, d):
    return _ab(spark, d)["paired"].select("variant", "slice", "n", "recall_at_1", "recall_at_5")


@query(f"WITH {V.PHOTOS}, {_AB} SELECT count(*) AS n_probe, count_if(known) AS n_true, count_if(NOT known) AS n_excluded FROM every")
def ab_closed_set(spark, d):
    return _ab(spark, d)["closed_set"]


@query(
    f"WITH {V.PHOTOS}, {_AB}, m AS (" + " UNION ALL ".join(f"SELECT '{name}' AS pair, {k} AS k, count(*) AS n, count_if({a}{k} AND NOT {z}{k}) AS b, count_if(NOT {a}{k} AND {z}{k}) AS c FROM every WHERE known" for name, a, z in (("belly_oriented vs raw", "raw", "bo"), ("unroll_ribbon vs belly_oriented", "bo", "rib")) for k in (1, 5))
    + f") SELECT pair, k, n, b, c, round({_P}, 4) AS p, round((c - b) / n, 4) AS diff FROM m"
)
def ab_stats(spark, d):
    return _ab(spark, d)["stats"].select("pair", "k", "n", "b", "c", "p", "diff")


@query(
    f"WITH {V.PHOTOS}, " + ", ".join(_ab_hits_sql(f"{s}{n}", f(_CONF, t)) for n, t in enumerate((0.15, 0.35)) for s, f in (("b", _BO), ("r", _RIB))) + " "
    + " UNION ALL ".join(f"SELECT '{name}' AS variant, CAST({t} AS DOUBLE) AS threshold, round(avg(CAST(h1 AS DOUBLE)), 4) AS recall_at_1, round(avg(CAST(h5 AS DOUBLE)), 4) AS recall_at_5, (SELECT round(avg(CAST({_CONF} >= {t} AS DOUBLE)), 3) FROM photos WHERE role = 'probe') AS coverage FROM {s}{n}" for n, t in enumerate((0.15, 0.35)) for s, name in (("b", "belly_oriented"), ("r", "unroll_ribbon")))
)
def ab_sensitivity(spark, d):
    return _ab(spark, d)["sensitivity"].select("variant", "threshold", "recall_at_1", "recall_at_5", "coverage")


_T = " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold" for t in SWEEP)


@query(f"WITH {V.AB}, t AS ({_T}) SELECT threshold, round(avg(CAST(seg_conf * 5 >= threshold AS DOUBLE)), 3) AS coverage, round(avg(CAST(CASE WHEN seg_conf * 5 >= threshold THEN var_hit ELSE base_hit END AS DOUBLE)), 4) AS recall FROM ab, t GROUP BY threshold")
def sensitivity_sweep(spark, d):
    return metrics.sweep(V.ab_hits(spark, d).withColumn("seg_conf", F.col("seg_conf") * 5), SWEEP, "seg_conf", "base_hit", "var_hit")


@query(
    f"""WITH {V.PHOTOS}, {IDN}, keep AS (SELECT p.id FROM photos p WHERE p.role = 'probe' AND EXISTS (SELECT 1 FROM photos g WHERE g.role = 'gallery' AND g.identity = p.identity AND g.session IS DISTINCT FROM p.session))
SELECT cohort, count(*) AS n, round(avg(CAST(hit_at_1 AS DOUBLE)), 6) AS recall_at_1 FROM hits WHERE pid IN (SELECT id FROM keep) GROUP BY cohort"""
)
def temporal_recall(spark, d):
    s = V.sides(spark, d)
    keep = retrieval.temporal_probes(s.probes, s.gallery).select(F.col("id").alias("pid"), "cohort")
    return pipelines.hits(s).join(keep, "pid").groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit_at_1").cast("double")), 6).alias("recall_at_1"))


_ABL = ", ".join(f"{n} AS (SELECT pid, bool_or(rk <= 5 AND gind = pind) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, gind) AS rk FROM (SELECT pid, pind, gind, max(sim) AS sim FROM s_{n} GROUP BY ALL)) GROUP BY pid)" for n in ("full", "es", "ms"))


@query(
    f"""WITH {V.PHOTOS}, {V.sims_sql('e', name='s_full')}, {V.sims_sql('es', name='s_es')}, {V.sims_sql('ms', name='s_ms')}, {_ABL},
l AS (SELECT 'full' AS config, * FROM full_ UNION ALL SELECT 'es', * FROM es UNION ALL SELECT 'ms', * FROM ms)
SELECT config, 5 AS k, count(*) AS n, round(avg(CAST(l.hit AS DOUBLE)), 6) AS recall, count_if(f.hit AND NOT l.hit) AS b, count_if(NOT f.hit AND l.hit) AS c FROM l JOIN full_ f USING (pid) GROUP BY config""".replace(", full AS (", ", full_ AS (")
)
def ablation_report(spark, d):
    long = None
    for name, dims in (("full", None), ("es", (1, 32)), ("ms", (33, 32))):
        rows = pipelines.hits(V.sides(spark, d, dims)).select(F.lit(name).alias("config"), "pid", F.col("hit_at_5").alias("hit"))
        long = rows if long is None else long.union(rows)
    return decide.ablation(long, ["full", "es", "ms"], 5)


@query(
    f"""WITH {V.PHOTOS}, {IDN}, w AS (SELECT pid, hit_at_1, hit_at_5, pind, cohort FROM hits), {KNOWN_NEW.replace('sims AS', 'sims2 AS').replace('FROM sims', 'FROM sims2').replace('JOIN sims ', 'JOIN sims2 ')}
SELECT (SELECT count(*) FROM w) AS n, (SELECT round(avg(CAST(hit_at_1 AS DOUBLE)), 6) FROM w) AS recall_at_1, (SELECT round(avg(CAST(hit_at_5 AS DOUBLE)), 6) FROM w) AS recall_at_5,
(SELECT round(avg(CASE WHEN a.max_sim > b.max_sim THEN 1.0 WHEN a.max_sim = b.max_sim THEN 0.5 ELSE 0.0 END), 6) FROM scores a, scores b WHERE NOT a.is_new AND b.is_new) AS auroc,
round(avg(CAST(max_sim >= 0.35 AS DOUBLE)) FILTER (WHERE NOT is_new), 6) AS known_kept, round(avg(CAST(max_sim >= 0.35 AS DOUBLE)) FILTER (WHERE is_new), 6) AS new_falsely_known FROM scores"""
)
def sealed_report(spark, d):
    s = V.sides(spark, d)
    hits = pipelines.hits(s).join(s.truth.select("pid", "cohort"), "pid").withColumn("known", F.lit(True))
    out = metrics.sealed_report(hits, "known", _open_scores(spark, d), 0.35, 1000)
    return out.select("n", "recall_at_1", "recall_at_5", *r6("auroc"), "known_kept", "new_falsely_known")


@query()
def bootstrap_ci(spark, d):
    pairs = V.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 150000).alias("base_hit"), (F.col("o_custkey") % 2 == 0).alias("var_hit"))
    return metrics.paired_bootstrap(pairs, "base_hit", "var_hit", "o_orderkey", 200)


@query()
def bootstrap_scaled(spark, d):
    pairs = V.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 150000).alias("base_hit"), (F.col("o_custkey") % 2 == 0).alias("var_hit"))
    return metrics.scaled_bootstrap(pairs, "base_hit", "var_hit", "o_orderkey")


@query(
    f"""WITH {V.PHOTOS}, w AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count_if(id % 4 = 0) AS DOUBLE) AS h, cohort FROM photos GROUP BY cohort)
SELECT cohort, round((h / n + 3.8416 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS lo, round((h / n + 3.8416 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS hi FROM w"""
)
def wilson_intervals(spark, d):
    w = V.photos(spark, d).groupBy("cohort").agg(stats.wilson(F.count_if(F.col("id") % 4 == 0), F.count("*")).alias("ci"))
    return w.select("cohort", F.round("ci.lo", 6).alias("lo"), F.round("ci.hi", 6).alias("hi"))


# --- manifest -------------------------------------------------------------------


_DUP = f"""{V.DOCS}, g AS (SELECT md5, row_number() OVER (ORDER BY md5) - 1 AS dup_group FROM docs GROUP BY md5 HAVING count(*) > 1),
k AS (SELECT d.*, coalesce(g.dup_group, -1) AS dup_group, row_number() OVER (PARTITION BY d.md5 ORDER BY length(source), source, doc_id) = 1 AS dup_keep FROM docs d LEFT JOIN g USING (md5))"""


def _dups(spark, d) -> DataFrame:
    return dedup.deduplicate(V.docs_manifest(spark, d), [F.length("source"), F.col("source")], "doc_id", notes="notes")


@query(f"WITH {_DUP} SELECT doc_id, dup_group FROM k")
def dedup_groups(spark, d):
    return dedup.dup_groups(V.docs_manifest(spark, d)).select("doc_id", "dup_group")


@query(f"WITH {_DUP} SELECT doc_id, dup_group, dup_keep, CASE WHEN dup_keep THEN '' ELSE 'duplicate' END AS notes FROM k")
def dedup_survivors(spark, d):
    return _dups(spark, d).select("doc_id", "dup_group", "dup_keep", "notes")


@query(f"WITH {_DUP} SELECT dup_group, count(*) AS members, string_agg(DISTINCT cohort, ',' ORDER BY cohort) AS cohorts, count(DISTINCT cohort) > 1 AS cross_cohort, max(CASE WHEN dup_keep THEN doc_id END) AS survivor FROM k WHERE dup_group >= 0 GROUP BY dup_group")
def dup_report(spark, d):
    return dedup.dup_report(_dups(spark, d), "doc_id")


@cache
def _S(select: str, where: str = "true") -> str:
    return f"WITH {V.SHOTS}, {V.SPLITS} SELECT {select} FROM split WHERE {where}"


def _split(spark, d) -> DataFrame:
    return splits.assign_splits(V.shots(spark, d))


@query(f"WITH {V.SHOTS}, {V.SPLITS} SELECT individual_id FROM opened")
def open_new_selection(spark, d):
    return splits.open_new(V.shots(spark, d)).select("individual_id")


@query(f"WITH {V.SHOTS} SELECT event_id, CASE WHEN {V.COIN.format(chr(39) + '42-fold:' + chr(39) + ' || rel_path')} < 0.5 THEN 'test' ELSE 'dev' END AS fold FROM shots")
def fold_coin(spark, d):
    return V.shots(spark, d).select("event_id", hashing.fold_coin(F.col("rel_path"), 0.5, 42).alias("fold"))


@query(_S("event_id, split_role, split_fold, split_scheme, is_new_open, kpi_scope"))
def assign_splits(spark, d):
    return _split(spark, d).select("event_id", "split_role", "split_fold", "split_scheme", "is_new_open", "kpi_scope")


_STAGE_SQL = {
    "pretrain": "false",
    "train": "split_fold = 'train'",
    "gallery": "split_role = 'gallery' AND NOT is_new_open AND kpi_scope = 'kpi_core'",
    "dev": "split_role = 'probe' AND NOT is_new_open AND kpi_scope = 'kpi_core' AND split_fold = 'dev'",
    "test": "split_role = 'probe' AND NOT is_new_open AND kpi_scope = 'kpi_core' AND split_fold = 'test'",
    "open_dev": "is_new_open AND split_fold = 'dev'",
    "open_test": "is_new_open AND split_fold = 'test'",
}
for _name, _where in _STAGE_SQL.items():
    query(_S("event_id, md5", _where), f"stage_{_name}")(lambda spark, d, s=_name: splits.select_stage(_split(spark, d), s).select("event_id", "md5"))


@query(f"WITH {V.SHOTS}, {V.SPLITS} SELECT cohort, count(*) AS files, count_if(dup_keep) AS kept, count(DISTINCT individual_id) AS individuals, count_if(split_role = 'gallery') AS gallery, count_if(split_role = 'probe') AS probe, count_if(split_fold = 'train') AS train, count_if(split_fold = 'dev') AS dev, count_if(split_fold = 'test') AS test FROM split GROUP BY cohort")
def cohort_counts(spark, d):
    return reports.cohort_counts(_split(spark, d))


@query(f"WITH {V.SHOTS}, n AS (SELECT cohort, individual_id, count(*) AS n FROM shots GROUP BY ALL) SELECT cohort, count(*) AS individuals, min(n) AS least, CAST(floor(median(n)) AS BIGINT) AS median, max(n) AS most FROM n GROUP BY cohort")
def photos_per_individual(spark, d):
    return reports.photos_per_individual(V.shots(spark, d))


@query(f"WITH {V.SHOTS} SELECT cohort, date, count(*) AS n FROM shots WHERE date IS NOT NULL GROUP BY ALL")
def date_coverage(spark, d):
    return reports.date_coverage(V.shots(spark, d))


_DATES = [f"2024-01-{k:02d}" for k in range(1, 32)]


@query(f"WITH {V.SHOTS} SELECT individual_id, {', '.join(f'count_if(coalesce(date = {chr(39)}{x}{chr(39)}, false)) AS {chr(34)}{x}{chr(34)}' for x in _DATES)} FROM shots WHERE cohort = 'LAB' GROUP BY individual_id")
def date_pivot(spark, d):
    return reports.date_pivot(V.shots(spark, d), "LAB", _DATES)


@query(_S("cohort, split_scheme, split_role, count(*) AS n") + " GROUP BY ALL")
def split_summary(spark, d):
    return reports.split_summary(_split(spark, d))


@query(f"WITH {V.SHOTS} SELECT cohort, width, height, CAST(NULL AS INT) AS orientation, count(*) AS n FROM shots GROUP BY ALL")
def resolution_counts(spark, d):
    return reports.resolution_counts(V.shots(spark, d).withColumn("orientation", F.lit(None).cast("int")))


@query(f"WITH {_DUP} SELECT doc_id, 'duplicate' AS notes FROM k WHERE NOT dup_keep ORDER BY doc_id LIMIT 100")
def anomaly_log(spark, d):
    return reports.anomaly_log(_dups(spark, d), "doc_id")[0]


@query(
    f"""WITH {V.SHOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY md5) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n FROM shots),
pts AS (SELECT DISTINCT cohort, CAST(round_even(k * ((n - 1) / CAST(greatest(least(25, n) - 1, 1) AS DOUBLE)), 0) AS BIGINT) AS i FROM (SELECT DISTINCT cohort, n FROM r) c, range(0, 25) t(k) WHERE k < least(25, n))
SELECT event_id FROM r JOIN pts USING (cohort, i)"""
)
def even_spaced_pilot(spark, d):
    return splits.even_spaced(V.shots(spark, d), 25).select("event_id")


@query(f"WITH {V.SHOTS} SELECT individual_id, (row_number() OVER (ORDER BY md5('42:' || individual_id), individual_id) - 1) % 5 AS fold FROM (SELECT DISTINCT individual_id FROM shots)")
def kfold_individuals(spark, d):
    return splits.folds_by_individual(V.shots(spark, d), 5)


@query(f"WITH {V.SHOTS} SELECT individual_id, row_number() OVER (ORDER BY individual_id) - 1 AS code FROM (SELECT DISTINCT individual_id FROM shots)")
def label_encode(spark, d):
    return splits.label_encode(V.shots(spark, d), "individual_id")


def _pk_sql(order: str, extra: str = "") -> str:
    return f"""WITH {V.SHOTS}, p AS (SELECT individual_id, row_number() OVER (ORDER BY md5('42-0:' || individual_id), individual_id) - 1 AS i, count(*) OVER () AS t FROM (SELECT DISTINCT individual_id FROM shots)),
f0 AS (SELECT individual_id, md5, md5('42-0:' || md5) AS pk{extra} FROM shots), f AS (SELECT *, row_number() OVER (PARTITION BY individual_id ORDER BY {order}) - 1 AS j, count(*) OVER (PARTITION BY individual_id) AS n FROM f0)
SELECT CAST(i // 8 AS INT) AS batch, CAST(i % 8 AS INT) AS slot_p, CAST(s.k AS INT) AS slot_k, individual_id, md5 FROM f JOIN p USING (individual_id), range(0, 4) s(k) WHERE j < 4 AND i < (t // 8) * 8 AND s.k >= j AND (s.k - j) % least(n, 4) = 0"""


@query(_pk_sql("pk, md5"))
def pk_batches(spark, d):
    return splits.pk_batches(V.shots(spark, d), 8, 4)


@query(_pk_sql("turn, sk, pk, md5", ", row_number() OVER (PARTITION BY individual_id, session ORDER BY md5('42-0:' || md5), md5) AS turn, md5('42-0:' || session) AS sk"))
def session_pk_batches(spark, d):
    return splits.pk_batches(V.shots(spark, d), 8, 4, session="session")


@query("SELECT n.n_nationkey, n.n_name, CASE n.n_regionkey WHEN 0 THEN 'kpi_core' WHEN 1 THEN 'kpi_core' WHEN 2 THEN 'temporal_aux' WHEN 3 THEN 'external' END AS scope FROM nation n")
def kpi_scope_rule(spark, d):
    n = V.table(spark, d, "nation")
    cohort = F.element_at(F.array(F.lit("TK"), F.lit("PW"), F.lit("LAB"), F.lit("GCN"), F.lit("XX")), (F.col("n_regionkey") + 1).cast("int"))
    role = F.when(F.col("n_regionkey") == 3, "external").otherwise("target")
    return n.select("n_nationkey", "n_name", splits.kpi_scope(cohort, role).alias("scope"))


# --- parsing ----------------------------------------------------------------------


_MMYY = lambda x: f"CASE WHEN regexp_full_match({x}, '[0-9]+') AND length({x}) IN (4, 5) THEN (SELECT CASE WHEN TRY_CAST(m[1:2] AS INT) BETWEEN 1 AND 12 AND TRY_CAST(m[3:4] AS INT) + 2000 BETWEEN 2023 AND 2026 THEN '20' || m[3:4] || '-' || m[1:2] END FROM (SELECT CASE WHEN length({x}) = 5 THEN {x}[1:2] || {x}[4:5] ELSE {x} END AS m)) END"
_NAMES = """n AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN printf('%02d-%02d-%s.JPG', user_id, day(ts), strftime(ts, '%m%y')) WHEN 1 THEN printf('%d-%d-%s.jpeg', user_id, day(ts), strftime(ts, '%m') || '7' || strftime(ts, '%y'))
 WHEN 2 THEN 'IMG_' || event_id || '.JPG' WHEN 3 THEN printf('%02d-%02d (%d).jpg', user_id, day(ts), event_id % 9) WHEN 4 THEN printf('%d-1-1399.jpg', user_id) ELSE printf('%02d.%d', user_id, event_id % 3) END AS name,
 strftime(ts, '%d.%m.%Y') AS day, 'trip ' || strftime(ts, '%m%y') || ' b' AS folder FROM events)"""


def _named(spark, d) -> DataFrame:
    e = V.table(spark, d, "events")
    u, day, ev = F.col("user_id"), F.dayofmonth("ts"), F.col("event_id")
    name = (
        F.when(ev % 6 == 0, F.format_string("%02d-%02d-%s.JPG", u, day, F.date_format("ts", "MMyy")))
        .when(ev % 6 == 1, F.format_string("%d-%d-%s.jpeg", u, day, F.concat(F.date_format("ts", "MM"), F.lit("7"), F.date_format("ts", "yy"))))
        .when(ev % 6 == 2, F.format_string("IMG_%d.JPG", ev)).when(ev % 6 == 3, F.format_string("%02d-%02d (%d).jpg", u, day, ev % 9)).when(ev % 6 == 4, F.format_string("%d-1-1399.jpg", u)).otherwise(F.format_string("%02d.%d", u, ev % 3))
    )
    return e.select("event_id", name.alias("name"), F.date_format("ts", "dd.MM.yyyy").alias("day"), F.concat(F.lit("trip "), F.date_format("ts", "MMyy"), F.lit(" b")).alias("folder"))


_TK, _PW = r"^([0-9]+)-([0-9]+)-([0-9]+)\.jpe?g$", r"^([0-9]+)-([0-9]+)\s*\(([0-9]+)\)\.jpe?g$"


@query(
    f"""WITH {_NAMES}, x AS (SELECT *, regexp_matches(name, '(?i){_TK}') AS tk, regexp_matches(name, '(?i){_PW}') AS pw, regexp_extract(name, '(?i){_TK}', 3) AS mmyy FROM n)
SELECT event_id, CASE WHEN tk THEN TRY_CAST(regexp_extract(name, '(?i){_TK}', 1) AS INT) END AS tk_id, CASE WHEN tk THEN printf('%02d', TRY_CAST(regexp_extract(name, '(?i){_TK}', 2) AS INT)) END AS tk_session, {_MMYY('mmyy')} AS tk_date,
CASE WHEN pw THEN TRY_CAST(regexp_extract(name, '(?i){_PW}', 1) AS INT) END AS pw_id, CASE WHEN pw THEN TRY_CAST(regexp_extract(name, '(?i){_PW}', 3) AS INT) END AS pw_shot, TRY_CAST(string_split(name, '.')[1] AS INT) AS lab_id FROM x"""
)
def parse_filenames(spark, d):
    tk, pw = parse.tk_filename(F.col("name")), parse.pw_filename(F.col("name"))
    return _named(spark, d).select("event_id", tk["id"].alias("tk_id"), tk["session"].alias("tk_session"), tk["date"].alias("tk_date"), pw["id"].alias("pw_id"), pw["shot"].alias("pw_shot"), parse.lab_stem(F.col("name"))["id"].alias("lab_id"))


@query(f"WITH x AS (SELECT o_orderkey, CAST(o_orderkey % 20000 AS VARCHAR) AS t FROM orders) SELECT o_orderkey, {_MMYY('t')} AS month FROM x")
def normalize_mmyy(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", parse.normalize_mmyy((F.col("o_orderkey") % 20000).cast("string")).alias("month"))


@query(f"WITH {_NAMES}, x AS (SELECT *, regexp_extract(folder, '([0-9]{{4}})', 1) AS t FROM n) SELECT event_id, strftime(strptime(day, '%d.%m.%Y'), '%Y-%m-%d') AS lab_date, {_MMYY('t')} AS folder_date FROM x")
def parse_dates(spark, d):
    return _named(spark, d).select("event_id", parse.lab_date(F.col("day")).alias("lab_date"), parse.tk_subfolder_date(F.col("folder")).alias("folder_date"))


_RLE = "x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || 'x' || (p_size + 7) || ':abc' WHEN 1 THEN p_size || 'x9:' WHEN 2 THEN 'broken' END AS t FROM part)"


@query(f"WITH {_RLE}, y AS (SELECT *, coalesce(regexp_matches(t, '^[0-9]+x[0-9]+:'), false) AS ok FROM x) SELECT p_partkey, CASE WHEN ok THEN CAST(regexp_extract(t, '^([0-9]+)x', 1) AS INT) END AS h, CASE WHEN ok THEN CAST(regexp_extract(t, 'x([0-9]+):', 1) AS INT) END AS w, CASE WHEN ok THEN regexp_extract(t, ':(.*)$', 1) = '' ELSE true END AS mask_empty FROM y")
def rle_prefix(spark, d):
    p, size = V.table(spark, d, "part"), F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(size, F.lit("x"), (F.col("p_size") + 7).cast("string"), F.lit(":abc"))).when(F.col("p_partkey") % 4 == 1, F.concat(size, F.lit("x9:"))).when(F.col("p_partkey") % 4 == 2, F.lit("broken"))
    r = parse.rle_prefix(text)
    return p.select("p_partkey", r["h"].alias("h"), r["w"].alias("w"), r["mask_empty"].alias("mask_empty"))


# --- variants ----------------------------------------------------------------------


@query(f"WITH {V.PHOTOS}, {V.CROPS} SELECT p.md5, p.identity, c.crop_path FROM photos p JOIN crops c ON p.md5 = c.md5 AND c.variant = 'unroll_ribbon'")
def variant_inner_join(spark, d):
    return variants.select_crops(V.photos(spark, d).select("md5", "identity"), V.crops(spark, d), "unroll_ribbon").select("md5", "identity", "crop_path")


@query(f"WITH {V.PHOTOS}, {V.CROPS}, b AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY CAST(variant <> 'unroll_ribbon' AS INT)) AS rn FROM crops) SELECT p.md5, b.variant AS variant_used, b.crop_path FROM photos p LEFT JOIN b ON p.md5 = b.md5 AND rn = 1")
def variant_fallback_join(spark, d):
    return variants.select_with_fallback(V.photos(spark, d), V.crops(spark, d), "unroll_ribbon", "belly_oriented").select("md5", "variant_used", "crop_path")


@query(f"WITH {V.PHOTOS}, {V.CROPS}, n AS (SELECT md5, variant, 'new/' || md5 AS crop_path FROM crops WHERE id % 3 = 0) SELECT md5, variant, coalesce(n.crop_path, crops.crop_path) AS crop_path FROM crops LEFT JOIN n USING (md5, variant)")
def upsert_merge(spark, d):
    old = V.crops(spark, d).select("md5", "variant", "crop_path", "id")
    new = old.where("id % 3 = 0").withColumn("crop_path", F.concat(F.lit("new/"), "md5"))
    return variants.upsert(old.drop("id"), new.drop("id"))


@query(f"WITH {V.PHOTOS}, {V.CROPS}, a AS (SELECT DISTINCT md5 FROM crops WHERE variant = 'belly_oriented'), b AS (SELECT DISTINCT md5 FROM crops WHERE variant = 'unroll_ribbon') SELECT (SELECT count(*) FROM a WHERE md5 NOT IN (SELECT md5 FROM b)) AS only_a, (SELECT count(*) FROM b WHERE md5 NOT IN (SELECT md5 FROM a)) AS only_b, (SELECT count(*) FROM a WHERE md5 IN (SELECT md5 FROM b)) AS both")
def coverage_parity(spark, d):
    c = V.crops(spark, d)
    return variants.parity(c.where("variant = 'belly_oriented'"), c.where("variant = 'unroll_ribbon'"))


@query(
    f"""WITH {V.PHOTOS}, {V.CROPS}, f AS (SELECT identity, (row_number() OVER (ORDER BY md5('42:' || identity), identity) - 1) % 3 AS fold FROM (SELECT DISTINCT identity FROM photos))
SELECT p.md5, p.role, coalesce(CAST(CASE WHEN p.session > 0 THEN p.session END AS VARCHAR), p.md5) AS session, fold FROM photos p JOIN f USING (identity) WHERE p.md5 IN (SELECT md5 FROM crops WHERE variant = 'belly_oriented') AND p.md5 IN (SELECT md5 FROM crops WHERE variant = 'unroll_ribbon')"""
)
def oof_records(spark, d):
    p = V.photos(spark, d).select("md5", F.col("identity").alias("individual_id"), "cohort", "role", F.when(F.col("session") > 0, F.col("session").cast("string")).alias("session"))
    folds = splits.folds_by_individual(p, 3)
    out = variants.oof_records(p.where("role = 'gallery'").drop("role"), p.where("role = 'probe'").drop("role"), V.crops(spark, d), ["belly_oriented", "unroll_ribbon"], folds)
    return out.select("md5", "role", "session", "fold")


@query(f"WITH {V.PHOTOS}, {V.CROPS} SELECT variant, count(*) AS n, count_if(crop_status = 'ok') AS ok, round(avg(CAST(crop_status = 'ok' AS DOUBLE)), 4) AS ok_share FROM crops GROUP BY variant")
def crop_coverage(spark, d):
    return reports.crop_coverage(V.crops(spark, d))


@query(f"WITH {V.PHOTOS} SELECT id, round(CASE WHEN (id % 20) / 20.0 >= 0.15 THEN e[33] ELSE e[1] END, 6) AS first FROM photos")
def variant_embeddings(spark, d):
    p = V.photos(spark, d).select("id", ((F.col("id") % 20) / 20.0).alias("seg_conf"), F.slice("embedding", 1, 32).alias("raw"), F.slice("embedding", 33, 32).alias("crop"))
    return p.select("id", F.round(F.get(retrieval.variant_embeddings("raw", "crop", "seg_conf", 0.15), F.lit(0)).cast("double"), 6).alias("first"))


@query(f"WITH {V.PHOTOS}, {V.CROPS} SELECT md5, variant, crop_status FROM crops WHERE variant = 'belly_oriented' UNION ALL SELECT md5, 'unroll_debend', 'ok' FROM crops WHERE variant = 'belly_oriented' UNION ALL SELECT md5, 'unroll_ribbon', 'no_axis' FROM crops WHERE variant = 'belly_oriented'")
def variant_rows(spark, d):
    base = V.crops(spark, d).where("variant = 'belly_oriented'")
    paths = F.create_map(F.lit("debend"), F.concat("crop_path", F.lit("d")), F.lit("ribbon"), F.concat("crop_path", F.lit("r")))
    results = base.withColumn("unroll_variants", paths).withColumn("unroll_status", F.create_map(F.lit("ribbon"), F.lit("no_axis")))
    return variants.variant_rows(results, "v1", 384).select("md5", "variant", "crop_status")


@query(f"WITH {V.PHOTOS} SELECT md5, array_to_string(list_filter([CASE WHEN (id % 10) / 10.0 < 0.2 THEN 'low_head_conf' END, CASE WHEN id % 7 = 0 THEN 'band_suspect' END], lambda x: x IS NOT NULL), ',') AS flags, id % 4 = 1 AND id % 5 <> 0 AS usable FROM photos")
def label_flags(spark, d):
    p = V.photos(spark, d).select("md5", ((F.col("id") % 10) / 10.0).alias("head_conf"), F.when(F.col("id") % 7 == 0, "x band_suspect").alias("notes"), V.points(F.col("embedding"), 1, 4).alias("belly_polygon"), F.lit("pseudo").alias("source"), F.when(F.col("id") % 4 == 1, "corrected").otherwise("auto").alias("status"), F.when(F.col("id") % 5 != 0, V.points(F.col("embedding"), 1, 1)[0]).alias("head_xy"), V.points(F.col("embedding"), 3, 1)[0].alias("cloaca_xy"))
    return p.select("md5", F.array_join(variants.derive_flags(), ",").alias("flags"), variants.usable_label().alias("usable"))


# --- gates ---------------------------------------------------------------------------


def _gate_tables(spark, d) -> dict[str, DataFrame]:
    """The manifest with planted faults, crops and spots."""
    e = F.col("event_id")
    target = _split(spark, d).withColumns({
        "rel_path": F.when(e % 1000 == 1, F.concat(F.lit("/"), "rel_path")).otherwise(F.col("rel_path")),
        "date": F.when(e % 1000 == 2, "2024-02-30").otherwise(F.col("date")), "date_source": F.when(e % 1000 == 3, "guess").otherwise("none"),
        "split_fold": F.when(e % 1000 == 4, F.lit(None)).otherwise(F.col("split_fold")), "kpi_scope": F.when(e % 1000 == 5, "external").otherwise(F.col("kpi_scope")),
        "dup_keep": F.when(e % 1000 == 6, False).otherwise(True), "dup_group": F.when(e % 1000 == 6, 0).otherwise(-1), "split_scheme": F.when(e % 1000 == 7, F.lit(None)).otherwise(F.col("split_scheme")),
        "md5": F.when(e % 1000 == 8, F.md5((e + 1).cast("string"))).otherwise(F.col("md5")),
    })
    external = V.table(spark, d, "supplier").select(F.md5(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("md5"), F.when(F.col("s_suppkey") % 50 == 0, "target").otherwise("external").alias("role"), F.lit(True).alias("dup_keep"), F.lit(-1).alias("dup_group"), F.concat(F.lit("g/"), F.col("s_suppkey").cast("string")).alias("rel_path"), F.lit("GCN").alias("cohort"), F.concat(F.when(F.col("s_suppkey") % 50 == 3, "PW-").otherwise("GCN-"), F.col("s_suppkey").cast("string")).alias("individual_id"))
    return {"target": target, "external": external}


_FAULTY = f"""{V.SHOTS}, {V.SPLITS}, target AS (SELECT event_id, individual_id, cohort, role, width, height, is_new_open, split_role, CASE WHEN event_id % 1000 = 1 THEN '/' || rel_path ELSE rel_path END AS rel_path,
 CASE WHEN event_id % 1000 = 2 THEN '2024-02-30' ELSE date END AS date, CASE WHEN event_id % 1000 = 3 THEN 'guess' ELSE 'none' END AS date_source, CASE WHEN event_id % 1000 <> 4 THEN split_fold END AS split_fold,
 CASE WHEN event_id % 1000 = 5 THEN 'external' ELSE kpi_scope END AS kpi_scope, event_id % 1000 <> 6 AS dup_keep, CASE WHEN event_id % 1000 = 6 THEN 0 ELSE -1 END AS dup_group,
 CASE WHEN event_id % 1000 <> 7 THEN split_scheme END AS split_scheme, CASE WHEN event_id % 1000 = 8 THEN md5(CAST(event_id + 1 AS VARCHAR)) ELSE md5 END AS md5 FROM split),
external AS (SELECT md5('s' || s_suppkey) AS md5, CASE WHEN s_suppkey % 50 = 0 THEN 'target' ELSE 'external' END AS role, 'GCN' AS cohort, CASE WHEN s_suppkey % 50 = 3 THEN 'PW-' ELSE 'GCN-' END || s_suppkey AS individual_id FROM supplier), k AS (SELECT * FROM target WHERE dup_keep), gal AS (SELECT * FROM k WHERE split_role = 'gallery')"""
_CORE = "core AS (SELECT * FROM target WHERE kpi_scope = 'kpi_core'), sealed AS (SELECT md5 FROM core WHERE split_fold = 'test')"
_GATE_SQL = {
    "g1_md5_in_one_role": "(SELECT count(*) FROM (SELECT md5 FROM gal INTERSECT SELECT md5 FROM k WHERE split_role = 'probe'))",
    "g2_closed_probes_in_gallery": "(SELECT count(DISTINCT individual_id) FROM k WHERE NOT is_new_open AND split_role = 'probe' AND individual_id NOT IN (SELECT individual_id FROM gal))",
    "g3_external_apart": "(SELECT count(*) FROM external WHERE role <> 'external') + (SELECT count(*) FROM target WHERE cohort = 'GCN')",
    "g4_one_survivor": "(SELECT count(*) FROM (SELECT dup_group FROM target WHERE dup_group >= 0 GROUP BY dup_group HAVING count_if(dup_keep) <> 1))",
    "g5_complete": "(SELECT count(*) FROM k WHERE split_scheme IS NULL)",
    "g6_folds": "(SELECT count(*) FROM k WHERE (split_role = 'probe' AND coalesce(split_fold NOT IN ('dev', 'test'), true)) OR (split_role = 'gallery' AND coalesce(split_fold <> 'train', true)))",
    "g7_paths": "(SELECT count(*) FROM target WHERE rel_path LIKE '/%')",
    "g8_one_cohort": "(SELECT count(*) FROM (SELECT individual_id FROM (SELECT individual_id, cohort FROM target UNION ALL SELECT individual_id, cohort FROM external) GROUP BY individual_id HAVING count(DISTINCT cohort) > 1 OR string_split(individual_id, '-')[1] <> min(cohort)))",
    "g9_dates": "(SELECT count(*) FROM target WHERE (date IS NOT NULL AND TRY_CAST(date AS DATE) IS NULL) OR date_source <> 'none')",
    "g10_dimensions": "(SELECT count(*) FROM target WHERE list_sort([width, height]) <> CASE cohort WHEN 'LAB' THEN [3000, 4000] ELSE [3024, 4032] END)",
    "g11_unique_survivors": "(SELECT count(*) FROM (SELECT md5 FROM (SELECT md5 FROM k UNION ALL SELECT md5 FROM external) GROUP BY md5 HAVING count(*) > 1))",
    "g12_stage_rules": """(SELECT count(*) FROM k WHERE split_fold = 'train' AND split_role <> 'gallery') + (SELECT count(*) FROM k WHERE is_new_open AND split_role <> 'probe')
 + (SELECT count(DISTINCT individual_id) FROM k WHERE is_new_open AND individual_id IN (SELECT individual_id FROM gal)) + (SELECT count(*) FROM (SELECT md5 FROM k WHERE split_fold = 'dev' INTERSECT SELECT md5 FROM k WHERE split_fold = 'test'))
 + (SELECT count(*) FROM target WHERE kpi_scope <> CASE cohort WHEN 'LAB' THEN 'temporal_aux' ELSE 'kpi_core' END)""",
}


@query(f"WITH {_FAULTY} " + " UNION ALL ".join(f"SELECT '{n}' AS gate, {str(gates.GATES[n][1]).lower()} AS hard, CAST({q} AS BIGINT) AS violations" for n, q in _GATE_SQL.items()))
def gates_manifest(spark, d):
    return gates.gate_counts(_gate_tables(spark, d), pipelines.names_of(pipelines.D_GATES))


_CROP_GATES = {
    "c1_crop_for_each_row": "(SELECT count(*) FROM core WHERE dup_keep AND NOT is_new_open AND split_role IN ('gallery', 'probe') AND split_fold IN ('train', 'dev') AND md5 NOT IN (SELECT md5 FROM crops))",
    "c2_no_orphan_crop": "(SELECT count(DISTINCT md5) FROM crops WHERE md5 NOT IN (SELECT md5 FROM target) AND md5 NOT IN (SELECT md5 FROM external))",
    "c3_never_mirrored": "(SELECT count(*) FROM crops WHERE mirrored)",
    "c4_one_geometry": "(SELECT count(*) FROM (SELECT 1 FROM crops WHERE variant <> 'full' HAVING count(DISTINCT canon_size) > 1 OR count(DISTINCT pipeline_version) > 1)) + (SELECT count(DISTINCT canon_size) FROM crops WHERE variant <> 'full' AND canon_size <> 256)",
    "c6_head_up": "(SELECT count(*) FROM (SELECT avg(CAST(head_y < cloaca_y AS DOUBLE)) AS s FROM crops WHERE variant = 'belly_oriented') WHERE s < 0.85)",
    "c7_fallback_budget": "(SELECT count(*) FROM (SELECT avg(CAST(crop_status NOT IN ('ok', 'clipped_after_rotation') AS DOUBLE)) AS s FROM crops WHERE variant NOT LIKE 'unroll%' AND md5 IN (SELECT md5 FROM core)) WHERE s > 0.10)",
    "c8_decision_stands": "(SELECT count(*) FROM vd WHERE decision <> 'belly_oriented')",
    "c9_sealed_crops": "(SELECT count(*) FROM crops WHERE md5 IN (SELECT md5 FROM sealed))",
}


@query(f"WITH {_FAULTY}, {_CORE}, {V.PHOTOS}, {V.CROPS}, {_VARIANT_METRICS} " + " UNION ALL ".join(f"SELECT '{n}' AS gate, {str(gates.GATES[n][1]).lower()} AS hard, CAST({q} AS BIGINT) AS violations" for n, q in _CROP_GATES.items()))
def gates_crops(spark, d):
    config = spark.createDataFrame([(256,)], "canon_size int")
    stated = spark.createDataFrame([("belly_oriented", "belly_oriented", 0.05, False)], "stated string, baseline string, alpha double, allow_at_1 boolean")
    tables = {"crops": V.crops(spark, d), "config": config, "ab_metrics": _variant_metrics(spark, d), "ab_decision": stated}
    return gates.gate_counts(_gate_tables(spark, d) | tables, pipelines.names_of(pipelines.C_GATES))


_SPOT_GATES = {
    "s1_spot_coverage": "(SELECT count(*) FROM (SELECT avg(CAST(n_spots >= 3 AS DOUBLE)) AS s FROM spots) WHERE s < 0.5)",
    "s5_matcher_decision": "(SELECT count(*) FROM sc WHERE worse OR p >= 0.05 OR c <= b)",
    "s6_detect_variant": "(SELECT count(*) FROM spots WHERE detect_variant = 'full')",
    "s7_sealed_spots": "(SELECT count(*) FROM spots WHERE md5 IN (SELECT md5 FROM sealed))",
    "e1_embedding_audit": "(SELECT count(*) FROM photos WHERE md5 IN (SELECT md5 FROM sealed))",
}


@query(f"WITH {_FAULTY}, {_CORE}, {V.PHOTOS}, spots AS (SELECT md5, id % 6 AS n_spots, CASE WHEN id % 90 = 0 THEN 'full' ELSE 'unroll_debend' END AS detect_variant FROM photos), {_VARIANT_METRICS}, sc AS (SELECT max(p) FILTER (WHERE k = 1) AS p, max(b) FILTER (WHERE k = 1) AS b, max(c) FILTER (WHERE k = 1) AS c, bool_or(v.recall < w.recall) AS worse FROM vp v JOIN (SELECT k AS wk, recall FROM vp WHERE variant = 'belly_oriented') w ON v.k = wk WHERE v.variant = 'unroll_ribbon') " + " UNION ALL ".join(f"SELECT '{n}' AS gate, {str(gates.GATES[n][1]).lower()} AS hard, CAST({q} AS BIGINT) AS violations" for n, q in _SPOT_GATES.items()))
def gates_spots_embeddings(spark, d):
    p = V.photos(spark, d)
    spots = p.select("md5", (F.col("id") % 6).alias("n_spots"), F.when(F.col("id") % 90 == 0, "full").otherwise("unroll_debend").alias("detect_variant"))
    stated = spark.createDataFrame([("matcher", 1)], "stated string, primary_k int")
    compared = decide.compare(_variant_hits(spark, d), (1, 5), "belly_oriented", "unroll_ribbon")
    tables = _gate_tables(spark, d) | {"spots": spots, "matcher_decision": stated, "matcher_compare": compared, "embeddings": p.withColumn("variant", F.lit("v"))}
    return gates.gate_counts(tables, pipelines.names_of([*pipelines.S_GATES, "e1"]))


# --- geometry and constellations -----------------------------------------------------


def _points(spark, d) -> DataFrame:
    return V.photos(spark, d).select("id", V.points(F.col("embedding"), 1, 8).alias("p"))


_P = f"p AS (SELECT id, e, {V.points_sql('e', 1, 8)} AS p FROM photos)"
_SUM = lambda body: f"list_sum(list_transform(p, lambda q: {body}))"


@query(f"WITH {V.PHOTOS}, {_P}, m AS (SELECT *, {_SUM('q.x')} / 8 AS mx, {_SUM('q.y')} / 8 AS my FROM p) SELECT id, round(sqrt({_SUM('(q.x - mx) * (q.x - mx) + (q.y - my) * (q.y - my)')} / 8), 6) AS scale FROM m")
def rms_scale(spark, d):
    return _points(spark, d).select("id", F.round(geometry.rms_scale(F.col("p")), 6).alias("scale"))


@query(f"WITH {V.PHOTOS} SELECT id, round(1.6 * cos(radians(37.0)), 6) AS a, round(1.6 * sin(radians(37.0)), 6) AS b, 12.0 AS tx, -5.0 AS ty FROM photos")
def similarity_fit(spark, d):
    p = _points(spark, d).withColumn("a", F.lit(1.6) * F.cos(F.radians(F.lit(37.0)))).withColumn("b", F.lit(1.6) * F.sin(F.radians(F.lit(37.0))))
    fit = geometry.fit_similarity(F.col("p"), geometry.apply_similarity(F.col("p"), F.col("a"), F.col("b"), F.lit(12.0), F.lit(-5.0)))
    return p.select("id", fit.alias("f")).select("id", *(F.round(f"f.{c}", 6).alias(c) for c in ("a", "b", "tx", "ty")))


@query(
    f"""WITH {V.PHOTOS}, a AS (SELECT id AS grp, k AS ord, e[2 * k + 1] AS x, e[2 * k + 2] AS y FROM photos, range(0, 8) t(k)), b AS (SELECT id AS grp, k AS ord, e[2 * k + 17] AS x, e[2 * k + 18] AS y FROM photos, range(0, 8) t(k)),
d AS (SELECT a.grp, a.ord AS a, b.ord AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS d FROM a JOIN b USING (grp)),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY grp, b ORDER BY d, a) AS rb FROM d) SELECT grp, CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(d, 6) AS d FROM r WHERE ra = 1 AND rb = 1 AND d <= 0.15"""
)
def mutual_nn(spark, d):
    p = V.photos(spark, d).select(F.col("id").alias("grp"), "embedding")
    side = lambda first: p.select("grp", F.posexplode(V.points(F.col("embedding"), first, 8)).alias("ord", "p")).select("grp", "ord", "p.x", "p.y")
    return constellation.mutual_nn_join(side(1), side(17), 0.15).select("grp", "a", "b", F.round("d", 6).alias("d"))


@query("SELECT p_partkey, round(n / greatest(a, b), 6) AS m_max, round(n / least(a, b), 6) AS m_min, round(n / (a + b - n), 6) AS m_jaccard, round(n / ((a + b) / 2), 6) AS m_mean FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS n, CAST(p_size + p_partkey % 5 AS DOUBLE) AS a, CAST(p_size + p_partkey % 3 AS DOUBLE) AS b FROM part)")
def match_score_norms(spark, d):
    n, k = F.col("p_size"), F.col("p_partkey")
    return V.table(spark, d, "part").select("p_partkey", *(F.round(geometry.match_score(n, n + k % 5, n + k % 3, m), 6).alias(f"m_{m}") for m in ("max", "min", "jaccard", "mean")))


_SPOTS = "s AS (SELECT id, list_transform(range(0, 12), lambda k: {'x': e[k + 1], 'y': e[k + 2], 'area': round(50 + 40 * e[k + 3], 3), 'score': round(0.5 + e[k + 4], 3)}) AS spots FROM photos)"


def _spots(spark, d) -> DataFrame:
    e = F.col("embedding")
    at = lambda k, o: F.element_at(e, k + o).cast("double")
    spot = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.struct(at(k, 1).alias("x"), at(k, 2).alias("y"), F.round(50 + 40 * at(k, 3), 3).alias("area"), F.round(0.5 + at(k, 4), 3).alias("score")))
    return V.photos(spark, d).select("id", "md5", spot.alias("spots"))


@query(
    f"""WITH {V.PHOTOS}, {_SPOTS}, u AS (SELECT id, unnest(spots) AS q FROM s), r AS (SELECT id, q, row_number() OVER (PARTITION BY id ORDER BY -sqrt(q.area) * q.score, -q.score, -q.area, q.x, q.y) AS rk FROM u WHERE q.score >= 0.45)
SELECT id, CAST(rk - 1 AS INT) AS pos, round(q.x, 6) AS x, q.score FROM r WHERE rk <= 5"""
)
def spot_topn(spark, d):
    top = _spots(spark, d).select("id", F.posexplode(geometry.top_spots(F.col("spots"), 5, 0.45)).alias("pos", "s"))
    return top.select("id", "pos", F.round("s.x", 6).alias("x"), "s.score")


@query()
def spots_json(spark, d):
    return _spots(spark, d).select("md5", sinks.spots_json(F.col("spots")).alias("spots"))


@query()
def constellation_match(spark, d):
    """All probe-gallery pairs with the default matcher and as many spots as it takes."""
    cfg = SpotConfig()
    p = V.photos(spark, d).withColumn("spots", V.points(F.col("embedding"), 1, cfg.top_n))
    probes = p.where("role = 'probe'").select("id", "spots")
    gallery = p.where("role = 'gallery'").select("id", "spots")
    return constellation.match_matrix(probes, gallery, cfg, pairs=False).select("pid", "gid", F.round("score", 6).alias("score"), "n")


_POLY = f"p AS (SELECT id, {V.points_sql('e', 1, 6)} AS p FROM photos)"


def _poly(spark, d) -> DataFrame:
    return V.photos(spark, d).select("id", V.points(F.col("embedding"), 1, 6).alias("p"))


@query(f"WITH {V.PHOTOS}, {_POLY}, b AS (SELECT id, list_min(list_transform(p, lambda q: q.x)) AS x0, list_max(list_transform(p, lambda q: q.x)) AS x1, list_min(list_transform(p, lambda q: q.y)) AS y0, list_max(list_transform(p, lambda q: q.y)) AS y1 FROM p) SELECT id, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h FROM b")
def polygon_bbox(spark, d):
    return _poly(spark, d).select("id", geometry.polygon_bbox(F.col("p")).alias("b")).select("id", *(F.round(f"b.{c}", 6).alias(c) for c in ("cx", "cy", "w", "h")))


@query(f"WITH {V.PHOTOS}, {_POLY} SELECT id, round(list_sum(list_transform(range(1, 7), lambda i: p[i].x * p[i % 6 + 1].y - p[i % 6 + 1].x * p[i].y)), 6) AS area2 FROM p")
def shoelace(spark, d):
    return _poly(spark, d).select("id", F.round(geometry.shoelace(F.col("p")), 6).alias("area2"))


@query(f"WITH {V.PHOTOS}, {_POLY} SELECT id, '0 ' || array_to_string(flatten(list_transform(p, lambda q: [printf('%.6f', q.x), printf('%.6f', q.y)])), ' ') AS seg, CASE WHEN {V.COIN.format(chr(39) + '42:' + chr(39) + ' || CAST(id AS VARCHAR)')} < 0.2 THEN 'val' ELSE 'train' END AS fold FROM p")
def yolo_lines(spark, d):
    return _poly(spark, d).select("id", geometry.seg_line(F.col("p")).alias("seg"), hashing.yolo_split(F.col("id").cast("string"), 0.2, 42).alias("fold"))


@query(f"WITH {V.PHOTOS}, a AS (SELECT id, degrees(atan2(e[2] - e[4], e[1] - e[3])) + 90 + 180 AS r FROM photos) SELECT id, round(r - 360 * floor(r / 360) - 180, 6) AS angle FROM a")
def head_up_angle(spark, d):
    x = [F.element_at("embedding", k).cast("double") for k in (1, 2, 3, 4)]
    return V.photos(spark, d).select("id", F.round(geometry.head_up_angle(*x), 6).alias("angle"))


@query(f"WITH {V.PHOTOS}, n AS (SELECT id, e, sqrt(list_dot_product(e, e)) + 1e-9 AS n FROM photos) SELECT id, round(e[1] / n, 6) AS first, round(e[64] / n, 6) AS last FROM n")
def l2_normalise(spark, d):
    v = geometry.l2_normalize(F.col("embedding"))
    return V.photos(spark, d).select("id", F.round(F.element_at(v, 1), 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last"))


@query(f"WITH {V.PHOTOS}, {V.sims_sql()} SELECT pid, gid, round(sim, 5) AS sim FROM sims")
def cosine_native(spark, d):
    """All pairs by matrix products; pairs with odd vectors by native expressions."""
    s = V.sides(spark, d)
    return retrieval.dot_matrix(s.probes, s.gallery, 5)


@query(
    """SELECT l_orderkey, l_linenumber, count(*) AS n, CASE WHEN l_linenumber % 7 = 0 THEN 'empty_mask' WHEN l_orderkey % 10 < 3 THEN 'low_seg_conf' WHEN l_orderkey % 11 = 0 THEN 'tiny_mask' WHEN l_linenumber % 5 = 0 THEN 'no_pose' WHEN l_orderkey % 13 < 3 THEN 'low_pose_conf' WHEN l_orderkey % 17 = 0 THEN 'clipped_after_rotation' ELSE 'ok' END AS status
FROM lineitem GROUP BY ALL"""
)
def crop_ladder(spark, d):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = V.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    ladder = raster.ladder(n % 7 != 0, F.when(k % 10 < 3, 0.1).otherwise(0.9), F.when(k % 11 == 0, 0.001).otherwise(0.2), n % 5 != 0, F.when(k % 13 < 3, 0.1).otherwise(0.9), F.when(k % 17 == 0, 0.05).otherwise(0.0))
    return rows.select("l_orderkey", "l_linenumber", "n", ladder["status"].alias("status"))


@query()
def embed_mock(spark, d):
    p = V.photos(spark, d).select("md5", F.col("identity").alias("individual_id"))
    return models.embed(p).select("md5", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("norm"))


# --- sources and sinks: a tree of files, and tables written and read again ---------------


def _media(k: int) -> tuple[str, bytes | None]:
    """Path and content of the file that stands for supplier ``k``; every second file is a PNG header, the rest no image; a fourth of a cohort's files are missing."""
    kind = k % 4
    if kind == 1:
        path = f"tk/{1 + k % 5}/trip 0225/IMG_{k}.JPG" if k % 3 == 0 else f"tk/{1 + k % 5}/{1 + k % 5:02d}-{k % 7:02d}-{1 + k % 12:02d}24.JPG.{k}.jpg" if k % 13 == 0 else f"tk/{1 + k % 5}/{1 + k % 5:02d}-{k}-{1 + k % 12:02d}24.JPG"
    elif kind == 2:
        path = f"lab/{1 + k % 28}.{1 + k % 12}.2025/{k}.{k % 3}.png"
    elif kind == 3:
        path = f"pw/{1 + k % 6}/{1 + k % 6:02d}-{k} ({k % 4}).JPG"
    else:
        path = f"gcn/Raw_Data/{k % 9}/{k}.JPG"
    if k % 16 == 8:
        return path, None
    body = f"photo {k}".encode()
    return path, b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 100 + k % 50, 80) + body if k % 3 == 1 else body


def _tree(spark, d) -> Config:
    """The media tree of all suppliers, and its configuration. The suppliers are a catalogue's size: a few files each thousand orders."""
    root = shared_folder(spark, "tree")
    lines = ["index,identity,file_name,recapture_id,survey,bbox,segmentation_mask_rle"]
    for row in V.table(spark, d, "supplier").select("s_suppkey").orderBy("s_suppkey").toLocalIterator():
        k = row[0]
        path, content = _media(k)
        if content is not None:
            put(spark, f"{root}/{path}", content)
        if k % 4 == 0:
            lines.append(f"{k},{k % 11},{path.removeprefix('gcn/')},r{k},s{k % 2},,{k}x{k + 1}:{'' if k % 5 == 0 else 'ab'}")
    put(spark, f"{root}/gcn/metadata.csv", "\n".join(lines).encode())
    put(spark, f"{root}/tk/1/.hidden.JPG", b"hidden")
    put(spark, f"{root}/tk/skip/1.JPG", b"skipped")
    names = (("TK", "tk", "target", ("skip",)), ("LAB", "lab", "target", ()), ("PW", "pw", "target", ()), ("GCN", "gcn", "external", ()))
    plain = root.removeprefix("file:")
    return Config(plain, 42, (".jpg", ".png"), tuple(DatasetSpec(n, folder, "", n, role, folder, skip) for n, folder, role, skip in names), (("TK-002", "TK-001"),))


_FILE = """m AS (SELECT s_suppkey AS k, s_suppkey % 4 AS kind FROM supplier), f AS (SELECT k, kind, CASE kind
  WHEN 1 THEN 'tk/' || (1 + k % 5) || '/' || CASE WHEN k % 3 = 0 THEN 'trip 0225/IMG_' || k || '.JPG' WHEN k % 13 = 0 THEN printf('%02d-%02d-%02d24.JPG.%d.jpg', 1 + k % 5, k % 7, 1 + k % 12, k) ELSE printf('%02d-%d-%02d24.JPG', 1 + k % 5, k, 1 + k % 12) END
  WHEN 2 THEN 'lab/' || (1 + k % 28) || '.' || (1 + k % 12) || '.2025/' || k || '.' || (k % 3) || '.png'
  WHEN 3 THEN 'pw/' || (1 + k % 6) || '/' || printf('%02d', 1 + k % 6) || '-' || k || ' (' || (k % 4) || ').JPG'
  ELSE 'gcn/Raw_Data/' || (k % 9) || '/' || k || '.JPG' END AS rel_path, k % 16 = 8 AS gone FROM m),
x AS (SELECT *, CASE WHEN k % 3 = 1 AND NOT gone THEN 100 + k % 50 ELSE 0 END AS width, CASE WHEN k % 3 = 1 AND NOT gone THEN 80 ELSE 0 END AS height, CASE WHEN gone THEN 'MISSING:' || rel_path WHEN k % 3 <> 1 THEN md5('photo ' || k) END AS md5 FROM f)"""
_SCANNED = ["rel_path", "individual_id", "width", "height"]


def _scan(spark, d, n: int) -> DataFrame:
    cfg = _tree(spark, d)
    spec = cfg.datasets[n]
    return files.SCANS[spec.layout](spark, cfg, spec).withColumn("md5", F.when(F.col("width") == 0, F.col("md5")))


@query(
    f"""WITH {_FILE} SELECT rel_path, printf('TK-%03d', 1 + k % 5) AS individual_id, width, height, md5, CASE WHEN k % 3 = 0 THEN '2025-02' WHEN k % 13 <> 0 THEN printf('2024-%02d', 1 + k % 12) END AS date,
  CASE WHEN k % 3 = 0 THEN 'subfolder' WHEN k % 13 <> 0 THEN 'filename' ELSE 'unparsed' END AS date_source, CASE WHEN k % 3 <> 0 AND k % 13 <> 0 THEN printf('%02d', k) END AS session FROM x WHERE kind = 1"""
)
def source_scan_tk(spark, d):
    return _scan(spark, d, 0).select(*_SCANNED, "md5", "date", "date_source", "session")


@query(f"WITH {_FILE} SELECT rel_path, printf('LAB-%03d', k) AS individual_id, width, height, md5, printf('2025-%02d-%02d', 1 + k % 12, 1 + k % 28) AS date, CAST(k % 3 AS INT) AS shot FROM x WHERE kind = 2")
def source_scan_lab(spark, d):
    return _scan(spark, d, 1).select(*_SCANNED, "md5", "date", "shot")


@query(f"WITH {_FILE} SELECT rel_path, printf('PW-%03d', 1 + k % 6) AS individual_id, width, height, md5, printf('%02d', k) AS session, CAST(k % 4 AS INT) AS shot FROM x WHERE kind = 3")
def source_scan_pw(spark, d):
    return _scan(spark, d, 2).select(*_SCANNED, "md5", "session", "shot")


@query(f"WITH {_FILE} SELECT rel_path, printf('GCN-%03d', k % 11) AS individual_id, width, height, md5, 'r' || k AS recapture_id, 's' || (k % 2) AS survey, CAST(k AS INT) AS rle_h, CAST(k + 1 AS INT) AS rle_w, k % 5 = 0 AS mask_empty FROM x WHERE kind = 0")
def source_scan_gcn(spark, d):
    return _scan(spark, d, 3).select(*_SCANNED, "md5", "recapture_id", "survey", "rle_h", "rle_w", "mask_empty")


@query(
    f"""WITH {_FILE}, n AS (SELECT rel_path, CASE kind WHEN 1 THEN 'TK' WHEN 2 THEN 'LAB' WHEN 3 THEN 'PW' ELSE 'GCN' END AS cohort, CASE WHEN kind = 0 THEN 'external' ELSE 'target' END AS role,
  CASE kind WHEN 1 THEN printf('TK-%03d', CASE WHEN k % 5 = 1 THEN 1 ELSE 1 + k % 5 END) WHEN 2 THEN printf('LAB-%03d', k) WHEN 3 THEN printf('PW-%03d', 1 + k % 6) ELSE printf('GCN-%03d', k % 11) END AS individual_id FROM x)
SELECT rel_path, cohort, role, individual_id, true AS dup_keep, CASE cohort WHEN 'GCN' THEN 'external' WHEN 'LAB' THEN 'temporal_aux' ELSE 'kpi_core' END AS kpi_scope FROM n"""
)
def manifest_of_tree(spark, d):
    """All layouts in one manifest, merged individuals, duplicates, scope; both manifests put together again."""
    target, external = pipelines.build_manifest(spark, _tree(spark, d))
    cols = ["rel_path", "cohort", "role", "individual_id", "dup_keep", "kpi_scope"]
    return target.select(*cols).unionByName(external.select(*cols))


def _written(spark, df: DataFrame, name: str, **options) -> str:
    path = f"{shared_folder(spark, name)}/{name}"
    df.write.options(header=True, escape='"', **options).csv(path)
    return path


def _as(spec: str, df: DataFrame) -> DataFrame:
    """The columns of a spec, null where ``df`` lacks them."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(spec).fields))


@query(f"WITH {V.SHOTS} SELECT md5, individual_id, cohort, rel_path, width, height, dup_keep, date FROM shots")
def source_manifest_csv(spark, d):
    """The target manifest of all events as ordered CSV, and read back by schema."""
    root = shared_folder(spark, "manifests")
    rows = V.shots(spark, d)
    sinks.write_manifest(_as(TARGET_SPEC, rows), f"{root}/manifest_target.csv", fmt="csv")
    sinks.write_manifest(_as(TARGET_SPEC, rows.limit(0)), f"{root}/manifest_external.csv", fmt="csv")
    return files.read_manifests(spark, root)[0].select("md5", "individual_id", "cohort", "rel_path", "width", "height", "dup_keep", "date")


@query(f"WITH {V.PHOTOS}, {V.CROPS} SELECT md5, variant, crop_path, crop_status, canon_size, mirrored, head_y, CAST(NULL AS DOUBLE) AS head_x FROM crops")
def source_crops_csv(spark, d):
    path = _written(spark, V.crops(spark, d).select("md5", "variant", "crop_path", "crop_status", "canon_size", "mirrored", "pipeline_version", "head_y"), "crops")
    return files.read_crops(spark, path).select("md5", "variant", "crop_path", "crop_status", "canon_size", "mirrored", "head_y", "head_x")


@query(f"WITH {V.PHOTOS}, {_SPOTS} SELECT md5(CAST(id AS VARCHAR)) AS md5, 12 AS n_spots, round(list_sum(list_transform(spots, lambda q: round(q.area, 1))), 1) AS area, round(list_sum(list_transform(spots, lambda q: q.score)), 3) AS score FROM s")
def source_spots_csv(spark, d):
    """Spots as JSON cells of a CSV, and read back by glob."""
    rows = _spots(spark, d).select("md5", F.size("spots").alias("n_spots"), sinks.spots_json(F.col("spots")).alias("spots"))
    path = _written(spark, rows, "spots")
    total = lambda c: F.aggregate("spots", F.lit(0.0), lambda acc, s: acc + s[c])
    return files.read_spots(spark, f"{path}/*.csv").select("md5", "n_spots", F.round(total("area"), 1).alias("area"), F.round(total("score"), 3).alias("score"))


@query(f"WITH {V.PHOTOS}, {_POLY} SELECT md5(CAST(id AS VARCHAR)) AS md5, round(list_sum(list_transform(p, lambda q: q.x)), 6) AS sum_x, 6 AS n, CASE WHEN id % 3 = 0 THEN 'manual' ELSE 'pseudo' END AS source, 'auto' AS status FROM p")
def source_labels_json(spark, d):
    """Labels as JSON by photo, and read back with defaults."""
    rows = _poly(spark, d).select(F.md5(F.col("id").cast("string")).alias("md5"), F.col("p").alias("belly_polygon"), F.when(F.col("id") % 3 == 0, "manual").alias("source"))
    path = f"{shared_folder(spark, 'labels')}/labels"
    rows.repartition(8).write.json(path)
    back = spark.read.schema(schema(LABEL_SPEC)).json(path)
    back = files.label_defaults(back)
    return back.select("md5", F.round(F.aggregate("belly_polygon", F.lit(0.0), lambda a, q: a + q["x"]), 6).alias("sum_x"), F.size("belly_polygon").alias("n"), "source", "status")


@query(f"WITH {V.PHOTOS} SELECT md5, role, cohort, round(e[1], 6) AS first, round(e[64], 6) AS last, 'crops/' || md5 || '.png' AS crop_path FROM photos WHERE role = 'probe'")
def source_embedding_set(spark, d):
    """An embedding set as a table, its held-out probes and their crops."""
    path = f"{shared_folder(spark, 'embeddings')}/set"
    rows = V.photos(spark, d).withColumns({"individual_id": F.col("identity"), "variant": F.lit("v")})
    _as(OOF_SPEC, rows).write.parquet(path)
    held = files.with_crop_paths(files.held_out(files.read_embeddings(spark, path)), "crops").where("NOT is_new")
    return held.select("md5", "role", "cohort", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last"), "crop_path")


#: A mask of 40 rows and 48 columns for each photo: a run in each row, from a start and of a width that the row and the photo give; some rows are empty.
_MASK_ROWS, _MASK_COLS = 40, 48
_RUN = "CASE WHEN (id + y) % 9 = 8 THEN NULL ELSE 8 + CAST((id * 7 + y * 3) % 11 AS INT) END AS a, CAST(6 + (id + y * y) % 7 AS INT) AS w"


def _mask(photo: int) -> np.ndarray:
    y, x = np.arange(_MASK_ROWS)[:, None], np.arange(_MASK_COLS)[None, :]
    a, w = 8 + (photo * 7 + y * 3) % 11, 6 + (photo + y * y) % 7
    return (x >= a) & (x < a + w) & ((photo + y) % 9 != 8)


def _masks(spark, d, run, spec: str) -> DataFrame:
    """What ``run`` (photo, mask) -> tuple gives for every photo."""
    ship(spark)

    def each(batches):
        for rows in batches:
            yield pd.DataFrame([(int(k), *run(int(k), _mask(int(k)))) for k in rows["id"]], columns=[c.split()[0] for c in ("id long, " + spec).split(", ")])

    return V.photos(spark, d).select("id").mapInPandas(each, f"id long, {spec}")


_ROWS = f"y AS (SELECT id, y, {_RUN} FROM photos, range(0, {_MASK_ROWS}) t(y)), b AS (SELECT id, min(a) AS x0, min(y) FILTER (WHERE a IS NOT NULL) AS y0, max(a + w) AS x1, max(y) FILTER (WHERE a IS NOT NULL) + 1 AS y1, sum(w) FILTER (WHERE a IS NOT NULL) AS area FROM y GROUP BY id)"


@query(
    f"""WITH {V.PHOTOS}, {_ROWS} SELECT id, x0, y0, x1, y1, area,
  greatest(0, x0 - CAST(round_even((x1 - x0) * 0.1, 0) AS INT)) AS m0, least({_MASK_COLS}, x1 + CAST(round_even((x1 - x0) * 0.1, 0) AS INT)) AS m1 FROM b"""
)
def mask_box(spark, d):
    """Tight box, box with a margin, and area of every photo's mask."""

    def run(_, m):
        wide = raster.tight_box(m, 0.1)
        return (*raster.tight_box(m), round(raster.area_frac(m) * m.size), wide[0], wide[2])

    return _masks(spark, d, run, "x0 int, y0 int, x1 int, y1 int, area long, m0 int, m1 int")


@query(
    f"""WITH {V.PHOTOS}, {_ROWS}, c AS (SELECT y.id, x, coalesce(x >= a AND x < a + w, false) AS on_, x * {_MASK_ROWS} + y AS place FROM y, range(0, {_MASK_COLS}) t(x)),
s AS (SELECT id, place, on_, on_ <> lag(on_, 1, false) OVER (PARTITION BY id ORDER BY place) AS starts FROM c), g AS (SELECT id, place, on_, sum(CAST(starts AS INT)) OVER (PARTITION BY id ORDER BY place) AS run FROM s),
r AS (SELECT id, run, count(*) AS n FROM g GROUP BY ALL) SELECT id, string_agg(n, ',' ORDER BY run) AS counts, true AS back FROM r GROUP BY id"""
)
def mask_rle(spark, d):
    """Run lengths in column order, and whether decoding gives the mask back."""

    def run(_, m):
        rle = raster.rle_encode(m)
        return ",".join(map(str, rle["counts"])), bool((raster.rle_decode(rle) == m).all())

    return _masks(spark, d, run, "counts string, back boolean")


@query(
    f"""WITH {V.PHOTOS}, {_ROWS}, e AS (SELECT y.id, y, y0, y1, a, w FROM y JOIN b USING (id) WHERE y >= y0 AND y < y1),
f AS (SELECT id, y, a + (w - 1) / 2.0 AS c, CAST(w AS DOUBLE) AS w FROM e WHERE a IS NOT NULL), i AS (SELECT e.id, e.y, coalesce(f.c, (p.c + n.c) / 2) AS c, coalesce(f.w, (p.w + n.w) / 2) AS w FROM e LEFT JOIN f USING (id, y) LEFT JOIN f p ON p.id = e.id AND p.y = e.y - 1 LEFT JOIN f n ON n.id = e.id AND n.y = e.y + 1)
SELECT id, count(*) AS n, round(avg(c), 6) AS middle, round(avg(w), 6) AS width FROM i GROUP BY id"""
)
def mask_centerline(spark, d):
    """Rows of the centre line, its mean (which the polynomial keeps) and the mean width, empty rows interpolated."""

    def run(_, m):
        rows, line, width = raster.centerline(m, None)
        return len(rows), round(float(line.mean()), 6), round(float(width.mean()), 6)

    return _masks(spark, d, run, "n long, middle double, width double")


@query(
    f"""WITH {V.PHOTOS}, {_ROWS}, k AS (SELECT y.id, y, a, w FROM y), z AS (SELECT id, y, x, coalesce(a IS NOT NULL AND x >= a AND x < a + w, false) AS m FROM k, range(0, {_MASK_COLS}) t(x)),
q AS (SELECT c.id, c.y, c.x, bool_and(coalesce(n.m, true)) AS left_ FROM z c LEFT JOIN z n ON n.id = c.id AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1 GROUP BY ALL) SELECT id, count_if(left_) AS n FROM q GROUP BY id"""
)
def mask_erode(spark, d):
    return _masks(spark, d, lambda _, m: (int(raster.erode(m, 1).sum()),), "n long")


@query(f"WITH {V.PHOTOS}, t AS (SELECT id, degrees(0.1) * (id % 30) AS deg FROM photos) SELECT id, round(cos(radians(deg)) * 3 + sin(radians(deg)) * 4 + 10, 6) AS x, round(-sin(radians(deg)) * 3 + cos(radians(deg)) * 4 + 20, 6) AS y FROM t")
def rotate_points(spark, d):
    p = geometry.rotate_point(F.lit(13.0), F.lit(24.0), F.lit(10.0), F.lit(20.0), F.degrees(F.lit(0.1)) * (F.col("id") % 30))
    return V.photos(spark, d).select("id", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


def bench(spark: SparkSession, d: str, name: str) -> int:
    return QUERIES[name](spark, d).count()
