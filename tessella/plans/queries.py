"""The registered queries of panel operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.functions.storage import new_folder, written
from tessella.operators import blocks as K
from tessella.operators import boxes as B
from tessella.operators import intervals as I
from tessella.operators import metrics as M
from tessella.operators import models as D
from tessella.operators import moments as G
from tessella.operators import panel as P
from tessella.operators import reports as R
from tessella.operators import spatial as X
from tessella.operators import spectra as E
from tessella.operators import splines as N
from tessella.plans import views as V
from tessella.plans import workloads as L
from tessella.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
C = F.col
# Functions, as columns need a session.
Y, HAT = lambda: C("y_true"), lambda: C("y_pred")


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, views: str = "", doubles: str = "") -> None:
    QUERIES[name] = lambda spark, d: V.rounded(run(spark, d))
    if sql is not None:
        ORACLE[name] = V.oracle(sql, views, doubles)


# ---------------------------------------------------------------- the flagship, and accuracy


def accuracy(s: SparkSession, d: str) -> DataFrame:
    """Both predictors by split and over all, as long records."""
    return R.long_records(M.by_split(V.scored(s, d), ["seed", "model"]), ["seed", "model", "split"], ["rmse", "mae", "r2"])


RAW = "sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae, 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) FILTER (y_pred IS NOT NULL) * count(y_pred)) AS r2"
BY_SPLIT = f"SELECT seed, model, CASE WHEN grouping(split) = 1 THEN 'full' ELSE split END AS split, {RAW} FROM scored GROUP BY GROUPING SETS ((seed, model, split), (seed, model))"
add("flagship_accuracy_records", accuracy, f"SELECT seed, model, split, metric, round_even(value, 6) AS value FROM (UNPIVOT ({BY_SPLIT}) ON rmse, mae, r2 INTO NAME metric VALUE value)", "scored", "value")
add("ag5_accuracy_by_split", lambda s, d: M.by_split(V.scored(s, d), ["seed", "model"]), BY_SPLIT, "scored", "rmse mae r2")


def _both_scales(s: SparkSession, d: str) -> DataFrame:
    """Metrics on the target's own scale and on that of the fit, standardised by train rows."""
    rows = P.standardised(V.scored(s, d).withColumn("y", Y()), "y", C("split") == "train")
    fit = rows.select("seed", "model", "split", C("y").alias("y_true"), ((HAT() - C("_mean")) / C("_sd")).alias("y_pred"))
    parts = [M.by_split(x, ["seed", "model"]).withColumn("scale", F.lit(n)) for n, x in (("raw", rows), ("fit", fit))]
    return parts[0].unionByName(parts[1])


SCALE = "(SELECT avg(y_true) AS m, stddev_pop(y_true) + 1e-12 AS sd FROM scored WHERE split = 'train')"
ON_FIT = f"(SELECT seed, model, split, (y_true - m) / sd AS y_true, (y_pred - m) / sd AS y_pred FROM scored, {SCALE})"
add("ag5_accuracy_on_both_scales", _both_scales, f"SELECT *, 'raw' AS scale FROM ({BY_SPLIT}) UNION ALL SELECT *, 'fit' AS scale FROM ({BY_SPLIT.replace('FROM scored', f'FROM {ON_FIT}')})", "scored", "rmse mae r2")
MASK = lambda: (C("t") % 2 == 0) & HAT().isNotNull()
for n, f, q in (
    ("ag1_rmse", M.rmse, "sqrt(avg((y_true - y_pred) ** 2) FILTER (t % 2 = 0))"),
    ("ag2_mae", M.mae, "avg(abs(y_true - y_pred)) FILTER (t % 2 = 0)"),
    ("ag3_r2", M.r2, "1 - sum((y_true - y_pred) ** 2) FILTER (t % 2 = 0) / (var_pop(y_true) FILTER (t % 2 = 0 AND y_pred IS NOT NULL) * count(y_pred) FILTER (t % 2 = 0))"),
):
    add(n, lambda s, d, f=f: V.scored(s, d).groupBy("model", "split").agg(f(Y(), HAT(), MASK()).alias("value")), f"SELECT model, split, {q} AS value FROM scored GROUP BY ALL", "scored", "value")
add("ag4_site_averaged", lambda s, d: M.site_averaged(V.scored(s, d).where(HAT().isNotNull()), ["model"], "y_true", "y_pred"),
    "SELECT model, sqrt(sum(e2) / sum(n)) AS rmse, sum(e1) / sum(n) AS mae, avg(CASE WHEN v > 0 THEN 1 - e2 / v WHEN e2 = 0 THEN 1 ELSE 0 END) AS r2 FROM (SELECT model, site_id, count(*) AS n, sum((y_true - y_pred) ** 2) AS e2, sum(abs(y_true - y_pred)) AS e1, var_pop(y_true) * count(*) AS v FROM scored WHERE y_pred IS NOT NULL GROUP BY ALL) GROUP BY model", "scored", "rmse mae r2")
add("ag6_corrected_rmse", lambda s, d: P.of_split(V.scored(s, d), "test").groupBy("model").agg(M.rmse(Y(), HAT() + 0.1 * (Y() - HAT())).alias("rmse")),
    "SELECT model, sqrt(avg((y_true - (y_pred + 0.1 * (y_true - y_pred))) ** 2)) AS rmse FROM scored WHERE split = 'test' GROUP BY model", "scored", "rmse")
add("ag7_fusion_score", lambda s, d: V.trials(s, d).select("seed", "trial", S.fusion_score(C("rmse"), C("covfrob"), (C("trial") % 4).cast("double")).alias("score")),
    "SELECT seed, trial, CASE WHEN trial % 4 = 0 THEN rmse ELSE rmse + covfrob / (trial % 4) END AS score FROM trials", "trials", "score")


def _soft(s: SparkSession, d: str) -> DataFrame:
    """Labels and logits with values right at the threshold."""
    rows = V.binary(s, d)
    return rows.withColumns({"y": F.when(C("site_id") % 5 == 0, 0.5).otherwise(C("y")), "z": F.when(C("site_id") % 7 == 0, 0.0).otherwise(C("z"))})


SOFT = "(SELECT seed, CASE WHEN site_id % 5 = 0 THEN 0.5 ELSE y END AS y, CASE WHEN site_id % 7 = 0 THEN 0 ELSE z END AS z FROM bin)"
HITS = "count(*) FILTER (y >= 0.5 AND z >= 0)"
CONFUSION = f"avg(((y >= 0.5) = (z >= 0))::INT) AS accuracy, coalesce(2.0 * {HITS} / nullif(2 * {HITS} + count(*) FILTER ((y >= 0.5) <> (z >= 0)), 0), 0) AS f1"
BY_SCORE = "SELECT seed, z, count(*) FILTER (y >= 0.5) AS pos, count(*) FILTER (y < 0.5) AS neg FROM {rows} GROUP BY ALL"
BELOW = "coalesce(sum(neg) OVER (PARTITION BY seed ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
AUC = f"SELECT seed, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, {BELOW} AS below FROM ({BY_SCORE})) GROUP BY seed"
add("ag8_binary_accuracy", lambda s, d: _soft(s, d).groupBy("seed").agg(*[c.alias(n) for n, c in M.confusion(C("y"), C("z")).items()]), f"SELECT seed, {CONFUSION} FROM {SOFT} GROUP BY seed", "bin", "accuracy f1")
add("ag9_auc", lambda s, d: M.auc(_soft(s, d), ["seed"], "y", "z"), AUC.format(rows=SOFT), "bin", "auc")
add("ag10_cross_entropy", lambda s, d: V.binary(s, d).groupBy("seed").agg(M.bce(C("y"), C("z")).alias("mean"), M.bce(C("y"), C("z"), mean=False, clamp=1e-7).alias("total")),
    "SELECT seed, avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) AS mean, sum(greatest(z, 0) - z * least(greatest(y, 1e-7), 1 - 1e-7) + ln(1 + exp(-abs(z)))) AS total FROM bin GROUP BY seed", "bin", "mean total")
add("ag11_calibration_error", lambda s, d: M.calibration_error(V.binary(s, d), ["seed"], "y", "p"),
    "SELECT seed, sum(abs(p - o)) / sum(n) AS ece FROM (SELECT seed, greatest(ceil(p * 15), 1) AS b, count(*) AS n, sum(p) AS p, sum(y) AS o FROM bin GROUP BY ALL) GROUP BY seed", "bin", "ece")
add("ag12_coverage", lambda s, d: V.intervals(s, d).groupBy("method", "split").agg(M.coverage(Y(), C("lower"), C("upper")).alias("cp")),
    "SELECT method, split, avg((y_true BETWEEN lower AND upper)::INT) AS cp FROM intervals WHERE lower IS NOT NULL GROUP BY ALL", "intervals", "cp")
add("ag13_mean_width", lambda s, d: V.intervals(s, d).groupBy("method", "split").agg(M.mean_width(C("lower"), C("upper")).alias("mpiw")),
    "SELECT method, split, avg(upper - lower) AS mpiw FROM intervals GROUP BY ALL", "intervals", "mpiw")
QS = lambda: [C(f"q{i}") for i in range(5)]
PIN = lambda q, i: f"greatest(({q} - 1) * (y_true - q{i}), {q} * (y_true - q{i}))"
add("ag14_check_loss", lambda s, d: V.quantile_predictions(s, d).groupBy("seed").agg(M.pinball(Y(), C("q3"), 0.75).alias("loss")), f"SELECT seed, avg({PIN(0.75, 3)}) AS loss FROM quant GROUP BY seed", "quant", "loss")
CRPS = "2 * (" + " + ".join(f"{{w{i}}} * avg({PIN(q, i)})" for i, q in enumerate(V.LEVELS)) + ")"
for kind in ("uniform", "trapezoidal"):
    add(f"ag15_crps_{kind}", lambda s, d, k=kind: V.quantile_predictions(s, d).groupBy("seed").agg(M.crps(Y(), QS(), V.LEVELS, k).alias("crps")),
        f"SELECT seed, {CRPS.format(**{f'w{i}': w for i, w in enumerate(M.quantile_weights(V.LEVELS, kind))})} AS crps FROM quant GROUP BY seed", "quant", "crps")
add("ag16_picp", lambda s, d: V.quantile_predictions(s, d).groupBy("seed").agg(M.picp(Y(), QS(), V.LEVELS).alias("picp")), "SELECT seed, avg((y_true BETWEEN q0 AND q4)::INT) AS picp FROM quant GROUP BY seed", "quant", "picp")
QICE = "(" + " + ".join(f"abs(avg((y_true BETWEEN q{i} AND q{i + 1})::INT) - 0.25)" for i in range(4)) + ") / 4"
add("ag17_qice", lambda s, d: V.quantile_predictions(s, d).groupBy("seed").agg(M.qice(Y(), QS()).alias("qice")), f"SELECT seed, {QICE} AS qice FROM quant GROUP BY seed", "quant", "qice")
add("ag18_evaluation_bundle", lambda s, d: V.quantile_predictions(s, d).groupBy("seed").agg(*M.bundle(Y(), QS(), V.LEVELS)),
    f"SELECT seed, avg((y_true - q2) ** 2) AS mse, avg(abs(y_true - q2)) AS mae, sqrt(avg((y_true - q2) ** 2)) AS rmse, avg({PIN(0.5, 2)}) AS check_loss, {CRPS.format(**{f'w{i}': 0.2 for i in range(5)})} AS crps, avg((y_true BETWEEN q0 AND q4)::INT) AS picp_90, avg((y_true BETWEEN q0 AND q4)::INT) AS coverage_90, {QICE} AS qice FROM quant GROUP BY seed", "quant", "mse mae rmse check_loss crps picp_90 coverage_90 qice")
add("ag19_site_interval", lambda s, d: M.site_interval(V.binary(s, d), ["seed"], "y", "z", "var"),
    "SELECT seed, avg((share BETWEEN lo AND hi)::INT) AS coverage, avg(hi - lo) AS width FROM (SELECT seed, share, 1 / (1 + exp(-(m - 1.96 * e))) AS lo, 1 / (1 + exp(-(m + 1.96 * e))) AS hi FROM (SELECT seed, site_id, avg(z) AS m, sqrt(avg(var) / count(*)) AS e, avg(y) AS share FROM bin GROUP BY ALL)) GROUP BY seed", "bin", "coverage width")


def _sample_interval(s: SparkSession, d: str) -> DataFrame:
    low, high = I.logistic_normal(C("z"), C("var"))
    return V.binary(s, d).groupBy("seed").agg(M.coverage(C("y"), low, high).alias("coverage"), M.mean_width(low, high).alias("width"), M.class_coverage(C("y"), low, high).alias("not_ruled_out"))


Z95 = S.normal_z(0.05)
add("ag20_sample_interval", _sample_interval, f"SELECT seed, avg((y BETWEEN lo AND hi)::INT) AS coverage, avg(hi - lo) AS width, avg(CASE WHEN y > 0.5 THEN hi >= 0.5 ELSE lo <= 0.5 END::INT) AS not_ruled_out FROM (SELECT seed, y, 1 / (1 + exp(-(z - {Z95} * sqrt(var)))) AS lo, 1 / (1 + exp(-(z + {Z95} * sqrt(var)))) AS hi FROM bin) GROUP BY seed", "bin", "coverage width not_ruled_out")
TIME_ROWS = "SELECT seed, method, t, count(y_pred) AS n_sites, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, 100 * avg((y_true BETWEEN lower AND upper)::INT) FILTER (lower IS NOT NULL) AS cp, avg(upper - lower) AS mpiw FROM intervals GROUP BY ALL"
add("ag21_time_diagnostics", lambda s, d: M.time_rows(V.intervals(s, d), ["seed", "method"]), TIME_ROWS, "intervals", "rmse cp mpiw")
SITE_ROWS = "SELECT seed, method, site_id, count(z) AS n, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, sqrt(avg(var)) AS pred_sd, avg(z) AS z_mean, stddev_pop(z) AS z_sd, sqrt(avg(z * z)) AS z_rms, avg(abs(z)) AS z_abs, 100 * avg((abs(z) <= 1.96)::INT) AS cp FROM (SELECT *, (y_true - y_pred) / sqrt(greatest(var, 1e-12)) AS z FROM intervals WHERE split = 'test') GROUP BY ALL"
add("ag22_site_diagnostics", lambda s, d: M.site_rows(P.of_split(V.intervals(s, d), "test"), ["seed", "method"]), SITE_ROWS, "intervals", "rmse pred_sd z_mean z_sd z_rms z_abs cp")
add("ag23_method_summary", lambda s, d: M.time_rows(V.intervals(s, d), ["seed", "method"]).groupBy("method").agg(*[x for c in ("rmse", "cp", "mpiw") for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"))]),
    "SELECT method, " + ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_sd" for c in ("rmse", "cp", "mpiw")) + f" FROM ({TIME_ROWS}) GROUP BY method", "intervals", "rmse_mean rmse_sd cp_mean cp_sd mpiw_mean mpiw_sd")


def _raw_variance(s: SparkSession, d: str) -> DataFrame:
    """Variances of the standardised target at each site, brought back to its own scale."""
    rows = P.standardised(V.split_panel(s, d), "z", C("split") == "train")
    return rows.where("split = 'train'").groupBy("site_id").agg(F.var_samp("z").alias("var"), F.first("_sd").alias("_sd")).select("site_id", P.variance_to_raw(C("var")).alias("var"))


add("ag24_raw_variance", _raw_variance, "SELECT site_id, var_samp(z) AS var FROM split_panel WHERE split = 'train' GROUP BY site_id", "split_panel", "var")
add("ag25_feature_correlation", lambda s, d: V.binary(s, d).unpivot(["seed", "y"], ["z", "p", "var"], "feature", "x").groupBy("feature").agg(F.corr("y", "x").alias("r")),
    "SELECT feature, corr(y, x) AS r FROM (UNPIVOT (SELECT y, z, p, var FROM bin) ON z, p, var INTO NAME feature VALUE x) GROUP BY feature", "bin", "r")

# ---------------------------------------------------------------- filters, scaling, splits, samples

add("pf1_drop_non_finite", lambda s, d: P.drop_non_finite(V.panel(s, d).withColumn("z", C("z") / F.when(C("t") % 7 != 0, 1.0).otherwise(float("inf")) + F.when(C("t") % 5 == 0, float("nan")).otherwise(0.0))).groupBy("t").agg(F.count("*").alias("n"), F.avg("z").alias("z")),
    "SELECT t, count(*) AS n, avg(CASE WHEN t % 7 = 0 THEN 0 ELSE z END) AS z FROM panel WHERE t % 5 <> 0 GROUP BY t", "panel", "z")
add("pf2_keep_last", lambda s, d: P.keep_last(V.panel(s, d), 10), "SELECT site_id, k - n + least(n, 10) AS t, z FROM panel JOIN times USING (t) WHERE k >= n - 10", "times", "z")
add("pf3_scaled_coordinates", V.sites, "SELECT * FROM sites", "sites", "x y")
add("pf4_normalised_time", lambda s, d: P.normalised_time(V.panel(s, d), C("site_id") % 5 != 0).select("site_id", "t", "t_norm"),
    "SELECT site_id, t, (t - lo) / (hi - lo + 1e-12) AS t_norm FROM panel, (SELECT min(t) AS lo, max(t) AS hi FROM panel WHERE site_id % 5 <> 0)", "panel", "t_norm")
add("pf5_standardised_target", lambda s, d: P.standardised(V.split_panel(s, d), "z", C("split") == "train").select("site_id", "t", "z", P.to_raw(C("z")).alias("raw")),
    "SELECT site_id, t, (z - m) / (sd + 1e-12) AS z, z AS raw FROM split_panel, (SELECT avg(z) AS m, stddev_pop(z) AS sd FROM split_panel WHERE split = 'train')", "split_panel", "z raw")
for n, kind, q in (("pf6_standard_scaler", "standard", "avg({c}), stddev_pop({c})"), ("pf7_minmax_scaler", "minmax", "min({c}), max({c}) - min({c})")):
    add(n, lambda s, d, k=kind: P.fit_scaler(V.binary(s, d), ["z", "p", "var"], k), " UNION ALL ".join(f"SELECT '{c}' AS name, '{kind}' AS kind, {q.format(c=c).replace(', ', ' AS centre, ')} AS scale FROM bin" for c in ("z", "p", "var")), "bin", "centre scale")
Z_STATS = "(SELECT avg(z) AS m, stddev_pop(z) AS sd FROM split_panel WHERE split = 'train')"
_scaler = lambda s, d: P.fit_scaler(V.split_panel(s, d), ["z"], where=C("split") == "train")
add("pf8_transform", lambda s, d: P.transform(V.split_panel(s, d), _scaler(s, d), ["z"]), f"SELECT site_id, t, (z - m) / sd AS z, split FROM split_panel, {Z_STATS}", "split_panel", "z")
add("pf9_inverse_transform", lambda s, d: P.inverse_transform(P.transform(V.split_panel(s, d), _scaler(s, d), ["z"]), _scaler(s, d), ["z"]), "SELECT site_id, t, z, split FROM split_panel", "split_panel", "z")
add("pf10_scaler_info", _scaler, f"SELECT 'z' AS name, 'standard' AS kind, m AS centre, sd AS scale FROM {Z_STATS}", "split_panel", "centre scale")
add("pf11_residual", lambda s, d: V.binary(s, d).groupBy("seed").agg(F.avg(S.residual(C("y"), C("z"), "binary")).alias("logit"), F.avg(S.residual(C("y"), C("p"))).alias("plain")),
    "SELECT seed, avg(ln(least(greatest(y, 1e-7), 1 - 1e-7) / (1 - least(greatest(y, 1e-7), 1 - 1e-7))) - z) AS logit, avg(y - p) AS plain FROM bin GROUP BY seed", "bin", "logit plain")
CENTRED = "SELECT site_id, t, z - m AS z, split FROM split_panel JOIN (SELECT site_id, avg(z) AS m FROM split_panel WHERE split = 'train' GROUP BY site_id) USING (site_id)"
_centred = lambda s, d: P.centred_by_site(V.split_panel(s, d), "z", C("split") == "train")
add("pf12_centred_by_site", _centred, CENTRED, "split_panel", "z")
add("pf13_split_rows", lambda s, d: P.only(P.of_split(V.split_panel(s, d), "val", "test"), V.panel(s, d).where("t % 3 = 0"), ["t"]), "SELECT * FROM split_panel WHERE split <> 'train' AND t % 3 = 0", "split_panel", "z")
add("pf14_long_records", lambda s, d: R.long_records(V.trials(s, d), ["seed", "trial"], ["rmse", "covfrob"]), "SELECT seed, trial, metric, round_even(value, 6) AS value FROM (UNPIVOT (SELECT seed, trial, rmse, covfrob FROM trials) ON rmse, covfrob INTO NAME metric VALUE value)", "trials", "value")
add("pf15_backbone_and_stage", lambda s, d: R.backbone_and_stage(V.results(s, d)).where("backbone = 'res_net'").groupBy("backbone", "stage").agg(F.count("*").alias("n")), "SELECT 'res_net' AS backbone, split_part(model, '_', 3) AS stage, count(*) AS n FROM results WHERE model LIKE 'res_net%' GROUP BY ALL", "results")
add("sp1_contiguous_split", lambda s, d: P.split_contiguous(V.panel(s, d)), "SELECT * FROM splits", "splits")
add("sp2_attached_split", V.split_panel, "SELECT site_id, t, z, split FROM split_panel", "split_panel", "z")
add("sp3_truncated_split", lambda s, d: P.split_truncated(V.monthly(s, d)), "SELECT t, CASE WHEN k < floor(n * 0.7::DOUBLE) THEN 'train' WHEN k < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM monthly))", "monthly")


def _split_and_scale(s: SparkSession, d: str) -> DataFrame:
    own = V.monthly(s, d)
    rows = P.attach_split(own, P.split_truncated(own))
    return P.transform(rows, P.fit_scaler(rows, ["z"], where=C("split") == "train"), ["z"]).groupBy("split").agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.stddev_pop("z").alias("sd"))


add("sp4_split_and_scale", _split_and_scale, "SELECT split, count(*) AS n, avg((z - m0) / s0) AS m, stddev_pop((z - m0) / s0) AS sd FROM rows, (SELECT avg(z) AS m0, stddev_pop(z) AS s0 FROM rows WHERE split = 'train') GROUP BY split".replace("rows", "(SELECT z, CASE WHEN k < floor(n * 0.7::DOUBLE) THEN 'train' WHEN k < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM monthly JOIN (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM monthly)) USING (t))"), "monthly", "m sd")
DRAW = "(SELECT site_id, row_number() OVER (ORDER BY md5('{seed}|' || site_id), site_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT site_id FROM panel))"
add("sp5_sampled_sites", lambda s, d: P.sample_sites(V.panel(s, d), 0.3, 7), f"SELECT p.* FROM panel p SEMI JOIN (SELECT site_id FROM {DRAW.format(seed=7)} WHERE place < greatest(1, round_even(n * 0.3::DOUBLE, 0))) USING (site_id)", "panel", "z")
HELD = f"(SELECT site_id FROM {DRAW.format(seed=3)} WHERE place < greatest(1, least(n - 1, round_even(n * 0.2::DOUBLE, 0))))"
add("sp6_held_out_sites", lambda s, d: P.split_sites(V.panel(s, d), 0.2, 3)[1], f"SELECT p.* FROM panel p SEMI JOIN {HELD} USING (site_id)", "panel", "z")
add("sp7_nested_roles", lambda s, d: P.nested_roles(V.split_panel(s, d), 0.2, 3).groupBy("role", "split").agg(F.count("*").alias("n")), f"SELECT CASE WHEN h.site_id IS NULL THEN 'fit' WHEN split = 'val' THEN 'calibrate' WHEN split = 'test' THEN 'score' ELSE 'hidden' END AS role, split, count(*) AS n FROM split_panel LEFT JOIN {HELD} h USING (site_id) GROUP BY ALL", "split_panel")
IMG = "(SELECT image_id, row_number() OVER (ORDER BY md5('5|' || image_id), image_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT image_id FROM ann))"
add("sp8_entity_split", lambda s, d: P.split_entities(V.annotations(s, d), "image_id", 0.7, 0.15, 5), f"SELECT image_id, CASE WHEN place < floor(n * 0.7::DOUBLE) THEN 'train' WHEN place < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM {IMG}", "ann")
add("sp9_at_most", lambda s, d: P.at_most(V.annotations(s, d), "image_id", 40, 5).groupBy("image_id").agg(F.count("*").alias("n")), f"SELECT image_id, count(*) AS n FROM ann SEMI JOIN (SELECT image_id FROM {IMG} WHERE place < 40) USING (image_id) GROUP BY image_id", "ann")

# ---------------------------------------------------------------- joins, tables, windows, top-k

add("jn1_aligned", lambda s, d: P.align(V.panel(s, d), V.panel(s, d).where("t % 4 <> 0").withColumnRenamed("z", "p")), "SELECT site_id, t, z, CASE WHEN t % 4 <> 0 THEN z END AS p FROM panel", "panel", "z p")
_half = lambda s, d, k: V.trials(s, d).groupBy("seed").agg(F.avg(C("rmse") * k).alias("rmse"), F.avg(C("covfrob") * C("seed") * k).alias("covfrob"))
add("jn2_largest_difference", lambda s, d: R.largest_difference(_half(s, d, 1), _half(s, d, 1.25), ["rmse", "covfrob"]), "SELECT max(abs(0.25 * m)) AS rmse, max(abs(0.25 * c)) AS covfrob FROM (SELECT avg(rmse) AS m, avg(covfrob * seed) AS c FROM trials GROUP BY seed)", "trials", "rmse covfrob")
add("jn3_backfill", lambda s, d: R.backfill(V.trials(s, d), _half(s, d, 2), ["rmse"]).select("seed", "trial", "rmse"), "SELECT seed, trial, m AS rmse FROM trials JOIN (SELECT seed, avg(rmse * 2) AS m FROM trials GROUP BY seed) USING (seed)", "trials", "rmse")
add("jn4_seed_counts", lambda s, d: R.seed_counts(V.trials(s, d).where("seed > 2"), V.trials(s, d)), "SELECT seed, count(*) FILTER (seed > 2) AS n FROM trials GROUP BY seed", "trials")
add("jn5_pairs_within", lambda s, d: X.pairs_within(V.sites(s, d), 0.1), "SELECT i, j, h FROM (SELECT a.site_id AS i, b.site_id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS h FROM sites a JOIN sites b ON a.site_id < b.site_id) WHERE h <= 0.1", "sites", "h")
NEAR = "SELECT a.site_id AS i, b.site_id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS h FROM sites a JOIN sites b ON a.site_id <> b.site_id"
add("jn6_nearest_sites", lambda s, d: X.neighbour_distance(V.sites(s, d)), f"SELECT i AS site_id, avg(h) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY h, j) AS r FROM ({NEAR})) WHERE r <= 4 GROUP BY i", "sites", "distance")
add("jn7_nearest_key", lambda s, d: X.nearest_key(V.trials(s, d).select("tau1", "tau2").distinct(), V.trials(s, d).select((C("tau1") * 1.7 - 3).alias("tau1"), (C("tau2") / 1.3).alias("tau2")).distinct()),
    "SELECT w1, w2, b.tau1, b.tau2 FROM (SELECT w1, w2, arg_min({'tau1': tau1, 'tau2': tau2}, [(log10(tau1 + 1e-12) - log10(w1 + 1e-12)) ** 2 + (log10(tau2 + 1e-12) - log10(w2 + 1e-12)) ** 2, tau1, tau2]) AS b FROM (SELECT DISTINCT tau1, tau2 FROM trials), (SELECT DISTINCT tau1 * 1.7::DOUBLE - 3 AS w1, tau2 / 1.3::DOUBLE AS w2 FROM trials) GROUP BY w1, w2)", "trials", "w1 w2")
_boxes = lambda s, d: V.annotations(s, d).select(B.image_key(C("image_id")).alias("image_id"), B.parsed(C("bbox")).alias("boxes"))
add("jn8_covered_cells", lambda s, d: B.covered_cells(_boxes(s, d), "image_id", "boxes"), "SELECT * FROM cells", "cells")
ROWS = [(i, m) for i, m in enumerate(("vit_full", "vit_base", "res_net_full", "res_net_base", "none_base"))]
CELL = "CASE WHEN max(CASE WHEN metric = '{m}' THEN mean END) IS NULL THEN '--' ELSE printf('%.{g}f (%.{g}f)', max(CASE WHEN metric = '{m}' THEN mean * {k} END), max(CASE WHEN metric = '{m}' THEN se * {k} END)) END AS {m}"
TEXT = ", ".join(CELL.format(m=m, g=2 if m == "r2" else 4, k=100 if m == "r2" else 1) for m in ("rmse", "mae", "r2"))
MEANS = "SELECT model, metric, avg(value) AS mean, coalesce(stddev_samp(value) / sqrt(count(*)), 0) AS se, count(*) AS n FROM results WHERE split = 'test' GROUP BY ALL"


def _cells(s: SparkSession, d: str) -> DataFrame:
    return R.cell_table(R.test_rows(V.results(s, d)), s.createDataFrame(ROWS, "place int, model string"), ["model"], ["rmse", "mae", "r2"])


add("jn9_rt3_report_table", _cells, f"SELECT place, r.model, {TEXT}, coalesce(max(n_seeds), 0) AS n_seeds FROM (VALUES {', '.join(map(str, ROWS))}) r(place, model) LEFT JOIN ({MEANS}) m USING (model) LEFT JOIN (SELECT model, count(DISTINCT seed) AS n_seeds FROM results WHERE split = 'test' GROUP BY model) USING (model) GROUP BY place, r.model", "results")
COVARIANCE = "SELECT a.site_id AS i, b.site_id AS j, CASE WHEN count(*) >= 2 THEN covar_samp(a.z, b.z) END AS v FROM {a} a JOIN {b} b USING (t) GROUP BY ALL"
GRAM = "SELECT a.site_id AS i, b.site_id AS j, sum(a.z * b.z) AS v, count(*) AS n FROM panel a JOIN panel b USING (t) GROUP BY ALL"
COV = COVARIANCE.format(a="panel", b="panel")
add("jn10_frobenius_distance", lambda s, d: K.distance_to_lower_gram(V.panel(s, d)), f"SELECT sqrt(sum((coalesce(a.v, 0) - coalesce(b.v, 0)) ** 2)) AS distance FROM ({COV}) a FULL JOIN (SELECT * FROM ({GRAM}) WHERE i >= j) b USING (i, j)", "panel", "distance")
add("rt1_mean_and_error", lambda s, d: R.mean_and_error(R.test_rows(V.results(s, d)), ["model", "metric"]), MEANS, "results", "mean se")
add("rt2_mean_and_deviation", lambda s, d: R.mean_and_deviation(V.results(s, d), ["model", "metric"]).withColumn("text", S.mean_sd_text(C("mean"), C("sd"), 2)), "SELECT model, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, printf('%.2f ± %.2f', avg(value), coalesce(stddev_samp(value), 0)) AS text FROM results GROUP BY ALL", "results", "mean sd")
PAIR = [(i, b, g) for i, (b, g) in enumerate((b, g) for b in ("res_net", "vit") for g in ("base", "full"))]
add("rt4_backbone_table", lambda s, d: R.cell_table(R.backbone_and_stage(R.test_rows(V.results(s, d))), s.createDataFrame(PAIR, "place int, backbone string, stage string"), ["backbone", "stage"], ["rmse", "mae", "r2"]),
    f"SELECT place, r.backbone, r.stage, {TEXT}, max(n_seeds) AS n_seeds FROM (VALUES {', '.join(map(str, PAIR))}) r(place, backbone, stage) JOIN ({MEANS}) m ON m.model = backbone || '_' || stage JOIN (SELECT model, count(DISTINCT seed) AS n_seeds FROM results WHERE split = 'test' GROUP BY model) s ON s.model = m.model GROUP BY place, r.backbone, r.stage", "results")
add("rt5_one_backbone_table", lambda s, d: R.cell_table(R.backbone_and_stage(R.test_rows(V.results(s, d))).where("backbone = 'vit'"), s.createDataFrame([(0, "base"), (1, "full")], "place int, stage string"), ["stage"], ["mpiw"]),
    "SELECT place, stage, CASE WHEN mean IS NULL THEN '--' ELSE printf('%.4f (%.4f)', mean, se) END AS mpiw, n_seeds FROM (VALUES (0, 'base'), (1, 'full')) r(place, stage) LEFT JOIN (" + MEANS + ") m ON m.model = 'vit_' || stage AND metric = 'mpiw' LEFT JOIN (SELECT model, count(DISTINCT seed) AS n_seeds FROM results WHERE split = 'test' GROUP BY model) s ON s.model = 'vit_' || stage", "results")
add("rt6_test_rows", lambda s, d: R.test_rows(V.results(s, d)), "SELECT * FROM results WHERE split = 'test'", "results", "value")
_wide = lambda s, d: V.results(s, d).groupBy("seed", "model").pivot("metric", ["rmse", "mae"]).agg(F.avg("value"))
WIDE = "SELECT seed, model, avg(value) FILTER (metric = 'rmse') AS rmse, avg(value) FILTER (metric = 'mae') AS mae FROM results GROUP BY ALL"
add("rt7_gain_over_baseline", lambda s, d: R.against_baseline(_wide(s, d), "vit_base", ["rmse"]), f"SELECT model, rmse, 100 * (b - rmse) / b AS rmse_gain FROM (SELECT model, avg(rmse) AS rmse FROM ({WIDE}) GROUP BY model), (SELECT avg(rmse) AS b FROM ({WIDE}) WHERE model = 'vit_base')", "results", "rmse rmse_gain")
T_STAT = f"SELECT count(*) AS n, avg(x.rmse - y.rmse) / (stddev_samp(x.rmse - y.rmse) / sqrt(count(*))) AS t FROM (SELECT * FROM ({WIDE}) WHERE model = 'res_net_base') x JOIN (SELECT * FROM ({WIDE}) WHERE model = 'vit_base') y USING (seed)"
# The closed form of Student's distribution with 9 degrees of freedom, as there are ten seeds.
P_VALUE = "1 - 2 / pi() * (a + sin(a) * (cos(a) + 2.0::DOUBLE / 3 * cos(a) ** 3 + 8.0::DOUBLE / 15 * cos(a) ** 5 + 48.0::DOUBLE / 105 * cos(a) ** 7))"
add("rt8_paired_t", lambda s, d: R.paired_test(_wide(s, d), "res_net_base", "vit_base", "rmse"), f"SELECT n, t, {P_VALUE} AS p, {P_VALUE} < 0.05 AS significant FROM (SELECT *, atan(abs(t) / 3) AS a FROM ({T_STAT}))", "results", "t p")
add("rt9_time_summary", lambda s, d: R.time_summary(V.read(s, d, "orders").select(C("o_orderpriority").alias("function"), C("o_orderstatus").alias("model"), (C("o_totalprice") / 1000).alias("wall_time_s"))), "SELECT o_orderpriority AS function, o_orderstatus AS model, avg(o_totalprice / 1000) AS mean, stddev_pop(o_totalprice / 1000) AS sd, count(*) AS n FROM orders GROUP BY ALL", "", "mean sd")
add("rt10_time_per_trial", lambda s, d: R.per_trial(V.trials(s, d).groupBy("seed").agg(F.sum("rmse").alias("total_s"), F.count("*").alias("n_trials"))), "SELECT seed, sum(rmse) AS total_s, count(*) AS n_trials, sum(rmse) / count(*) AS time_per_trial FROM trials GROUP BY seed", "trials", "total_s time_per_trial")
add("rt11_quartiles", lambda s, d: R.quartiles(V.trials(s, d), "tau1", "rmse"), "SELECT tau1, quantile_cont(rmse, 0.25) AS q25, quantile_cont(rmse, 0.5) AS median, quantile_cont(rmse, 0.75) AS q75 FROM trials GROUP BY tau1", "trials", "tau1 q25 median q75")
add("rt11_best_penalty", lambda s, d: R.best_of(R.quartiles(V.trials(s, d), "tau1", "rmse"), "tau1", "median").select("tau1"), "SELECT tau1 FROM trials GROUP BY tau1 ORDER BY quantile_cont(rmse, 0.5) DESC, tau1 LIMIT 1", "trials")
add("rt12_representative_seed", lambda s, d: R.representative_seed(V.trials(s, d), "rmse"), "SELECT seed FROM (SELECT seed, avg(rmse) AS m FROM trials GROUP BY seed), (SELECT median(m) AS mid FROM (SELECT avg(rmse) AS m FROM trials GROUP BY seed)) ORDER BY round(abs(m - mid), 9), seed LIMIT 1", "trials")
add("rt13_off_diagonal", lambda s, d: K.off_diagonal(V.panel(s, d), 0.95), f"SELECT quantile_cont(abs(v), 0.95) AS value FROM ({COV}) WHERE i <> j", "panel", "value")
add("rt14_means_by_split", lambda s, d: V.results(s, d).groupBy("split", "metric").agg(F.avg("value").alias("value")), "SELECT split, metric, avg(value) AS value FROM results GROUP BY ALL", "results", "value")
add("wn1_site_and_time_index", lambda s, d: P.with_index(P.with_index(V.monthly(s, d), ["t"], "t_idx"), ["site_id"], "site_idx").select("site_id", "t", "t_idx", "site_idx"), "SELECT site_id, t, dense_rank() OVER (ORDER BY t) - 1 AS t_idx, dense_rank() OVER (ORDER BY site_id) - 1 AS site_idx FROM monthly", "monthly")
_spec = lambda s, d: V.trials(s, d).groupBy("seed").agg(F.sum("rmse").alias("eigenvalue")).select((F.row_number().over(Window.orderBy(C("eigenvalue").desc()))).alias("component"), "eigenvalue")
SPEC = "(SELECT row_number() OVER (ORDER BY e DESC) AS component, e AS eigenvalue FROM (SELECT seed, sum(rmse) AS e FROM trials GROUP BY seed))"
EXPL = f"(SELECT component, eigenvalue, sum(eigenvalue) OVER (ORDER BY component) / sum(eigenvalue) OVER () AS explained FROM {SPEC})"
add("wn2_explained_variance", lambda s, d: R.explained(_spec(s, d)), f"SELECT * FROM {EXPL}", "trials", "eigenvalue explained")
add("wn3_components_for_share", lambda s, d: R.components_for(_spec(s, d), 0.8).join(R.effective_rank(_spec(s, d))), f"SELECT min(component) FILTER (explained >= 0.8) AS k, count(*) AS rank FROM {EXPL}", "trials")
add("wn4_selected_rank", lambda s, d: R.selected_rank(_spec(s, d), 1000.0, 40), f"SELECT max(component) AS rank, arg_max(lo, component) AS noise FROM (SELECT component, eigenvalue, greatest(0, (1000 - sum(eigenvalue) OVER (ORDER BY component)) / (40 - component)) AS lo FROM {SPEC}) WHERE eigenvalue > lo", "trials", "noise")
add("wn5_rolling_median", lambda s, d: P.rolling_median(V.trials(s, d).select("seed", "trial", "rmse"), ["seed"], "trial", "rmse", 10), "SELECT seed, trial, rmse, quantile_cont(rmse, 0.5) OVER (PARTITION BY seed ORDER BY trial ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS median FROM trials", "trials", "rmse median")
add("wn6_lag_pairs", lambda s, d: P.previous_step(V.panel(s, d), ["site_id"], "t", "z"), "SELECT site_id, t, z, before FROM (SELECT *, lag(z) OVER (PARTITION BY site_id ORDER BY t) AS before FROM panel) WHERE before IS NOT NULL", "panel", "z before")
add("tk1_worst_sites", lambda s, d: R.worst(M.site_rows(P.of_split(V.intervals(s, d), "test"), ["method"]).select("site_id", "z_rms", "cp"), [C("z_rms").desc_nulls_last(), C("cp").asc_nulls_last(), C("site_id")]), f"SELECT site_id, z_rms, cp FROM ({SITE_ROWS}) ORDER BY z_rms DESC NULLS LAST, cp NULLS LAST, site_id LIMIT 10", "intervals", "z_rms cp")
add("tk1_worst_times", lambda s, d: R.worst(M.time_rows(V.intervals(s, d), ["seed"]).select("seed", "t", "cp", "rmse"), [C("cp").asc_nulls_last(), C("rmse").desc_nulls_last()]), f"SELECT seed, t, cp, rmse FROM ({TIME_ROWS}) ORDER BY cp NULLS LAST, rmse DESC NULLS LAST LIMIT 10", "intervals", "cp rmse")
add("tk2_best_trial_per_seed", lambda s, d: R.rank_by(V.trials(s, d), ["seed"], [C("covfrob"), C("trial")]), "SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY covfrob, trial) AS r FROM trials) WHERE r = 1", "trials", "tau1 tau2 rmse covfrob sv_score")
add("tk3_trials_with_logs", lambda s, d: R.with_logs(V.trials(s, d)).select("seed", "trial", "log10_tau1", "log10_tau2"), "SELECT seed, trial, log10(tau1 + 1e-12) AS log10_tau1, log10(tau2 + 1e-12) AS log10_tau2 FROM trials", "trials", "log10_tau1 log10_tau2")
add("tk4_distinct_counts", lambda s, d: P.sites_seen(V.panel(s, d)), "SELECT count(DISTINCT site_id) AS sites, count(DISTINCT t) AS times, count(*) AS cells FROM panel", "panel")
add("st1_observed_rows", lambda s, d: P.split_sites(V.panel(s, d), 0.2, 3)[0], f"SELECT p.* FROM panel p ANTI JOIN {HELD} USING (site_id)", "panel", "z")
add("st2_stacked", lambda s, d: R.stacked([V.trials(s, d).select("seed", "rmse"), V.trials(s, d).select("seed", "covfrob")]).groupBy("seed").agg(F.count("*").alias("n"), F.avg("rmse").alias("rmse"), F.avg("covfrob").alias("covfrob")), "SELECT seed, 2 * count(*) AS n, avg(rmse) AS rmse, avg(covfrob) AS covfrob FROM trials GROUP BY seed", "trials", "rmse covfrob")
add("st3_membership", lambda s, d: P.only(V.panel(s, d), V.sites(s, d).where("x < 0.5"), ["site_id"]), "SELECT * FROM panel SEMI JOIN (SELECT site_id FROM sites WHERE x < 0.5) USING (site_id)", "panel sites", "z")

# ---------------------------------------------------------------- boxes and texts

add("sf1_sf2_merged_boxes", lambda s, d: B.merged_boxes(V.annotations(s, d).select(B.image_key(C("image_id")).alias("image_id"), "bbox")), r"SELECT regexp_replace(image_id, '\.(jpg|png)$', '') AS image_id, coalesce(string_agg(bbox, ';' ORDER BY bbox), '') AS bbox FROM ann GROUP BY 1", "ann")
add("sf3_parsed_boxes", lambda s, d: _boxes(s, d).select("image_id", F.explode("boxes").alias("b")).select("image_id", "b.*").distinct(), "SELECT * FROM boxed", "boxed", "xmin ymin xmax ymax")
FRAME = r"(SELECT DISTINCT regexp_replace(image_id, '\.(jpg|png)$', '') AS image_id FROM ann), (SELECT unnest(range(16)) AS r), (SELECT unnest(range(16)) AS c)"
add("sf4_label_map", lambda s, d: B.label_map(_boxes(s, d), "image_id", "boxes").groupBy("image_id").agg(F.count("*").alias("cells"), F.sum("label").alias("hit"), F.sum(C("label") * (C("r") * 16 + C("c"))).alias("places")), f"SELECT image_id, count(*) AS cells, sum(h) AS hit, sum(h * (r * 16 + c)) AS places FROM (SELECT f.image_id, f.r, f.c, (x.image_id IS NOT NULL)::INT::DOUBLE AS h FROM (SELECT * FROM {FRAME}) f LEFT JOIN cells x USING (image_id, r, c)) GROUP BY image_id", "ann cells", "hit places")
add("sf5_grid_of_images", lambda s, d: B.grid_coordinates(s).join(B.covered_cells(_boxes(s, d), "image_id", "boxes"), ["r", "c"]).groupBy("image_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y")), "SELECT image_id, avg(c / 15.0::DOUBLE) AS x, avg(r / 15.0::DOUBLE) AS y FROM cells GROUP BY image_id", "cells", "x y")
add("sf6_block_means", lambda s, d: B.block_means(B.label_map(_boxes(s, d), "image_id", "boxes"), ["image_id"], "label"), f"SELECT image_id, r // 4 AS r, c // 4 AS c, avg(h) AS label FROM (SELECT f.image_id, f.r, f.c, (x.image_id IS NOT NULL)::INT::DOUBLE AS h FROM (SELECT * FROM {FRAME}) f LEFT JOIN cells x USING (image_id, r, c)) GROUP BY ALL", "ann cells", "label")
add("sf7_distances", lambda s, d: V.sites(s, d).select("site_id", S.distance([C("x")], [F.lit(0.5)]).alias("d1"), S.distance([C("x"), C("y")], [F.lit(0.5), F.lit(0.5)]).alias("d2")), "SELECT site_id, abs(x - 0.5) AS d1, sqrt((x - 0.5) ** 2 + (y - 0.5) ** 2) AS d2 FROM sites", "sites", "d1 d2")
add("sf8_links", lambda s, d: V.binary(s, d).groupBy("seed").agg(F.avg(S.sigmoid(C("z"))).alias("p"), F.avg(S.logit(C("p"))).alias("z")), "SELECT seed, avg(1 / (1 + exp(-z))) AS p, avg(ln(p / (1 - p))) AS z FROM bin GROUP BY seed", "bin", "p z")
add("sf9_texts", lambda s, d: V.trials(s, d).select("seed", "trial", S.mean_se_text(C("rmse") + 1e-9, C("covfrob") + 1e-9, 4).alias("cell"), S.minutes_text(F.floor(C("rmse") * 100).cast("double")).alias("minutes")), "SELECT seed, trial, printf('%.4f (%.4f)', rmse + 1e-9, covfrob + 1e-9) AS cell, printf('%dm %.1fs', (floor(rmse * 100)::BIGINT // 60), floor(rmse * 100) % 60) AS minutes FROM trials", "trials")
_matrix = lambda s, d: P.packed(P.full_frame(*[V.panel(s, d).unionByName(V.panel(s, d).withColumn("z", C("z") + 1).where("t % 2 = 0"))] * 3))
add("rs1_matrix_rows", lambda s, d: _matrix(s, d).select("t", F.posexplode("vals").alias("place", "z")), "SELECT t, (dense_rank() OVER (ORDER BY site_id) - 1)::INT AS place, z + CASE WHEN t % 2 = 0 THEN 0.5 ELSE 0 END AS z FROM (SELECT t, site_id FROM (SELECT DISTINCT t FROM panel), (SELECT DISTINCT site_id FROM panel)) LEFT JOIN panel USING (t, site_id)", "panel", "z")
add("rs2_unpacked", lambda s, d: P.unpacked(P.packed(V.panel(s, d))), "SELECT t, site_id, z FROM panel", "panel", "z")
add("rs3_full_frame", lambda s, d: P.full_frame(V.panel(s, d), V.panel(s, d), V.panel(s, d)).select("t", "site_id", "z"), "SELECT t, site_id, z FROM (SELECT DISTINCT t FROM panel), (SELECT DISTINCT site_id FROM panel) LEFT JOIN panel USING (t, site_id)".replace("(SELECT DISTINCT t FROM panel), (SELECT DISTINCT site_id FROM panel)", "(SELECT t, site_id FROM (SELECT DISTINCT t FROM panel), (SELECT DISTINCT site_id FROM panel))"), "panel", "z")

# ---------------------------------------------------------------- moments and variograms

add("cv1_gram", lambda s, d: G.gram_long(V.panel(s, d)), GRAM, "panel", "v")
add("cv2_cv3_covariance", lambda s, d: G.covariance_long(V.panel(s, d)), COV, "panel", "v")
_both = lambda df: df.withColumn("damped", C("z") * (0.5 + 0.1 * (C("site_id") % 3)))
_damped = lambda df: df.withColumn("z", C("z") * (0.5 + 0.1 * (C("site_id") % 3)))
DAMPED = "(SELECT site_id, t, z * (0.5 + 0.1 * (site_id % 3)) AS z FROM {rows})"
ERROR = "SELECT sqrt(sum((b.v - a.v) ** 2)) / (sqrt(sum(a.v ** 2)) + 1e-12) AS error FROM ({a}) a JOIN ({b}) b USING (i, j)"
DAMPED_COV = COVARIANCE.format(a=DAMPED.format(rows="panel"), b=DAMPED.format(rows="panel"))
add("cv4_covariance_error", lambda s, d: K.covariance_error(_both(V.panel(s, d)), "z", "damped"), ERROR.format(a=COV, b=DAMPED_COV), "panel", "error")
BINS = "(SELECT *, most / bins AS width FROM (SELECT ceil(2 * log2(count(*)) + 1)::INT AS bins, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) / 3 AS most FROM sites))"
LAGS = f"(SELECT i, j, floor(h / width)::INT AS bin, width FROM (SELECT a.site_id AS i, b.site_id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS h FROM sites a JOIN sites b ON a.site_id < b.site_id), {BINS} WHERE h < most)"
GAMMA = f"SELECT bin, any_value((bin + 0.5) * width) AS lag, {{g}} AS gamma, count(*) AS n FROM {LAGS} p JOIN {{rows}} a ON a.site_id = p.i JOIN {{rows}} b ON b.site_id = p.j AND a.t = b.t GROUP BY bin"
MATHERON = "avg((a.z - b.z) ** 2) / 2"
CRESSIE = "0.5 * avg(sqrt(abs(a.z - b.z))) ** 4 / (0.457 + 0.494 / count(*) + 0.045 / (count(*) * count(*)))"
_gamma = lambda s, d, rows, **o: X.semivariogram(rows, V.sites(s, d), X.bin_edges(V.sites(s, d)), **o)
add("cv12_semivariogram", lambda s, d: _gamma(s, d, V.panel(s, d)), GAMMA.format(g=MATHERON, rows="panel"), "panel sites", "lag gamma")
add("cv12_semivariogram_cressie", lambda s, d: _gamma(s, d, V.panel(s, d), estimator="cressie"), GAMMA.format(g=CRESSIE, rows="panel"), "panel sites", "lag gamma")


def _edges(s: SparkSession, d: str) -> DataFrame:
    edges = X.bin_edges(V.sites(s, d))
    return s.createDataFrame([(i, e) for i, e in enumerate(edges)], "bin int, edge double")


add("cv13_lag_bins", _edges, "SELECT unnest(range(k + 1)) AS bin, unnest(range(k + 1)) * most / k AS edge FROM (SELECT ceil(2 * log2(count(*)) + 1)::INT AS k, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) / 3 AS most FROM sites)", "sites", "edge")


def _match(s: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """The weighted loss, and the same with each bin's difference relative to the truth in it."""
    own, other = written(_gamma(s, d, rows)), written(_gamma(s, d, _damped(rows)))
    return X.variogram_match(own, other).join(X.variogram_match(own, other, normalised=True).select(C("loss").alias("relative")))


LOSS = "SELECT sum(least(a.n, b.n) * (b.gamma - a.gamma) ** 2) / sum(least(a.n, b.n)) AS loss, count(*) AS bins, sum(least(a.n, b.n) * ((b.gamma - a.gamma) / (a.gamma + 1e-8)) ** 2) / sum(least(a.n, b.n)) AS relative FROM ({a}) a JOIN ({b}) b USING (bin)"
add("cv14_variogram_match", lambda s, d: _match(s, d, V.panel(s, d)), LOSS.format(a=GAMMA.format(g=MATHERON, rows="panel"), b=GAMMA.format(g=MATHERON, rows=DAMPED.format(rows="panel"))), "panel sites", "loss relative")
add("cv11_basis_alignment", lambda s, d: G.alignment(V.phi(s, d), V.phi(s, d).withColumn("phi", -C("phi")).where("k < 2")), "SELECT k, arg_max(o, abs(c)) AS best, max(abs(c)) AS cosine FROM (SELECT a.k, b.k AS o, sum(a.phi * b.phi) / sqrt(sum(a.phi ** 2) * sum(b.phi ** 2)) AS c FROM phi a JOIN phi b USING (site_id) WHERE b.k < 2 GROUP BY a.k, b.k) GROUP BY k", "phi", "cosine")


def complete_panel(s: SparkSession, d: str) -> DataFrame:
    """Every (t, site) of the daily panel, with the site's mean where nothing was seen."""
    own = V.panel(s, d)
    frame = P.full_frame(own, own, own)
    mean = own.groupBy("site_id").agg(F.avg("z").alias("m"))
    return P.attach_split(frame.join(mean, "site_id").select("site_id", "t", F.coalesce("z", "m").alias("z"), (F.coalesce("z", "m") - C("m")).alias("r")), P.split_contiguous(own))


FULL = "(SELECT site_id, t, coalesce(z, m) AS z, coalesce(z, m) - m AS r, split FROM (SELECT t, site_id FROM (SELECT DISTINCT t FROM panel), (SELECT DISTINCT site_id FROM panel)) LEFT JOIN panel USING (t, site_id) JOIN (SELECT site_id, avg(z) AS m FROM panel GROUP BY site_id) USING (site_id) JOIN splits USING (t))"


def _basis(s: SparkSession, d: str) -> DataFrame:
    """The same as a long table, which no bound on sites applies to."""
    return written(D.orthonormal(P.only(V.phi(s, d), V.panel(s, d), ["site_id"])))


add("cv1_gram_one_pass", lambda s, d: G.gram_sums(complete_panel(s, d), "r"), f"SELECT a.site_id, sum(a.r * a.r) AS own, sum(a.r * b.s) AS row FROM {FULL} a JOIN (SELECT t, sum(r) AS s FROM {FULL} GROUP BY t) b USING (t) GROUP BY a.site_id", "panel splits", "own row")


def _k1_sql() -> str:
    """x K_1(x) by the same sums as the operator's: a power series below 1, the trapezoid rule above."""
    a, b = X.k1_series()
    series = lambda w: " + ".join(f"{v!r}::DOUBLE * (x * x / 4) ** {k}" for k, v in enumerate(w))
    step = "(0.5::DOUBLE / sqrt(greatest(x, 4)))"
    nodes = " + ".join(f"cosh({j} * {step}) * exp(-2 * x * sinh({j / 2}::DOUBLE * {step}) ** 2)" for j in range(1, X.K1_NODES + 1))
    return f"CASE WHEN x < 1e-12 THEN 1 WHEN x < 1 THEN 1 + x * x / 2 * (ln(x / 2) * ({series(a)}) - ({series(b)}) / 2) ELSE x * exp(-x) * {step} * (0.5::DOUBLE + {nodes}) END"


MATERN = f"(SELECT i, j, {_k1_sql()} AS v FROM (SELECT a.site_id AS i, b.site_id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 0.08::DOUBLE AS x FROM sites a, sites b))"
add("cv5_matern_correlation", lambda s, d: X.matern_by_site(V.sites(s, d)), f"SELECT i AS site_id, avg(v) AS mean, sum(v * v) AS square, max(v) FILTER (i <> j) AS nearest FROM {MATERN} GROUP BY i", "sites", "mean square nearest")
add("cv6_error_against_matern", lambda s, d: K.covariance_error_against(V.panel(s, d), V.sites(s, d), lambda h: X.matern(h.ravel(), 1.0, 0.08).reshape(h.shape)), ERROR.format(a=MATERN, b=COV), "panel sites", "error")
add("cv7_low_rank_covariance", lambda s, d: G.model_row(s, G.low_rank(G.basis_moments(complete_panel(s, d), _basis(s, d)))))
add("cv8_plug_in_covariance", lambda s, d: G.model_row(s, G.plug_in(G.basis_moments(complete_panel(s, d), _basis(s, d)))))


def _spectrum(s: SparkSession, d: str, k: int, where=None) -> tuple[DataFrame, E.Leading]:
    return E.covariance_spectrum(G.complete_cells(complete_panel(s, d), "r", where)[0], k)


def _halves(s: SparkSession, d: str) -> list[tuple[DataFrame, E.Leading]]:
    return [_spectrum(s, d, 5, x) for x in (C("split") == "train", C("split") != "train")]


add("cv9_spectrum", lambda s, d: _spectrum(s, d, 10)[0])
add("cv10_spectrum_errors", lambda s, d: G.spectrum_errors(*[table for table, _ in _halves(s, d)], 5))
add("cv10_eigenvector_alignment", lambda s, d: E.cosines(*[found.long() for _, found in _halves(s, d)]))


add("cv15_residual_moments", lambda s, d: G.residual_moments(complete_panel(s, d), P.only(V.phi(s, d), V.panel(s, d), ["site_id"])), f"SELECT (SELECT sqrt(sum(phi ** 2)) FROM phi SEMI JOIN panel USING (site_id)) AS basis_norm, sqrt(sum(v * v)) / max(n) AS norm, sum(v) FILTER (i = j) / max(n) AS trace FROM (SELECT a.site_id AS i, b.site_id AS j, sum(a.r * b.r) AS v, count(*) AS n FROM {FULL} a JOIN {FULL} b USING (t) GROUP BY ALL)", "panel splits phi", "basis_norm norm trace")

# ---------------------------------------------------------------- models


def _ols(s: SparkSession, d: str) -> DataFrame:
    rows = V.binary(s, d)
    w, b = D.ols(rows, ["z"], "y")
    return rows.select("seed", "y", D.ols_predict(["z"], w, b).alias("fit")).groupBy("seed").agg(F.avg("fit").alias("fit"), M.rmse(C("y"), C("fit")).alias("rmse"))


add("md1_md2_least_squares", _ols, "SELECT seed, avg(a + b * z) AS fit, sqrt(avg((y - a - b * z) ** 2)) AS rmse FROM bin, (SELECT regr_slope(y, z) AS b, regr_intercept(y, z) AS a FROM bin) GROUP BY seed", "bin", "fit rmse")


def _penalised(s: SparkSession, d: str) -> DataFrame:
    return L.penalised(G.complete_cells(complete_panel(s, d), "r", C("split") == "train")[0], V.sites(s, d), 3, 1.0)


add("md3_md5_penalised_basis", _penalised)


def _fit(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[dict]]:
    rows = written(complete_panel(s, d))
    phi, _, history = L.fitted(rows, V.sites(s, d), 3, 1.0, 0.1)
    return rows, phi, history


add("md4_basis_fit", lambda s, d: s.createDataFrame(_fit(s, d)[2]))


def _binary_target(s: SparkSession, d: str) -> DataFrame:
    """All suppliers by months; a month's label is its most frequent one."""
    rows = V.binary_panel(s, d)
    parts = [K.binary_target(rows, v).withColumn("variant", F.lit(v)) for v in ("variance_only", "full_taylor", "irls")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CENTRED = "SELECT '{v}' AS variant, a.site_id AS i, b.site_id AS j, sum(a.z * b.z) - sum(a.z) * sum(b.z) / count(*) AS v FROM {rows} a JOIN {rows} b USING (t) GROUP BY ALL"
WORKING = "(SELECT t, site_id, z + (y - p) / (p * (1 - p) + 1e-4) AS z FROM (SELECT *, 1 / (1 + exp(-z)) AS p FROM bin_panel))"
add("md6_binary_targets", _binary_target, f"{CENTRED.format(v='variance_only', rows='bin_panel')} UNION ALL {CENTRED.format(v='irls', rows=WORKING)} UNION ALL SELECT 'full_taylor', a.site_id, b.site_id, sum((0.5::DOUBLE - a.y) * b.z + (0.5::DOUBLE - b.y) * a.z) / 2 + sum(a.z * b.z) / 8 FROM bin_panel a JOIN bin_panel b USING (t) GROUP BY ALL", "bin_panel", "v")
ETA = "(SELECT t, k, sum(r * phi) AS eta FROM {full} JOIN phi USING (site_id) GROUP BY ALL)".format(full=FULL)
add("md7_scores", lambda s, d: D.scores(complete_panel(s, d), V.phi(s, d)), f"SELECT * FROM {ETA}", "panel splits phi", "eta")
FITTED = f"(SELECT t, site_id, sum(eta * phi) AS fitted FROM {ETA} JOIN phi USING (k) GROUP BY ALL)"
add("md8_projected", lambda s, d: D.projected(complete_panel(s, d), V.phi(s, d)).select("t", "site_id", "r", "fitted"), f"SELECT t, site_id, r, fitted FROM {FULL} JOIN {FITTED} USING (t, site_id)", "panel splits phi", "r fitted")
add("md9_off_basis", lambda s, d: D.off_basis(complete_panel(s, d), V.phi(s, d)), f"SELECT max(abs(r - fitted)) AS largest, sqrt(sum((r - fitted) ** 2)) / sqrt(sum(r * r)) AS share FROM {FULL} JOIN {FITTED} USING (t, site_id)", "panel splits phi", "largest share")


def _diagnostics(s: SparkSession, d: str) -> DataFrame:
    rows, phi, _ = _fit(s, d)
    return s.createDataFrame([L.diagnostics(rows, V.sites(s, d), phi, 1.0, 0.1)])


add("md10_fit_diagnostics", _diagnostics)


def _bundle(s: SparkSession, d: str) -> DataFrame:
    """Every criterion at once, on val rows of the standardised target: a damped panel against the panel, and soft
    labels."""
    own = P.standardised(V.split_panel(s, d), "z", C("split") == "train")
    val = written(P.of_split(own, "val").select("site_id", "t", "z"))
    both = P.align(val.withColumnRenamed("z", "y"), _damped(val))
    parts = both.agg(M.rmse(C("y"), C("z")).alias("rmse")).join(K.covariance_error(_both(val), "z", "damped").select(C("error").alias("cov_frob")))
    parts = parts.join(_match(s, d, val).select(C("loss").alias("sv_score")))
    return parts.join(M.auc(_soft(s, d), [], "y", "z")).join(_soft(s, d).agg(M.confusion(C("y"), C("z"))["accuracy"].alias("accuracy")))


VAL = "(SELECT site_id, t, (z - m) / s AS z FROM split_panel, (SELECT avg(z) AS m, stddev_pop(z) + 1e-12 AS s FROM split_panel WHERE split = 'train') WHERE split = 'val')"
VAL_DAMPED = DAMPED.format(rows=VAL)
ALL_AUC = AUC.replace("SELECT seed, sum(pos", "SELECT sum(pos").replace("PARTITION BY seed ", "").replace("SELECT seed, z, count", "SELECT z, count").replace(" GROUP BY seed", "")
add("md11_validation_bundle", _bundle,
    f"SELECT (SELECT sqrt(avg((a.z - b.z) ** 2)) FROM {VAL} a JOIN {VAL_DAMPED} b USING (site_id, t)) AS rmse, ({ERROR.format(a=COVARIANCE.format(a=VAL, b=VAL), b=COVARIANCE.format(a=VAL_DAMPED, b=VAL_DAMPED))}) AS cov_frob, "
    f"(SELECT loss FROM ({LOSS.format(a=GAMMA.format(g=MATHERON, rows=VAL), b=GAMMA.format(g=MATHERON, rows=VAL_DAMPED))})) AS sv_score, ({ALL_AUC.format(rows=SOFT)}) AS auc, (SELECT accuracy FROM (SELECT {CONFUSION} FROM {SOFT})) AS accuracy",
    "split_panel bin sites", "rmse cov_frob sv_score auc accuracy")
add("md11_validation_metrics", lambda s, d: M.by_split(V.scored(s, d).where("split = 'val'"), ["model"]), f"SELECT model, CASE WHEN grouping(split) = 1 THEN 'full' ELSE split END AS split, {RAW} FROM scored WHERE split = 'val' GROUP BY GROUPING SETS ((model, split), (model))", "scored", "rmse mae r2")
# Energy of the scores and alignment of mean residuals with the basis, by split over seeds (here: every fifth day).
SEED_ETA = f"(SELECT split, t % 5 AS seed, k, eta FROM {ETA} JOIN splits USING (t))"
ENERGY = f"SELECT split, k, avg(value) AS value FROM (SELECT seed, split, k, avg(eta * eta) AS value FROM {SEED_ETA} GROUP BY ALL) GROUP BY ALL"
MEANS_AT = f"(SELECT t % 5 AS seed, split, site_id, avg(r) AS m FROM {FULL} GROUP BY ALL)"
ALIGNED = f"SELECT split, k AS rank, avg(value) AS value FROM (SELECT seed, split, k, abs(sum(m * phi)) / sqrt(sum(m * m) * sum(phi * phi)) AS value FROM {MEANS_AT} JOIN phi USING (site_id) GROUP BY ALL) GROUP BY ALL"


def _energies(s: SparkSession, d: str) -> DataFrame:
    rows = complete_panel(s, d)
    eta = D.scores(rows, V.phi(s, d)).join(rows.select("t", "split").distinct(), "t")
    return R.energy_means(eta.select((C("t") % 5).alias("seed"), "split", "k", "eta"))


add("rt14_eigen_energy", _energies, ENERGY, "panel splits phi", "value")
add("rt14_alignment", lambda s, d: R.alignment_means(complete_panel(s, d).groupBy((C("t") % 5).alias("seed"), "split", "site_id").agg(F.avg("r").alias("m")), V.phi(s, d)), ALIGNED, "panel splits phi", "value")


def _trials(s: SparkSession, d: str) -> DataFrame:
    """Two seeds, each with the rows of its own days."""
    rows = written(complete_panel(s, d))
    own = {seed: rows.where(C("t") % 2 == seed) for seed in (0, 1)}
    return D.best_trial(L.trials(own, V.sites(s, d), D.trial_grid(s, [0.1, 10.0], [0.0, 1.0], [0, 1]), 2))


add("md12_md13_trials", _trials)


def _new_basis(s: SparkSession, d: str) -> DataFrame:
    """The basis at every site without data, by the splines through it at the others."""
    own = P.only(V.sites(s, d), V.panel(s, d), ["site_id"])
    return N.interpolated(N.splines(own), _basis(s, d), P.without(V.sites(s, d), V.panel(s, d), ["site_id"]))


add("md14_interpolated_basis", lambda s, d: _new_basis(s, d).select("site_id", F.posexplode("phi").alias("k", "phi")))


def _conditional(s: SparkSession, d: str) -> DataFrame:
    phi = _basis(s, d)
    fit = G.plug_in(G.basis_moments(complete_panel(s, d), phi, where=C("split") == "train"))
    return D.conditional(V.panel(s, d), phi, fit.eigenvalues, fit.noise, "z")


add("md15_md16_conditional_scores", lambda s, d: _conditional(s, d).select("t", F.posexplode("eta").alias("k", "eta")))


def _kriged(s: SparkSession, d: str) -> DataFrame:
    """Means for all times and the variance at every site without data."""
    phi = _basis(s, d)
    fit = G.low_rank(G.basis_moments(complete_panel(s, d), phi, where=C("split") == "train"))
    mean, var = D.kriging_at(complete_panel(s, d), phi, fit, written(_new_basis(s, d)))
    return mean.join(var, "site_id")


add("md17_md18_kriging", _kriged)


def _forecast(s: SparkSession, d: str) -> DataFrame:
    basis = _basis(s, d)
    model = D.fit_forecaster(D.scores(complete_panel(s, d).where("split = 'train'"), basis))
    mu = V.panel(s, d).groupBy("site_id").agg(F.avg("z").alias("mu")).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return D.forecast(model, basis, mu)


add("md19_md20_forecast", _forecast)


def _carried(s: SparkSession, d: str) -> DataFrame:
    """Two calls of two steps each, the second from the state that the first one left."""
    basis, path = _basis(s, d), new_folder(s)
    D.save_forecaster(s, path, D.fit_forecaster(D.scores(complete_panel(s, d).where("split = 'train'"), basis)))
    mu = V.panel(s, d).groupBy("site_id").agg(F.avg("z").alias("mu")).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(2))))
    first, second = (D.carried_forecast(path, basis, mu)[0] for _ in range(2))
    return first.unionByName(second.withColumn("h", C("h") + 2))


add("md20_carried_forecast", _carried)
add("md21_retracted_basis", lambda s, d: D.orthonormal(_basis(s, d).withColumn("phi", 2 * C("phi"))))
RBF = "greatest(1 - least(r, 1), 0) ** 6 * (35 * least(r, 1) ** 2 + 18 * least(r, 1) + 3) / 3"
GRID = "(SELECT level, id, (id // side) * gap AS cx, (id % side) * gap AS cy, 2.5 * gap AS bw FROM (SELECT level, unnest(range(side * side)) AS id, side, 1.0::DOUBLE / (side - 1) AS gap FROM (VALUES (0, 5), (1, 9)) v(level, side)))"
add("md22_md23_spatial_features", lambda s, d: D.spatial_features(V.sites(s, d), D.uniform_centres(s, (25, 81))).select("site_id", F.posexplode("features").alias("k", "v")), f"SELECT site_id, k, v FROM (SELECT site_id, level * 25 + id AS k, {RBF} AS v FROM (SELECT site_id, level, id, sqrt((x - cx) ** 2 + (y - cy) ** 2) / bw AS r FROM sites, {GRID}))", "sites", "v")
DRAWN = "(SELECT site_id, x, y FROM sites ORDER BY md5('11|0|' || site_id), site_id LIMIT 25)"
add("md24_drawn_centres", lambda s, d: D.drawn_centres(V.sites(s, d), (25,), 11, key="site_id"), f"SELECT 0 AS level, i AS id, any_value(x) AS x, any_value(y) AS y, 2.5 * avg(h) AS bandwidth FROM (SELECT a.site_id AS i, a.x, a.y, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS h, row_number() OVER (PARTITION BY a.site_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.site_id) AS r FROM {DRAWN} a JOIN {DRAWN} b ON a.site_id <> b.site_id) WHERE r <= 4 GROUP BY i", "sites", "x y bandwidth")
add("md25_temporal_features", lambda s, d: P.normalised_time(V.panel(s, d)).select("t", "t_norm").distinct().select("t", F.posexplode(D.temporal_features(C("t_norm"), (10, 15))).alias("k", "v")), "SELECT t, k, exp(-0.5 * ((t_norm - c * gap) / (2.5 * gap)) ** 2) AS v FROM (SELECT DISTINCT t, (t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER () + 1e-12) AS t_norm FROM panel), (SELECT off + c AS k, c, gap FROM (SELECT off, unnest(range(n)) AS c, 1.0::DOUBLE / (n - 1) AS gap FROM (VALUES (0, 10), (10, 15)) v(off, n)))", "panel", "v")


add("md26_batch_scoring", lambda s, d: D.scored(V.sites(s, d), ["x", "y"], V.linear_model), "SELECT site_id, x, y, 2 * x - y + 1 AS y_pred FROM sites", "sites", "x y y_pred")

# ---------------------------------------------------------------- intervals

BOUNDS = "y_pred - {z} * sqrt(greatest(var, 0)) AS lo, y_pred + {z} * sqrt(greatest(var, 0)) AS hi"


def _bounds(s: SparkSession, d: str, pair) -> DataFrame:
    return V.intervals(s, d).select("site_id", "t", pair[0].alias("lo"), pair[1].alias("hi"))


add("pi1_gaussian_interval", lambda s, d: _bounds(s, d, I.gaussian(HAT(), C("var"), 0.1)), f"SELECT site_id, t, {BOUNDS.format(z=S.normal_z(0.1))} FROM intervals", "intervals", "lo hi")
add("pi2_logistic_interval", lambda s, d: V.binary(s, d).groupBy("seed").agg(*[F.avg(c).alias(n) for n, c in zip(("lo", "hi"), I.logistic_normal(C("z"), C("var")))]), f"SELECT seed, avg(1 / (1 + exp(-(z - {Z95} * sqrt(var))))) AS lo, avg(1 / (1 + exp(-(z + {Z95} * sqrt(var))))) AS hi FROM bin GROUP BY seed", "bin", "lo hi")
QHAT = "SELECT seed, s[1 + floor(pos)::INT] + (s[1 + ceil(pos)::INT] - s[1 + floor(pos)::INT]) * (pos - floor(pos)) AS q_hat, n FROM (SELECT seed, n, s, least(1, 0.95 * (1 + 1.0::DOUBLE / n)) * (n - 1) AS pos FROM (SELECT seed, count(*) AS n, list(abs(y_true - y_pred) / greatest(sqrt(var), 1e-12) ORDER BY abs(y_true - y_pred) / greatest(sqrt(var), 1e-12)) AS s FROM intervals WHERE split = 'val' AND var IS NOT NULL GROUP BY seed))"
_q = lambda s, d, **o: I.critical_value(P.of_split(V.intervals(s, d), "val"), ["seed"], "y_true", "y_pred", "var", **o)
add("pi3_critical_value", _q, QHAT, "intervals", "q_hat")
add("pi3_critical_value_by_histogram", lambda s, d: _q(s, d, exact_up_to=10), QHAT, "intervals", "q_hat")
add("pi4_pi5_calibrated_interval", lambda s, d: V.intervals(s, d).join(_q(s, d), "seed").select("site_id", "t", *[c.alias(n) for n, c in zip(("lo", "hi"), I.interval(HAT(), C("var"), q_hat=C("q_hat")))]), f"SELECT site_id, t, y_pred - q_hat * sqrt(var) AS lo, y_pred + q_hat * sqrt(var) AS hi FROM intervals JOIN ({QHAT}) USING (seed)", "intervals", "lo hi")


def _site_means(s: SparkSession, d: str) -> DataFrame:
    """Plug-in and calibrated coverage and width of site means at some sites: calibrated on val, scored on test."""
    rows = V.intervals(s, d).where("var IS NOT NULL")
    held = P.only(rows, P.held_out_sites(rows, 0.3, 3), ["site_id"])
    q = I.critical_value(P.of_split(held, "val"), ["method"], "y_true", "y_pred", "var")
    test = P.of_split(held, "test").join(q, "method")
    parts = [test.groupBy("method").agg(F.lit(n).alias("kind"), (100 * M.coverage(Y(), *pair)).alias("cp"), M.mean_width(*pair).alias("mpiw")) for n, pair in (("plug-in", I.interval(HAT(), C("var"))), ("calibrated", I.interval(HAT(), C("var"), q_hat=C("q_hat"))))]
    return parts[0].unionByName(parts[1])


add("pi6_site_mean_intervals", _site_means)
add("pi6_held_out_intervals", lambda s, d: L.held_out_prediction(V.panel(s, d), V.sites(s, d)))
add("workload_reconstruction", lambda s, d: L.reconstruction(V.panel(s, d), V.sites(s, d)))
PATCH_Z = "(r * 3 + c * 5 + 0.1 * (r * c % 7)) / 40.0::DOUBLE - 1.6"
PATCHES = f"(SELECT split, h, {PATCH_Z} AS z FROM (SELECT f.image_id, f.r, f.c, (x.image_id IS NOT NULL)::INT::DOUBLE AS h FROM (SELECT * FROM {FRAME}) f LEFT JOIN cells x USING (image_id, r, c)) JOIN (SELECT image_id, CASE WHEN place < floor(n * 0.7::DOUBLE) THEN 'train' WHEN place < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM {IMG.replace('FROM (SELECT DISTINCT image_id FROM ann)', 'FROM (SELECT DISTINCT image_id FROM keyed)')}) USING (image_id))"
# 0.5 where a split has one kind of label only, as in the operator.
PATCH_AUC = AUC.replace("seed", "split").replace("y >=", "h >=").replace("y <", "h <").format(rows=PATCHES)
PATCH_AUC = PATCH_AUC.replace("/ (sum(pos) * sum(neg)) AS auc", "/ nullif(sum(pos) * sum(neg), 0) AS auc").replace("SELECT split, sum(pos *", "SELECT split, coalesce(sum(pos *").replace(", 0) AS auc", ", 0), 0.5::DOUBLE) AS auc")
assert "{rows}" not in PATCH_AUC and "coalesce(sum(pos *" in PATCH_AUC and "nullif(sum(pos)" in PATCH_AUC and "0.5::DOUBLE) AS auc" in PATCH_AUC
PATCH_ECE = f"SELECT split, sum(abs(p - o)) / sum(n) AS ece FROM (SELECT split, greatest(ceil(p * 15), 1) AS b, count(*) AS n, sum(p) AS p, sum(h) AS o FROM (SELECT split, h, 1 / (1 + exp(-z)) AS p FROM {PATCHES}) GROUP BY ALL) GROUP BY split"
PATCH_MAIN = f"SELECT split, count(*) AS cells, avg(((h >= 0.5) = (z >= 0))::INT) AS accuracy, coalesce(2.0 * count(*) FILTER (h >= 0.5 AND z >= 0) / nullif(2 * count(*) FILTER (h >= 0.5 AND z >= 0) + count(*) FILTER ((h >= 0.5) <> (z >= 0)), 0), 0) AS f1 FROM {PATCHES} GROUP BY split"
add("workload_patch_scores", lambda s, d: L.patch_scores(V.annotations(s, d), (C("r") * 3 + C("c") * 5 + 0.1 * (C("r") * C("c") % 7)) / 40.0 - 1.6), f"SELECT * FROM ({PATCH_MAIN}) JOIN ({PATCH_ECE}) USING (split) JOIN ({PATCH_AUC}) USING (split)", "ann cells keyed", "accuracy f1 ece auc")

# ---------------------------------------------------------------- sources and sinks


def _observations(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s)
    V.panel(s, d).join(V.sites(s, d), "site_id").select(F.lit("extra").alias("note"), "z", "t", "y", "x").write.option("header", True).csv(path)
    return T.read_observations(s, path)


add("io1_observations_csv", _observations, "SELECT x, y, t, z FROM panel JOIN sites USING (site_id)", "panel sites", "x y z")


def _partitioned(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s)
    T.write_predictions(V.scored(s, d), path)
    return s.read.parquet(path).groupBy("seed", "model").agg(F.count("*").alias("n"), F.avg("y_pred").alias("m"))


add("io8_predictions_by_seed", _partitioned, "SELECT seed, model, count(*) AS n, avg(y_pred) AS m FROM scored GROUP BY ALL", "scored", "m")


def _trial_files(s: SparkSession, d: str) -> DataFrame:
    folder = new_folder(s)
    for i, columns in enumerate((["seed", "trial", "rmse"], ["seed", "trial", "rmse", "covfrob"])):
        T.write_table(V.trials(s, d).where(C("seed") % 2 == i).select(*columns), f"{folder}/{i}")
    return T.read_trials(s, [f"{folder}/0", f"{folder}/1"]).groupBy("seed").agg(F.count("*").alias("n"), F.count("covfrob").alias("m"))


add("io6_io11_trial_files", _trial_files, "SELECT seed, count(*) AS n, CASE WHEN seed % 2 = 1 THEN count(*) ELSE 0 END AS m FROM trials GROUP BY seed", "trials")


def _appended(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s)
    for i in range(2):
        T.append_metrics(V.trials(s, d).where(C("seed") % 2 == i), path)
    return s.read.parquet(path).groupBy("seed").agg(F.count("*").alias("n"))


add("io12_appended_metrics", _appended, "SELECT seed, count(*) AS n FROM trials GROUP BY seed", "trials")
add("io14_feature_cache", lambda s, d: T.cached(s, new_folder(s), {"k": 3, "of": "phi"}, lambda: V.phi(s, d)).groupBy("k").agg(F.count("*").alias("n"), F.avg("phi").alias("m")), "SELECT k, count(*) AS n, avg(phi) AS m FROM phi GROUP BY k", "phi", "m")


def _annotation_file(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s)
    T.write_table(V.annotations(s, d).select(C("image_id").alias("image_name"), F.lit("x").alias("domain"), C("bbox").alias("BoxesString")), path)
    return T.read_annotations(s, path).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("bbox", F.lit("")))).alias("chars"))


add("io4_annotation_csv", _annotation_file, r"SELECT regexp_replace(image_id, '\.(jpg|png)$', '') AS image_id, count(*) AS n, sum(length(coalesce(bbox, '')))::BIGINT AS chars FROM ann GROUP BY 1", "ann")


def _result_files(s: SparkSession, d: str) -> DataFrame:
    root = new_folder(s)
    for name, model in (("one", "vit_base"), ("fast_two", "vit_full")):
        T.write_results(V.results(s, d).where(C("model") == model), f"{root}/{name}.csv")
    found, missing = T.read_results(s, root, ["one", "two", "three"], ["", "fast_"])
    return found.groupBy("experiment", "model").agg(F.count("*").alias("n"), F.avg("value").alias("value"), F.lit(len(missing)).alias("missing"))


add("io5_io9_result_files", _result_files, "SELECT CASE model WHEN 'vit_base' THEN 'one' ELSE 'fast_two' END AS experiment, model, count(*) AS n, avg(value) AS value, 1 AS missing FROM results WHERE model LIKE 'vit%' GROUP BY ALL", "results", "value")


def _timing_file(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s)
    rows = V.read(s, d, "orders").select(C("o_orderpriority").alias("function"), C("o_totalprice").alias("wall_time_s"), C("o_orderstatus").alias("model"))
    T.write_timings([rows.where("wall_time_s < 1e5").drop("model"), rows.where("wall_time_s >= 1e5")], path)
    return s.read.option("header", True).schema("function string, wall_time_s double, model string").csv(path).groupBy("function").agg(F.count("*").alias("n"), F.count("model").alias("m"), F.avg("wall_time_s").alias("mean"))


add("io10_timing_file", _timing_file, "SELECT o_orderpriority AS function, count(*) AS n, count(*) FILTER (o_totalprice >= 1e5) AS m, avg(o_totalprice) AS mean FROM orders GROUP BY 1", "", "mean")


def _eigenvalue_file(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s)
    T.write_table(R.explained(_spec(s, d)).select("component", "eigenvalue", C("explained").alias("cumulative_explained_variance")), path)
    return T.read_eigenvalues(s, path)


add("io13_eigenvalue_file", _eigenvalue_file, f"SELECT component::INT AS component, eigenvalue, explained AS cumulative_explained_variance FROM {EXPL}", "trials", "eigenvalue cumulative_explained_variance")


def _cube(s: SparkSession, d: str) -> str:
    """The panel as a cube file: latitude, longitude and value of each site, sites in order."""
    rows = V.panel(s, d).join(V.sites(s, d), "site_id")
    rows = written(rows.join(P.index_of(rows, ["site_id"], "i"), "site_id"))
    place = rows.select("i", F.lit(0).alias("t"), F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), C(c).alias("value")) for v, c in enumerate(("y", "x"))])).alias("p")).distinct()
    cells = rows.select("i", F.lit(2).alias("variable"), "t", C("z").alias("value")).unionByName(place.select("i", "p.variable", "t", "p.value"))
    size = rows.agg(F.max("i") + 1, F.max("t") + 1).first()
    folder = new_folder(s)
    T.write_cube(cells, folder, (size[0], 3, size[1]))
    return folder


CUBE = "(SELECT dense_rank() OVER (ORDER BY site_id) - 1 AS site_id, x, y, t, z FROM panel JOIN sites USING (site_id))"
LAST = 10


def _cube_part(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s)
    T.save_cube_part(s, _cube(s, d), path, 2, LAST)
    return s.read.parquet(path)


add("io2_cube", lambda s, d: T.read_cube(s, _cube(s, d), 2), f"SELECT * FROM {CUBE}", "panel sites", "x y z")
add("io3_cube_part", _cube_part, f"SELECT site_id, x, y, t - first AS t, z FROM {CUBE}, (SELECT max(t) - {LAST - 1} AS first FROM {CUBE}) WHERE t >= first", "panel sites", "x y z")


def _archives(s: SparkSession, d: str) -> DataFrame:
    folder = new_folder(s)
    T.write_archives(V.scored(s, d), folder, times=16, sites=64)
    rows = T.read_archives(s, folder).where("y_true IS NOT NULL")
    return rows.withColumn("seed", C("seed").cast("long"))


add("io7_prediction_archives", _archives, "SELECT seed, model, site_id, t, y_true, y_pred FROM scored", "scored", "y_true y_pred")
