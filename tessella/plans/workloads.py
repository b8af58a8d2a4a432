"""Three workloads end to end: reconstruction over a time split, prediction at held-out sites with
intervals, and labels and scores of image patches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.storage import written
from tessella.functions.tasks import in_task
from tessella.operators import boxes, fits, intervals, metrics, models, moments, panel, reports, splines

C = F.col


def filled(rows: DataFrame, value: str = "z") -> DataFrame:
    """Every (t, site), with the site's own mean where nothing was seen."""
    mean = rows.groupBy("site_id").agg(F.avg(value).alias("_m"))
    frame = panel.full_frame(rows.select("t", "site_id", value), rows, rows)
    return frame.join(mean, "site_id").select("site_id", "t", F.coalesce(value, "_m").alias(value))


def coordinates(sites: DataFrame, names: list) -> np.ndarray:
    rows = {r.site_id: (r.x, r.y) for r in sites.where(C("site_id").isin(names)).select("site_id", "x", "y").collect()}
    return np.array([rows[i] for i in names])


def long_basis(spark, names: list, phi: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(i), k, float(v)) for i, row in zip(names, phi) for k, v in enumerate(row)], "site_id long, k long, phi double")


def few(cells: DataFrame) -> bool:
    """Whether a matrix of all sites is one task's."""
    return cells.select("site_id").distinct().limit(moments.MOST_SITES + 1).count() <= moments.MOST_SITES


def penalised(cells: DataFrame, sites: DataFrame, k: int, tau1: float) -> DataFrame:
    """(site_id, k, phi): the leading eigenvectors of R'R - tau1 times the smoothing matrix, of a complete panel (t,
    site_id, v). Few sites are one matrix in one task; more of them are tiles, with the same result."""
    if not few(cells):
        return splines.penalised(cells, sites, k, tau1)[0].long()
    m = moments.moments(cells, "v")
    return long_basis(cells.sparkSession, m.sites, in_task(cells.sparkSession, _dense_penalised, m.gram, coordinates(sites, m.sites), tau1, k))


def _dense_penalised(gram: np.ndarray, xy: np.ndarray, tau1: float, k: int) -> np.ndarray:
    return models.penalised_basis(gram, models.smoothing_matrix(xy), tau1, k)


def _dense_fit(train: moments.Moments, val: moments.Moments, xy: np.ndarray, *args) -> models.BasisFit:
    return models.fit_basis(train, val, models.smoothing_matrix(xy), *args)


def _dense_diagnostics(m: moments.Moments, xy: np.ndarray, phi: np.ndarray, tau1: float, tau2: float) -> dict[str, float]:
    return models.fit_diagnostics(m, phi, models.smoothing_matrix(xy), tau1, tau2)


def parts(rows: DataFrame, value: str = "r") -> tuple[DataFrame, DataFrame, float, float]:
    """Of a complete panel with ``split``, its target z and residuals: (t, site_id, v) at train and at val times, and the
    target's deviation and mean square at train times."""
    y = rows.where("split = 'train'").agg(F.stddev_samp("z"), F.avg(C("z") * C("z"))).first()
    train, val = (rows.where(C("split") == n).select("t", "site_id", C(value).alias("v")) for n in ("train", "val"))
    return train, val, y[0], y[1]


def fitted(rows: DataFrame, sites: DataFrame, k: int, tau1: float, tau2: float, options: models.FitOptions | None = None) -> tuple[DataFrame, float, list[dict]]:
    """The long basis (site_id, k, phi), its best val rmse, and the rounds of the regularised fit of ``parts``' rows."""
    train, val, sd, square = parts(rows)
    if not few(train):
        fit = fits.fit_tall(train, val, sites, k, tau1, tau2, sd, square, options)
        return fit.long(), fit.best_rmse, fit.history
    own, other = moments.moments(train, "v"), moments.moments(val, "v")
    fit = in_task(rows.sparkSession, _dense_fit, own, other, coordinates(sites, own.sites), k, tau1, tau2, sd, square, options)
    return long_basis(rows.sparkSession, own.sites, fit.phi), fit.best_rmse, fit.history


def diagnostics(rows: DataFrame, sites: DataFrame, phi: DataFrame, tau1: float, tau2: float) -> dict[str, float]:
    """Of a long basis, on the residuals at train times."""
    train = parts(rows)[0]
    if not few(train):
        return fits.diagnostics(train, sites, phi, tau1, tau2)
    m = moments.moments(train, "v")
    own = {(r.site_id, r.k): r.phi for r in phi.collect()}
    k = 1 + max(j for _, j in own)
    return in_task(rows.sparkSession, _dense_diagnostics, m, coordinates(sites, m.sites), np.array([[own[i, j] for j in range(k)] for i in m.sites]), tau1, tau2)


def trials(by_seed: dict[int, DataFrame], sites: DataFrame, grid: DataFrame, k: int, options: models.FitOptions | None = None) -> DataFrame:
    """Every trial of a grid (seed, trial, tau1, tau2) on its seed's rows, as for ``fitted``. Few sites: a trial is a task
    that works on shared moments; more of them: a trial is a fit on tiles, one after the other."""
    spark, any_rows = grid.sparkSession, next(iter(by_seed.values()))
    if few(any_rows):
        stats, names = {}, None
        for seed, rows in by_seed.items():
            train, val, sd, square = parts(rows)
            own = moments.moments(train, "v")
            stats[seed], names = (own, moments.moments(val, "v"), sd, square), own.sites
        return models.run_trials(grid, stats, in_task(spark, models.smoothing_matrix, coordinates(sites, names)), k, options)
    done = []
    for r in grid.collect():
        train, val, sd, square = parts(by_seed[r.seed])
        fit = fits.fit_tall(train, val, sites, k, r.tau1, r.tau2, sd, square, options)
        done.append((r.seed, r.trial, r.tau1, r.tau2, fit.best_rmse, len(fit.history)))
    return spark.createDataFrame(done, "seed int, trial int, tau1 double, tau2 double, val_rmse double, rounds int")


def reconstruction(observed: DataFrame, sites: DataFrame, k: int = 3, tau1: float = 1.0, tau2: float = 0.0, options: models.FitOptions | None = None) -> DataFrame:
    """Long records (model, split, metric, value) of a first stage (site means over train times) and
    of the same with the projection of its residuals on the fitted basis. Two passes for moments,
    one for scores; the fit itself touches no rows."""
    rows = filled(observed)
    rows = panel.attach_split(rows, panel.split_contiguous(rows))
    rows = written(panel.centred_by_site(rows.withColumn("r", C("z")), "r", C("split") == "train"))
    out = models.projected(rows, fitted(rows, sites, k, tau1, tau2, options)[0])
    both = F.explode(F.array(F.struct(F.lit("trend").alias("model"), (C("z") - C("r")).alias("y_pred")), F.struct(F.lit("trend_basis").alias("model"), (C("z") - C("r") + C("fitted")).alias("y_pred"))))
    scored = out.select("split", C("z").alias("y_true"), both.alias("m")).select("split", "y_true", "m.*")
    return reports.long_records(metrics.by_split(scored, ["model"]), ["model", "split"], ["rmse", "mae", "r2"])


def held_out_prediction(observed: DataFrame, sites: DataFrame, share: float = 0.2, seed: int = 3, k: int = 3, tau1: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """(kind, n, rmse, cp, mpiw) at sites that the fit never sees, at test times: plug-in intervals,
    and intervals calibrated on the same sites at val times.

    Means and the basis come from observed sites at train times; the basis goes to the held-out
    sites by a spline; scores at each time are conditional on what is seen there."""
    rows = written(panel.attach_split(observed, panel.split_contiguous(observed)))
    seen, held = (written(part) for part in panel.split_sites(rows, share, seed))
    level = seen.where("split = 'train'").agg(F.avg("z")).first()[0]
    complete = written(filled(seen.where("split = 'train'").withColumn("r", C("z") - level), "r"))
    places = sites.join(complete.select("site_id").distinct(), "site_id", "left_semi")
    phi = written(penalised(complete.select("t", "site_id", C("r").alias("v")), places, k, tau1))
    fit = moments.plug_in(moments.basis_moments(complete, phi), rotate=True)
    basis = written(models.rotated(phi, fit.rotation))
    there = splines.interpolated(splines.splines(places), basis, sites.join(held.select("site_id").distinct(), "site_id", "left_semi"))
    later = seen.where("split <> 'train'").withColumn("r", C("z") - level)
    scores = models.conditional(later, basis, fit.eigenvalues, fit.noise)
    found = models.predicted_at(held.where("split <> 'train'"), scores, there, fit.noise)
    found = found.select("split", C("z").alias("y"), (C("mean") + level).alias("eta"), "var")
    found = written(found)
    q = intervals.critical_value(found.where("split = 'val'").withColumn("g", F.lit(1)), ["g"], "y", "eta", "var", alpha)
    test = found.where("split = 'test'").withColumn("g", F.lit(1)).join(q.select("g", "q_hat"), "g")

    def part(kind: str, q_hat: Column | None) -> DataFrame:
        low, high = intervals.interval(C("eta"), C("var"), alpha, q_hat=q_hat)
        return test.agg(F.count("*").alias("n"), metrics.rmse(C("y"), C("eta")).alias("rmse"), (100 * metrics.coverage(C("y"), low, high)).alias("cp"), metrics.mean_width(low, high).alias("mpiw")).select(F.lit(kind).alias("kind"), "*")

    return part("plug-in", None).unionByName(part("calibrated", C("q_hat")))


def patch_scores(annotations: DataFrame, logits: Column, seed: int = 5) -> DataFrame:
    """(split, cells, accuracy, f1, ece, auc) of patch logits (a column over image_id, r, c) against
    labels that come from the annotation boxes, by a split over images."""
    rows = annotations.select(boxes.image_key(C("image_id")).alias("image_id"), boxes.parsed(C("bbox")).alias("boxes"))
    labels = boxes.label_map(rows, "image_id", "boxes")
    split = panel.split_entities(labels, "image_id", 0.7, 0.15, seed)
    scored = labels.join(split, "image_id").withColumn("z", logits).withColumn("p", 1 / (1 + F.exp(-C("z"))))
    main = scored.groupBy("split").agg(F.count("*").alias("cells"), *[c.alias(n) for n, c in metrics.confusion(C("label"), C("z")).items()])
    ece = metrics.calibration_error(scored, ["split"], "label", "p")
    return main.join(ece, "split").join(metrics.auc(scored, ["split"], "label", "z"), "split")
