"""Accuracy and quality: robust summaries, survey standards, fits, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance_stats(d: DataFrame, value: str = "distance") -> DataFrame:
    """One row: n, mean, median, rms, p95, min, max, and of absolute values mean and p95."""
    v = F.col(value)
    return d.where(v.isNotNull() & ~F.isnan(v)).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.sqrt(F.avg(v * v)).alias("rms"), F.percentile(v, 0.95).alias("p95"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(F.abs(v)).alias("mean_abs"), F.percentile(F.abs(v), 0.95).alias("p95_abs"))


def summarize_differences(d: DataFrame, value: str = "dz", by: list[str] | None = None) -> DataFrame:
    """n, mean, std (n - 1), rmse, median, NMAD, LE90, LE95, q02, q98, by group."""
    by = by or []
    v = F.col(value)
    whole = d.where(v.isNotNull())
    first = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.sqrt(F.avg(v * v)).alias("rmse"), F.percentile(v, 0.5).alias("median"), F.percentile(F.abs(v), 0.9).alias("le90"), F.percentile(F.abs(v), 0.95).alias("le95"), F.percentile(v, 0.02).alias("q02"), F.percentile(v, 0.98).alias("q98"))
    # By groups a plain join: adaptive execution broadcasts the medians if they are few.
    centred = whole.join(first.select(*by, "median"), by) if by else whole.join(F.broadcast(first.select("median")))
    second = centred.groupBy(*by).agg((F.percentile(F.abs(v - F.col("median")), 0.5) * 1.4826).alias("nmad"))
    return first.join(second, by) if by else first.join(F.broadcast(second))  # one row each


def difference_histogram(d: DataFrame, low: float, high: float, bins: int, value: str = "dz") -> DataFrame:
    """(bin, n): bins of [low, high], the last one closed; -1 below, `bins` above."""
    v = F.col(value)
    width = (high - low) / bins
    at = F.when(v < low, -1).when(v > high, bins).otherwise(F.least(F.lit(bins - 1), F.floor((v - low) / width)))
    return d.where(v.isNotNull()).groupBy(at.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def axis_stats(d: DataFrame, axis: str, by: list[str]) -> DataFrame:
    """n, mean, sd (n - 1), rmse, with the screens on the mean and on blunders."""
    v = F.col(axis)
    stats = d.where(v.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.sqrt(F.avg(v * v)).alias("rmse"), F.max(F.abs(v)).alias("worst"))
    return stats.select(*by, "n", "mean", "sd", "rmse", ((F.col("n") > 1) & (F.abs("mean") > 0.25 * F.col("rmse"))).alias("mean_flag"), ((F.col("n") > 2) & (F.col("worst") > 3 * F.col("rmse"))).alias("blunder"))


def asprs(d: DataFrame, by: list[str], survey_h: float | None = None, survey_v: float | None = None, least: int = 30) -> DataFrame:
    """Horizontal and vertical accuracy, with the survey's own in quadrature where declared."""
    planar = F.col("dx").isNotNull() & F.col("dy").isNotNull()
    rms = lambda c, ok: F.sqrt(F.avg(F.when(ok, F.col(c) * F.col(c))))
    a = d.groupBy(*by).agg(F.count_if(planar).alias("n_h"), F.count_if(F.col("dz").isNotNull()).alias("n_v"), rms("dx", planar).alias("rx"), rms("dy", planar).alias("ry"), rms("dz", F.col("dz").isNotNull()).alias("rv"))
    h = F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry"))
    product = lambda c, s: F.sqrt(c * c + s * s) if s is not None else c
    return a.select(*by, "n_h", "n_v", h.alias("rmse_h"), F.col("rv").alias("rmse_v"), product(h, survey_h).alias("product_h"), product(F.col("rv"), survey_v).alias("product_v"), (F.greatest("n_h", "n_v") >= least).alias("enough"))


def fit_scale(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Scale from measured and known distances (dm, dk, weight): s = sum(w dm dk) / sum(w dm^2).

    A distance that is missing or not positive makes the group's result null; a weight that is
    missing or not positive counts as 1.
    """
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    bad = F.coalesce((F.col("dm") <= 0) | (F.col("dk") <= 0), F.lit(True))
    sums = pairs.withColumn("w", w).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(bad).alias("bad"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("dm") * F.col("dk")).alias("mk"), F.sum(F.col("w") * F.col("dm") * F.col("dm")).alias("mm"), F.sum(F.col("w") * F.col("dk") * F.col("dk")).alias("kk"))
    s = F.col("mk") / F.col("mm")
    rss = F.greatest(F.lit(0.0), F.col("kk") - 2 * s * F.col("mk") + s * s * F.col("mm"))
    return sums.select(*by, "n", F.when(~F.col("bad"), s).alias("scale"), F.when(~F.col("bad"), F.sqrt(rss / F.col("sw"))).alias("rms"))


def fit_plane(points: DataFrame, by: list[str]) -> DataFrame:
    """z = a x + b y + c by centred normal equations; null where the points are in line."""
    mean = {f"m{c}": F.avg(c) for c in "xyz"}
    sums = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in mean.items()], F.covar_pop("x", "x").alias("sxx"), F.covar_pop("y", "y").alias("syy"), F.covar_pop("x", "y").alias("sxy"), F.covar_pop("x", "z").alias("sxz"), F.covar_pop("y", "z").alias("syz"))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    ok = F.abs(det) > 1e-12 * F.greatest(F.col("sxx") * F.col("syy"), F.lit(1e-300))
    a = (F.col("sxz") * F.col("syy") - F.col("syz") * F.col("sxy")) / F.nullif(det, F.lit(0.0))
    b = (F.col("syz") * F.col("sxx") - F.col("sxz") * F.col("sxy")) / F.nullif(det, F.lit(0.0))
    return sums.select(*by, "n", F.when(ok, a).alias("a"), F.when(ok, b).alias("b"), F.when(ok, F.col("mz") - a * F.col("mx") - b * F.col("my")).alias("c"))


def classify(value: Column, direction: str, warn: float, bad: float) -> Column:
    """ok, warn, bad or missing. direction: high (more is better), low, low-abs."""
    v = F.abs(value) if direction == "low-abs" else value
    worse = (lambda t: v < t) if direction == "high" else (lambda t: v >= t)
    return F.when(value.isNull(), "missing").when(worse(bad), "bad").when(worse(warn), "warn").otherwise("ok")


def gate(value: Column, op: str, threshold: float) -> Column:
    """pass, fail or missing (which counts as failing)."""
    test = {">=": value >= threshold, ">": value > threshold, "<=": value <= threshold, "<": value < threshold, "==": value == threshold}[op]
    return F.when(value.isNull(), "missing").when(test, "pass").otherwise("fail")


def similarity_sums(pairs: DataFrame) -> DataFrame:
    """One row of the sums from which a similarity between two point sets is solved."""
    cross = [F.covar_pop(f"s{a}", f"t{b}").alias(f"c{a}{b}") for a in "xyz" for b in "xyz"]
    return pairs.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"{p}{a}").alias(f"m{p}{a}") for p in "st" for a in "xyz"], *cross, sum((F.var_pop(f"s{a}") for a in "xyz"), F.lit(0.0)).alias("vs"))


def fit_similarity(pairs: DataFrame, with_scale: bool = True) -> dict:
    """Scale, rotation and translation from s (sx, sy, sz) to t by Horn's closed form.

    The data stay where they are: 16 sums come to the driver.
    """
    import numpy as np

    r = similarity_sums(pairs).first()
    if r["n"] < 3:
        raise ValueError("a similarity takes three points at least")
    c = np.array([[r[f"c{a}{b}"] for b in "xyz"] for a in "xyz"])
    u, d, vt = np.linalg.svd(c.T)
    if d[1] <= 1e-12 * max(d[0], 1e-300):
        raise ValueError("the points are in line")
    sign = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    rotation = u @ sign @ vt
    scale = float((d * np.diag(sign)).sum() / r["vs"]) if with_scale else 1.0
    source, target = np.array([r[f"ms{a}"] for a in "xyz"]), np.array([r[f"mt{a}"] for a in "xyz"])
    return {"scale": scale, "rotation": rotation, "translation": target - scale * rotation @ source}


def icp(source: DataFrame, reference: DataFrame, reach: float, rounds: int = 20, trim: float = 0.9) -> dict:
    """Point-to-point alignment: exact nearest neighbours, the best share, a similarity a round.

    A round sends 16 sums to the driver. source, reference: pid, x, y, z.
    """
    import numpy as np

    from terrafold.operators.cloud import as_target, cloud_distance, transform

    rotation, translation = np.eye(3), np.zeros(3)
    last = None
    for _ in range(rounds):
        matrix = [[*map(float, row), float(t)] for row, t in zip(rotation, translation, strict=True)] + [[0, 0, 0, 1]]
        moved = transform(source, matrix)
        near = cloud_distance(moved, reference, reach).where("distance is not null")
        cut = near.agg(F.percentile("distance", trim)).first()[0]
        if cut is None:
            break
        pairs = near.where(F.col("distance") <= cut).join(moved, "pid").join(as_target(reference), "qid").select(*[F.col(a).alias(f"s{a}") for a in "xyz"], "tx", "ty", "tz")
        step = fit_similarity(pairs, with_scale=False)
        rotation, translation = step["rotation"] @ rotation, step["rotation"] @ translation + step["translation"]
        size = float(np.abs(step["translation"]).max() + np.abs(step["rotation"] - np.eye(3)).max())
        if last is not None and size < 1e-9:
            break
        last = size
    return {"rotation": rotation, "translation": translation}


def nuth_kaab(differences: DataFrame) -> dict:
    """One step of horizontal coregistration: dh / tan(slope) = a cos(aspect) + b sin(aspect) + c.

    differences: dh, slope, aspect in degrees; slopes of 5 to 45 degrees within 3 NMAD count.
    """
    import numpy as np

    use = differences.where("dh is not null and slope between 5 and 45")
    m = use.agg(F.percentile("dh", 0.5)).first()[0]
    if m is None:
        return {"east": 0.0, "north": 0.0, "up": 0.0, "n": 0}
    spread = use.agg(F.percentile(F.abs(F.col("dh") - m), 0.5)).first()[0] * 1.4826
    near = use.where(F.abs(F.col("dh") - m) <= 3 * spread + 1e-12)
    y, c, s = F.col("dh") / F.tan(F.radians("slope")), F.cos(F.radians("aspect")), F.sin(F.radians("aspect"))
    r = near.agg(F.count(F.lit(1)), F.sum(c * c), F.sum(c * s), F.sum(c), F.sum(s * s), F.sum(s), F.sum(c * y), F.sum(s * y), F.sum(y), F.avg(F.tan(F.radians("slope")))).first()
    n, cc, cs, c1, ss, s1, cy, sy, y1, tan = r
    a, b, k = np.linalg.lstsq(np.array([[cc, cs, c1], [cs, ss, s1], [c1, s1, n]]), np.array([cy, sy, y1]), rcond=None)[0]
    return {"east": float(b), "north": float(a), "up": float(k * tan), "n": n}
