"""Ordered series: sharpness against its surroundings, runs, velocities, frame rates, keyframes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Usual frame rates.
COMMON_FPS = [23.976, 24, 25, 29.97, 30, 48, 50, 59.94, 60, 90, 100, 119.88, 120, 240]


def relative_sharpness(series: DataFrame, window: int = 5, by: str = "seq", order: tuple[str, ...] = ("t", "id"), value: str = "sharpness") -> DataFrame:
    """value over the median of the rows around it (window // 2 each side); 1 where undefined."""
    half = window // 2
    frame = Window.partitionBy(by).orderBy(*order).rowsBetween(-half, half)
    return series.withColumn("_m", F.percentile(value, 0.5).over(frame)).withColumn("relative", F.when((F.col("_m") > 0) & F.col(value).isNotNull(), F.col(value) / F.col("_m")).otherwise(1.0)).drop("_m")


def runs(series: DataFrame, gap: float, by: str = "seq", order: tuple[str, ...] = ("t", "id")) -> DataFrame:
    """The series with `run`: a new one starts after a pause longer than gap."""
    w = Window.partitionBy(by).orderBy(*order)
    new = F.when(F.col("t") - F.lag("t").over(w) > gap, 1).otherwise(0)
    return series.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def velocities(series: DataFrame, axes: list[str], half: int = 2, gap: float = 8.0, by: str = "seq", order: tuple[str, ...] = ("t", "id")) -> DataFrame:
    """Least-squares slope of each axis over the rows around, inside the run; null for one moment."""
    frame = Window.partitionBy(by, "run").orderBy(*order).rowsBetween(-half, half)
    spread = F.var_pop("t").over(frame)
    return runs(series, gap, by, order).withColumns({f"v_{a}": F.when(spread > 0, F.regr_slope(a, "t").over(frame)) for a in axes})


def estimate_fps(times: DataFrame, by: str = "seq") -> DataFrame:
    """(seq, fps): from the lower quartile of gaps, a usual rate within 1 %, else two decimals."""
    w = Window.partitionBy(by).orderBy("t")
    gaps = times.select(by, "t").distinct().withColumn("gap", F.col("t") - F.lag("t").over(w)).where("gap > 1e-4")
    ordered = gaps.groupBy(by).agg(F.sort_array(F.collect_list("gap")).alias("g")).where(F.size("g") >= 3)
    raw = ordered.select(by, (1.0 / F.get("g", F.floor(F.size("g") * 0.25).cast("int"))).alias("raw"))
    snapped = F.coalesce(*[F.when(F.abs(F.col("raw") - r) <= 0.01 * r, F.lit(float(r))) for r in COMMON_FPS], F.floor(F.col("raw") * 100 + 0.5) / 100)
    return raw.select(by, snapped.alias("fps"))


def interval_times(spans: DataFrame, every: float, by: str = "seq") -> DataFrame:
    """(seq, k, t): sampling times from 0 to the duration (spans: seq, duration)."""
    n = F.floor(F.col("duration") / every + 1e-9).cast("bigint")
    return spans.select(by, F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("k")).withColumn("t", F.round(F.col("k") * F.lit(every), 6))


def pick_keyframes(travel: np.ndarray, sharp: np.ndarray, step: float) -> list[int]:
    """Greedy: the sharpest frame with travel in (step / 2, step] after the last one taken."""
    if not len(travel):
        return []
    taken, at = [0], 0
    # travel never falls: the frames in reach are a span.
    while True:
        first = max(at + 1, int(np.searchsorted(travel, travel[at] + step / 2, side="right")))
        last = int(np.searchsorted(travel, travel[at] + step, side="right"))
        if first < last:
            at = first + int(np.argmax(sharp[first:last]))
        elif last < len(travel):
            at = last
        else:
            return taken
        taken.append(at)


def select_keyframes(series: DataFrame, step: float, most: int = 200, by: str = "seq") -> DataFrame:
    """(seq, id): keyframes of each sequence (series: seq, id, t, travel, sharpness).

    The step widens by bisection until at most `most` frames are taken. One sequence is one task.
    """
    kinds = dict(series.dtypes)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id"], kind="stable")
        travel, sharp = np.maximum.accumulate(pdf["travel"].to_numpy(float)), pdf["sharpness"].to_numpy(float)
        taken = pick_keyframes(travel, sharp, step)
        if len(taken) > most:
            low, high = step, max(step * 2, float(travel[-1] - travel[0]) + 1)
            for _ in range(40):
                mid = (low + high) / 2
                if len(pick_keyframes(travel, sharp, mid)) > most:
                    low = mid
                else:
                    high = mid
            taken = pick_keyframes(travel, sharp, high)
        return pdf.iloc[taken][[by, "id"]]

    return series.select(by, "id", "t", "travel", "sharpness").groupBy(by).applyInPandas(pick, f"{by} {kinds[by]}, id {kinds['id']}")


def verdict(sharp: Column, over: Column, under: Column, blurry: float = 0.6, clipped: float = 0.05) -> Column:
    """Flags of an image; unknown sharpness is never blurry."""
    return F.when(sharp < blurry, "blurry").when(over > clipped, "over").when(under > clipped, "under").otherwise("ok")


def run_diff(history: DataFrame, metric: str, higher_is_better: bool, order: str = "run") -> DataFrame:
    """The metric against the run before: delta and better, worse or same.

    Rows where both are null are left out; one null gives a null delta and 'same'. History has
    a row for each run.
    """
    w = Window.orderBy(order)
    both = history.select(order, F.col(metric).alias("cur")).withColumn("prev", F.lag("cur").over(w)).withColumn("first", F.row_number().over(w) == 1)
    delta = F.col("cur") - F.col("prev")
    eps = F.abs("prev") * 1e-6 + 1e-9
    better = delta > eps if higher_is_better else delta < -eps
    worse = delta < -eps if higher_is_better else delta > eps
    return both.where("not first and (cur is not null or prev is not null)").select(order, "prev", "cur", delta.alias("delta"), F.when(delta.isNull(), "same").when(better, "better").when(worse, "worse").otherwise("same").alias("verdict"))
