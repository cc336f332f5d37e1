"""Numerical solves by group: small problems in numpy, one group a task, in parallel over groups."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators import near


def normals(points: DataFrame, reach: float, digits: int | None = None) -> DataFrame:
    """(pid, nx, ny, nz, planarity): the least principal axis of the points within reach, turned up.

    Covariances and the 3 x 3 eigenproblems run in numpy, once a place; with digits, results are rounded there.
    Under three points, or points in line, give (0, 0, 1) and a null planarity.
    """

    def tell(count, c):
        m = np.empty((len(count), 3, 3))
        for k, (i, j) in enumerate((i, j) for i in range(3) for j in range(i, 3)):
            m[:, i, j] = m[:, j, i] = c[k]
        value, vector = np.linalg.eigh(m)
        n = vector[:, :, 0]
        n = n * np.where(n[:, 2:] < 0, -1, 1)
        total = value.sum(axis=1)
        bad = (count < 4) | (value[:, 1] <= 1e-12 * np.maximum(total, 1e-300))
        n[bad] = (0, 0, 1)
        flat = value[:, 0] / np.maximum(total, 1e-300)
        return [*near.decimals(n, digits).T, pa.array(near.decimals(flat, digits), mask=bad)]

    out = near.spread(points, reach, tell, "nx double, ny double, nz double, planarity double")
    return near.at_places(points.select("pid", "x", "y", "z"), out).select("pid", "nx", "ny", "nz", "planarity")


def undistort(x, y, k1: float = 0.0, k2: float = 0.0, k3: float = 0.0, p1: float = 0.0, p2: float = 0.0):
    """Inverse of Brown's model by Newton's method: a struct of x and y."""

    def solve(u: pd.Series, v: pd.Series) -> pd.DataFrame:
        tx, ty = u.to_numpy(float), v.to_numpy(float)
        a, b = tx.copy(), ty.copy()
        for _ in range(20):
            r2 = a * a + b * b
            radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
            slope = k1 + r2 * (2 * k2 + 3 * k3 * r2)
            fx = a * radial + 2 * p1 * a * b + p2 * (r2 + 2 * a * a) - tx
            fy = b * radial + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b - ty
            xx = radial + 2 * a * a * slope + 2 * p1 * b + 6 * p2 * a
            xy = 2 * a * b * slope + 2 * p1 * a + 2 * p2 * b
            yy = radial + 2 * b * b * slope + 6 * p1 * b + 2 * p2 * a
            det = xx * yy - xy * xy
            da, db = (yy * fx - xy * fy) / det, (xx * fy - xy * fx) / det
            a, b = a - da, b - db
            if max(np.nanmax(np.abs(da), initial=0), np.nanmax(np.abs(db), initial=0)) < 1e-14:
                break
        return pd.DataFrame({"x": a, "y": b})

    return F.pandas_udf(solve, "x double, y double")(x, y)


def _camera_rows(pdf: pd.DataFrame) -> np.ndarray:
    r = np.array(pdf["R"].tolist(), dtype=float).reshape(-1, 3, 3)
    t = np.array(pdf["t"].tolist(), dtype=float)
    k = np.zeros((len(pdf), 3, 3))
    k[:, 0, 0], k[:, 1, 1], k[:, 0, 2], k[:, 1, 2], k[:, 2, 2] = pdf["fx"], pdf["fy"], pdf["cx"], pdf["cy"], 1
    return k @ np.concatenate((r, t[:, :, None]), axis=2)


def triangulate(observations: DataFrame, by: str = "pt") -> DataFrame:
    """(pt, x, y, z, views, rms): by linear triangulation and two Gauss-Newton steps.

    observations: pt, u, v, R (9), t (3), fx, fy, cx, cy. Null with fewer than two views or in line.
    """
    kind = dict(observations.dtypes)[by]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        p, uv = _camera_rows(pdf), pdf[["u", "v"]].to_numpy(float)
        out = {by: [pdf[by].iloc[0]], "x": [None], "y": [None], "z": [None], "views": [len(pdf)], "rms": [None]}
        if len(pdf) >= 2:
            rows = np.concatenate((uv[:, :1] * p[:, 2] - p[:, 0], uv[:, 1:] * p[:, 2] - p[:, 1]))
            _, s, vt = np.linalg.svd(rows / np.linalg.norm(rows, axis=1, keepdims=True))
            if s[2] > 1e-9 * s[0] and abs(vt[3, 3]) > 1e-12:
                x = vt[3, :3] / vt[3, 3]
                for _ in range(2):
                    h = p @ np.append(x, 1)
                    e = h[:, :2] / h[:, 2:] - uv
                    j = (p[:, :2, :3] - (h[:, :2] / h[:, 2:])[:, :, None] * p[:, 2:, :3]) / h[:, 2][:, None, None]
                    x = x - np.linalg.lstsq(j.reshape(-1, 3), e.ravel(), rcond=None)[0]
                h = p @ np.append(x, 1)
                e = h[:, :2] / h[:, 2:] - uv
                out |= {"x": [x[0]], "y": [x[1]], "z": [x[2]], "rms": [float(np.sqrt((e * e).sum(axis=1).mean()))]}
        return pd.DataFrame(out)

    return observations.groupBy(by).applyInPandas(solve, f"{by} {kind}, x double, y double, z double, views long, rms double")


def eight_point(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fundamental matrix of matched pixels, normalised, of rank two."""

    def normal(p: np.ndarray) -> np.ndarray:
        c = p.mean(axis=0)
        s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(axis=1)).mean(), 1e-12)
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    ta, tb = normal(a), normal(b)
    ha, hb = (np.column_stack((p, np.ones(len(p)))) @ t.T for p, t in ((a, ta), (b, tb)))
    f = np.linalg.svd((hb[:, :, None] * ha[:, None, :]).reshape(-1, 9))[2][-1].reshape(3, 3)
    u, s, vt = np.linalg.svd(f)
    f = tb.T @ (u @ np.diag([s[0], s[1], 0]) @ vt) @ ta
    return f / max(np.linalg.norm(f), 1e-300)


def sampson(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sampson distances in pixels."""
    ha, hb = (np.column_stack((p, np.ones(len(p)))) for p in (a, b))
    fa, fb = ha @ f.T, hb @ f
    under = fa[:, 0] ** 2 + fa[:, 1] ** 2 + fb[:, 0] ** 2 + fb[:, 1] ** 2
    return np.abs((hb * fa).sum(axis=1)) / np.sqrt(np.maximum(under, 1e-300))


def verify_matches(matches: DataFrame, threshold: float = 2.0, rounds: int = 500, by: tuple[str, str] = ("id_a", "id_b")) -> DataFrame:
    """(pair, n, inliers, F): a fundamental matrix by RANSAC for each pair of images.

    matches: id_a, id_b, xa, ya, xb, yb. Draws are seeded by the pair; fewer than 8 matches give null.
    """
    kinds = dict(matches.dtypes)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["xa", "ya", "xb", "yb"], kind="stable")
        a, b = pdf[["xa", "ya"]].to_numpy(float), pdf[["xb", "yb"]].to_numpy(float)
        best, model = np.zeros(len(pdf), dtype=bool), None
        if len(pdf) >= 8:
            rng = np.random.default_rng([zlib.crc32(str(k).encode()) for k in key])
            for _ in range(rounds):
                pick = rng.choice(len(pdf), 8, replace=False)
                ok = sampson(eight_point(a[pick], b[pick]), a, b) < threshold
                if ok.sum() > best.sum():
                    best = ok
            if best.sum() >= 8:
                model = eight_point(a[best], b[best])
                best = sampson(model, a, b) < threshold
        return pd.DataFrame({by[0]: [key[0]], by[1]: [key[1]], "n": [len(pdf)], "inliers": [int(best.sum())], "F": [None if model is None else model.ravel().tolist()]})

    return matches.groupBy(*by).applyInPandas(solve, f"{by[0]} {kinds[by[0]]}, {by[1]} {kinds[by[1]]}, n long, inliers long, F array<double>")


def overlap_area(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """Area of the intersection of two convex polygons (Sutherland-Hodgman)."""

    def signed(p):
        return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True)) / 2

    clip = b if signed(b) > 0 else b[::-1]
    out = list(a)
    for (x1, y1), (x2, y2) in zip(clip, clip[1:] + clip[:1], strict=True):
        side = lambda p: (x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)  # noqa: B023, E731
        ring, out = out, []
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            return 0.0
    return abs(signed(out))


def footprint_pairs(items: DataFrame, cell: float, least: float = 0.3) -> DataFrame:
    """(id_a, id_b, overlap): footprints whose intersection is that share of the smaller one.

    items: id, ring (array of x, y). Boxes meet by the cells they cover, so only neighbours are tested.
    """
    box = items.select("id", "ring", *[f(F.col(f"ring.{c}")).alias(f"{c}{n}") for c in "xy" for n, f in (("0", F.array_min), ("1", F.array_max))])
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}0") / cell), F.floor(F.col(f"{c}1") / cell)))
    placed = box.withColumn("cx", span("x")).withColumn("cy", span("y"))
    a = placed.select("cx", "cy", F.col("id").alias("id_a"), F.col("ring").alias("ring_a"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "x1", "y0", "y1")])
    b = placed.select("cx", "cy", F.col("id").alias("id_b"), F.col("ring").alias("ring_b"), "x0", "x1", "y0", "y1")
    near = a.join(b, ["cx", "cy"]).where("id_a < id_b AND a_x0 <= x1 AND x0 <= a_x1 AND a_y0 <= y1 AND y0 <= a_y1").dropDuplicates(["id_a", "id_b"])

    def share(one: pd.Series, two: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(one, two, strict=True):
            p, q = ([(r["x"], r["y"]) for r in ring] for ring in (p, q))
            least_area = min(overlap_area(p, p), overlap_area(q, q))
            out.append(overlap_area(p, q) / least_area if least_area > 0 else 0.0)
        return pd.Series(out, dtype=float)

    scored = near.select("id_a", "id_b", F.pandas_udf(share, "double")("ring_a", "ring_b").alias("overlap"))
    return scored.where(F.col("overlap") >= least)


def cloth_ground(points: DataFrame, cell: float, block: int = 64, halo: int = 12, threshold: float = 0.5, rounds: int = 200, rigidness: int = 2) -> DataFrame:
    """(pid, classification): 2 ground, 1 above, 7 below, by a cloth let down on the inverted surface.

    Cells are dealt to blocks with a halo of cells around them, so a task holds one block; a
    cell's verdict comes from the block that owns it.
    """
    own = points.select("pid", "x", "y", "z", F.floor(F.col("x") / cell).cast("bigint").alias("cx"), F.floor(F.col("y") / cell).cast("bigint").alias("cy"))
    low = own.groupBy("cx", "cy").agg(F.min("z").alias("z"))
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / block), F.floor((F.col(c) + halo) / block)))
    dealt = low.withColumn("bx", spread("cx")).withColumn("by", spread("cy"))

    def drop(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["cx"].to_numpy(), pdf["cy"].to_numpy()
        x0, y0 = x.min(), y.min()
        surface = np.full((y.max() - y0 + 1, x.max() - x0 + 1), np.nan)
        surface[y - y0, x - x0] = -pdf["z"].to_numpy()
        empty = np.isnan(surface)
        ground = surface.copy()
        while np.isnan(ground).any():  # nearest fill, ring by ring
            pad = np.pad(ground, 1, constant_values=np.nan)
            around = np.stack([pad[1 + i : pad.shape[0] - 1 + i, 1 + j : pad.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)])
            mean = np.nanmax(np.where(np.isnan(around), -np.inf, around), axis=0)
            ground = np.where(np.isnan(ground) & np.isfinite(mean), mean, ground)
        cloth = np.full(ground.shape, ground.max() + 1.0)
        before, stuck = cloth.copy(), np.zeros(cloth.shape, dtype=bool)
        for _ in range(rounds):
            move = np.where(stuck, 0, (cloth - before) * 0.99 - 0.05)
            before = cloth.copy()
            cloth = cloth + move
            for _ in range(rigidness):
                pad = np.pad(cloth, 1, mode="edge")
                mean = (pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:]) / 4
                cloth = np.where(stuck, cloth, cloth + 0.5 * (mean - cloth))
            hit = cloth <= ground
            cloth, stuck = np.where(hit, ground, cloth), stuck | hit
            if np.abs(np.where(stuck, 0, cloth - before)).max(initial=0) < 1e-4:
                break
        mine = ~empty[y - y0, x - x0] & (x // block == key[0]) & (y // block == key[1])
        return pd.DataFrame({"cx": x[mine], "cy": y[mine], "ground": -cloth[y[mine] - y0, x[mine] - x0]})

    level = dealt.groupBy("bx", "by").applyInPandas(drop, "cx bigint, cy bigint, ground double")
    above = F.col("z") - F.col("ground")
    return own.join(level, ["cx", "cy"]).select("pid", F.when(F.abs(above) <= threshold, 2).when(above < 0, 7).otherwise(1).alias("classification"))
