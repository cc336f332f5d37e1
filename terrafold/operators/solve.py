"""Numerical solves of a block each: bundle adjustment, camera poses, depth maps, planar priors, blending.

A block, a photograph or a tile is one group and one task; what it holds is bounded by its size.
The numpy functions work on arrays alone; the DataFrame functions bring each group's rows together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSE = [*[f"r{k}" for k in range(9)], *[f"t{k}" for k in range(3)]]
LENS = ["fx", "fy", "cx", "cy"]


def turn(w: np.ndarray) -> np.ndarray:
    """Rotations of rotation vectors (.., 3)."""
    angle = np.linalg.norm(w, axis=-1)[..., None, None]
    k = cross(w / np.maximum(angle[..., 0], 1e-300))
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


def cross(v: np.ndarray) -> np.ndarray:
    """Matrices of the cross product with vectors (.., 3)."""
    out = np.zeros((*v.shape[:-1], 3, 3))
    out[..., 0, 1], out[..., 0, 2], out[..., 1, 2] = -v[..., 2], v[..., 1], -v[..., 0]
    return out - np.swapaxes(out, -1, -2)


def residuals(r: np.ndarray, t: np.ndarray, lens: np.ndarray, x: np.ndarray, uv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Errors in pixels and their derivatives by rotation and shift (2 x 6) and by the point (2 x 3), and which lie in front."""
    rx = np.einsum("nij,nj->ni", r, x)
    p = rx + t
    front = p[:, 2] > 1e-9
    z = np.where(front, p[:, 2], 1.0)
    fx, fy, cx, cy = lens.T
    error = np.stack((fx * p[:, 0] / z + cx, fy * p[:, 1] / z + cy), axis=1) - uv
    d = np.zeros((len(x), 2, 3))
    d[:, 0, 0], d[:, 0, 2] = fx / z, -fx * p[:, 0] / z**2
    d[:, 1, 1], d[:, 1, 2] = fy / z, -fy * p[:, 1] / z**2
    pose = np.concatenate((d @ -cross(rx), d), axis=2)
    return error, pose, d @ r, front


def bundle(r: np.ndarray, t: np.ndarray, lens: np.ndarray, x: np.ndarray, cam: np.ndarray, pt: np.ndarray, uv: np.ndarray, rounds: int = 30, huber: float = 2.0, fixed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Cameras and points of the least robust reprojection error: Levenberg-Marquardt, points eliminated first.

    The first `fixed` cameras stay. Returns rotations, shifts, points and the cost after each accepted step.
    """
    m, n, damp = len(r), len(x), 1e-3
    order = np.argsort(pt, kind="stable")
    cam, pt, uv = cam[order], pt[order], uv[order]
    count = np.bincount(pt, minlength=n)
    start = np.cumsum(count) - count
    # Every two observations of one point, for the cameras' reduced system.
    one = np.repeat(np.arange(len(pt)), count[pt])
    two = np.repeat(start[pt], count[pt]) + np.arange(len(one)) - np.repeat(np.cumsum(count[pt]) - count[pt], count[pt])

    def cost_of(r, t, x):
        e, _, _, front = residuals(r[cam], t[cam], lens[cam], x[pt], uv)
        size = np.linalg.norm(e, axis=1)
        return float(np.where(front, np.where(size <= huber, size**2, 2 * huber * size - huber**2), 1e4).sum())

    now, costs = cost_of(r, t, x), []
    for _ in range(rounds):
        e, a, b, front = residuals(r[cam], t[cam], lens[cam], x[pt], uv)
        size = np.linalg.norm(e, axis=1)
        w = np.where(front, np.minimum(1, huber / np.maximum(size, 1e-12)), 0.0)[:, None, None]
        wa, wb = a * w, b * w
        u, v = np.zeros((m, 6, 6)), np.zeros((n, 3, 3))
        np.add.at(u, cam, np.swapaxes(a, 1, 2) @ wa)
        np.add.at(v, pt, np.swapaxes(b, 1, 2) @ wb)
        ga, gb = np.zeros((m, 6)), np.zeros((n, 3))
        np.add.at(ga, cam, np.einsum("nij,ni->nj", wa, e))
        np.add.at(gb, pt, np.einsum("nij,ni->nj", wb, e))
        cross_terms = np.swapaxes(a, 1, 2) @ wb  # cameras by points, one for each observation
        for _ in range(8):
            ud = u + damp * np.einsum("nii->ni", u)[:, :, None] * np.eye(6) + 1e-12 * np.eye(6)
            vd = v + damp * np.einsum("nii->ni", v)[:, :, None] * np.eye(3) + 1e-9 * np.eye(3)
            vi = np.linalg.inv(vd)
            s = np.zeros((m, m, 6, 6))
            np.add.at(s, (cam[one], cam[two]), -cross_terms[one] @ vi[pt[one]] @ np.swapaxes(cross_terms[two], 1, 2))
            s[np.arange(m), np.arange(m)] += ud
            rhs = -ga.copy()
            np.add.at(rhs, cam, np.einsum("nij,njk,nk->ni", cross_terms, vi[pt], gb[pt]))
            free = np.arange(6 * fixed, 6 * m)
            step = np.zeros(6 * m)
            if len(free):
                full = s.transpose(0, 2, 1, 3).reshape(6 * m, 6 * m)
                step[free] = np.linalg.lstsq(full[np.ix_(free, free)], rhs.ravel()[free], rcond=None)[0]
            step = step.reshape(m, 6)
            back = -gb.copy()
            np.add.at(back, pt, -np.einsum("nji,nj->ni", cross_terms, step[cam]))
            dx = np.einsum("nij,nj->ni", vi, back)
            moved = turn(step[:, :3])
            r2, t2, x2 = moved @ r, t + step[:, 3:], x + dx
            then = cost_of(r2, t2, x2)
            if then < now:
                break
            damp *= 10
        else:
            break
        done = now - then < 1e-9 * max(now, 1e-12)
        r, t, x, now, damp = r2, t2, x2, then, max(damp / 10, 1e-12)
        costs.append(now)
        if done:
            break
    return r, t, x, costs


def bundle_adjust(observations: DataFrame, cameras: DataFrame, points: DataFrame, rounds: int = 30, huber: float = 2.0, most: int = 2_000_000) -> DataFrame:
    """(block, kind, id, values): adjusted cameras (twelve values, rotation and shift) and points (three).

    observations: block, image_id, pt, u, v; cameras: block, image_id, r0..r8, t0..t2, fx, fy, cx, cy;
    points: block, pt, x, y, z. The block's smallest photograph stays. A block of over `most` observations
    is an error: part it first. Points seen once, and cameras without observations, stay out.
    """
    seen = observations.select("block", "image_id", "pt", "u", "v").join(points.select("block", "pt", "x", "y", "z"), ["block", "pt"])
    often = seen.groupBy("block", "pt").agg(F.count_distinct("image_id").alias("_n")).where("_n >= 2").select("block", "pt")
    rows = seen.join(often, ["block", "pt"]).join(cameras.select("block", "image_id", *POSE, *LENS), ["block", "image_id"])
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    if not sizes.isEmpty():
        raise ValueError(f"a block of over {most} observations")
    kind = dict(rows.dtypes)["block"]

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["image_id", "pt", "u", "v"], kind="stable")
        images, cam = np.unique(pdf["image_id"], return_inverse=True)
        ids, pt = np.unique(pdf["pt"], return_inverse=True)
        first_cam, first_pt = np.unique(cam, return_index=True)[1], np.unique(pt, return_index=True)[1]
        r = pdf[POSE[:9]].to_numpy(float)[first_cam].reshape(-1, 3, 3)
        t, lens = pdf[POSE[9:]].to_numpy(float)[first_cam], pdf[LENS].to_numpy(float)[first_cam]
        x = pdf[["x", "y", "z"]].to_numpy(float)[first_pt]
        r, t, x, _ = bundle(r, t, lens, x, cam, pt, pdf[["u", "v"]].to_numpy(float), rounds, huber)
        values = [*np.concatenate((r.reshape(-1, 9), t), axis=1).tolist(), *x.tolist()]
        return pd.DataFrame({"block": key[0], "kind": ["camera"] * len(images) + ["point"] * len(ids), "id": [*images, *ids], "values": values})

    return rows.groupBy("block").applyInPandas(solve, f"block {kind}, kind string, id long, values array<double>")


def pose_of(x: np.ndarray, uv: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """A camera's rotation and shift from six points or more (direct linear transform)."""
    p = np.stack(((uv[:, 0] - lens[2]) / lens[0], (uv[:, 1] - lens[3]) / lens[1]), axis=1)
    mean, size = x.mean(axis=0), max(float(x.std()), 1e-12)
    h = np.column_stack(((x - mean) / size, np.ones(len(x))))
    a = np.zeros((2 * len(x), 12))
    a[::2, :4], a[::2, 8:] = h, -p[:, :1] * h
    a[1::2, 4:8], a[1::2, 8:] = h, -p[:, 1:] * h
    m = np.linalg.svd(a)[2][-1].reshape(3, 4)
    if (m[2] @ h.T).sum() < 0:
        m = -m
    u, s, vt = np.linalg.svd(m[:, :3] / size)
    r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    if s[2] < 1e-6 * s[0]:
        return None
    scale = s.mean()
    return r, (m[:, 3] / scale) - r @ mean


def refine_pose(r: np.ndarray, t: np.ndarray, x: np.ndarray, uv: np.ndarray, lens: np.ndarray, rounds: int = 10, huber: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Newton steps on the robust reprojection error."""
    n = len(x)
    for _ in range(rounds):
        e, a, _, front = residuals(np.broadcast_to(r, (n, 3, 3)), np.broadcast_to(t, (n, 3)), np.broadcast_to(lens, (n, 4)), x, uv)
        w = np.where(front, np.minimum(1, huber / np.maximum(np.linalg.norm(e, axis=1), 1e-12)), 0.0)[:, None, None]
        step = np.linalg.lstsq((np.swapaxes(a, 1, 2) @ (a * w)).sum(axis=0) + 1e-9 * np.eye(6), -np.einsum("nij,ni->j", a * w, e), rcond=None)[0]
        r, t = turn(step[None, :3])[0] @ r, t + step[3:]
        if np.abs(step).max() < 1e-12:
            break
    return r, t


def locate(x: np.ndarray, uv: np.ndarray, lens: np.ndarray, limit: float = 4.0, tries: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(rotation, shift, which agree) of a photograph: samples of six, the best refined on all that agree."""
    if len(x) < 6:
        return None
    rng, best = np.random.default_rng(seed), None

    def off(r, t):
        n = len(x)
        e, _, _, front = residuals(np.broadcast_to(r, (n, 3, 3)), np.broadcast_to(t, (n, 3)), np.broadcast_to(lens, (n, 4)), x, uv)
        return np.where(front, np.linalg.norm(e, axis=1), np.inf)

    for _ in range(tries):
        pick = rng.choice(len(x), 6, replace=False)
        found = pose_of(x[pick], uv[pick], lens)
        if found is None:
            continue
        ok = off(*found) <= limit
        if best is None or ok.sum() > best[2].sum():
            best = *found, ok
            if ok.mean() > 0.9:
                break
    if best is None or best[2].sum() < 6:
        return None
    r, t, ok = best
    for _ in range(3):
        r, t = refine_pose(r, t, x[ok], uv[ok], lens)
        now = off(r, t) <= limit
        if now.sum() < 6 or (now == ok).all():
            break
        ok = now
    return r, t, off(r, t) <= limit


def register_images(matches: DataFrame, points: DataFrame, lenses: DataFrame, least: int = 12, limit: float = 4.0) -> DataFrame:
    """(image_id, r0..r8, t0..t2, inliers, matched): poses of photographs from placed points that they see.

    matches: image_id, pt, u, v; points: pt, x, y, z; lenses: image_id, fx, fy, cx, cy. A photograph with
    fewer than `least` agreeing points isn't placed.
    """
    rows = matches.select("image_id", "pt", "u", "v").join(points.select("pt", "x", "y", "z"), "pt").join(lenses.select("image_id", *LENS), "image_id")
    kind = dict(rows.dtypes)["image_id"]

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pt", "u", "v"], kind="stable")
        found = locate(pdf[["x", "y", "z"]].to_numpy(float), pdf[["u", "v"]].to_numpy(float), pdf[LENS].to_numpy(float)[0], limit)
        if found is None or found[2].sum() < least:
            return pd.DataFrame({c: [] for c in ("image_id", *POSE, "inliers", "matched")})
        values = [*found[0].ravel(), *found[1]]
        return pd.DataFrame({"image_id": [key[0]], **{c: [float(v)] for c, v in zip(POSE, values, strict=True)}, "inliers": [int(found[2].sum())], "matched": [len(pdf)]})

    schema = f"image_id {kind}, " + ", ".join(f"{c} double" for c in POSE) + ", inliers long, matched long"
    return rows.groupBy("image_id").applyInPandas(solve, schema)


def motions(f: np.ndarray, ka: np.ndarray, kb: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four rotations and unit shifts that an essential matrix K_b^T F K_a allows."""
    u, _, vt = np.linalg.svd(kb.T @ f @ ka)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return [(r, s * u[:, 2]) for r in (u @ w @ vt, u @ w.T @ vt) for s in (1, -1)]


def between(r: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Points in the first camera's frame from normalised places in two, by linear triangulation."""
    p, q = np.eye(3, 4), np.column_stack((r, t))
    rows = np.stack([a[:, :1] * p[2] - p[0], a[:, 1:] * p[2] - p[1], b[:, :1] * q[2] - q[0], b[:, 1:] * q[2] - q[1]], axis=1)
    v = np.linalg.svd(rows)[2][:, -1]
    return v[:, :3] / np.where(np.abs(v[:, 3:]) < 1e-12, 1e-12, v[:, 3:])


def relative_pose(f: np.ndarray, ka: np.ndarray, kb: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(rotation, unit shift, which lie in front of both, median angle of their rays in degrees) of matched pixels."""
    na, nb = ((np.column_stack((p, np.ones(len(p)))) @ np.linalg.inv(k).T)[:, :2] for p, k in ((a, ka), (b, kb)))
    best = None
    for r, t in motions(f, ka, kb):
        x = between(r, t, na, nb)
        front = (x[:, 2] > 0) & ((x @ r.T + t)[:, 2] > 0)
        if best is None or front.sum() > best[2].sum():
            best = r, t, front, x
    r, t, front, x = best
    if not front.any():
        return r, t, front, 0.0
    p = x[front]
    q = p + r.T @ t  # from the second camera
    cosine = (p * q).sum(axis=1) / np.maximum(np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1), 1e-300)
    return r, t, front, float(np.degrees(np.median(np.arccos(np.clip(cosine, -1, 1)))))


def relative_poses(matches: DataFrame, models: DataFrame, lenses: DataFrame) -> DataFrame:
    """(id_a, id_b, r0..r8, t0..t2, kept, angle): the motion between the photographs of each pair.

    matches: id_a, id_b, xa, ya, xb, yb (inliers); models: id_a, id_b, F (nine values); lenses: image_id, fx, fy, cx, cy.
    kept: matches in front of both. Pairs without a model are absent.
    """
    lens = lambda c: lenses.select(F.col("image_id").alias(f"id_{c}"), *[F.col(k).alias(f"{k}_{c}") for k in LENS])
    rows = matches.select("id_a", "id_b", "xa", "ya", "xb", "yb").join(models.where("F is not null").select("id_a", "id_b", "F"), ["id_a", "id_b"]).join(lens("a"), "id_a").join(lens("b"), "id_b")
    kinds = dict(rows.dtypes)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["xa", "ya", "xb", "yb"], kind="stable")
        first = pdf.iloc[0]
        ka, kb = (np.array([[first[f"fx_{c}"], 0, first[f"cx_{c}"]], [0, first[f"fy_{c}"], first[f"cy_{c}"]], [0, 0, 1]], dtype=float) for c in "ab")
        r, t, front, angle = relative_pose(np.array(first["F"], dtype=float).reshape(3, 3), ka, kb, pdf[["xa", "ya"]].to_numpy(float), pdf[["xb", "yb"]].to_numpy(float))
        return pd.DataFrame({"id_a": [key[0]], "id_b": [key[1]], **{c: [float(v)] for c, v in zip(POSE, [*r.ravel(), *t], strict=True)}, "kept": [int(front.sum())], "angle": [angle]})

    schema = f"id_a {kinds['id_a']}, id_b {kinds['id_b']}, " + ", ".join(f"{c} double" for c in POSE) + ", kept long, angle double"
    return rows.groupBy("id_a", "id_b").applyInPandas(solve, schema)


def homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The plane map of matched pixels, normalised."""

    def normal(p: np.ndarray) -> np.ndarray:
        c = p.mean(axis=0)
        s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(axis=1)).mean(), 1e-12)
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    ta, tb = normal(a), normal(b)
    ha, hb = (np.column_stack((p, np.ones(len(p)))) @ t.T for p, t in ((a, ta), (b, tb)))
    rows = np.zeros((2 * len(a), 9))
    rows[::2, 3:6], rows[::2, 6:] = -ha, hb[:, 1:2] * ha
    rows[1::2, :3], rows[1::2, 6:] = ha, -hb[:, :1] * ha
    h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    return h / max(np.linalg.norm(h), 1e-300)


def transfer(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances in pixels of mapped places from their matches."""
    p = np.column_stack((a, np.ones(len(a)))) @ h.T
    z = np.where(np.abs(p[:, 2:]) < 1e-12, 1e-12, p[:, 2:])
    return np.linalg.norm(p[:, :2] / z - b, axis=1)


def planar_share(matches: DataFrame, threshold: float = 4.0, rounds: int = 300) -> DataFrame:
    """(id_a, id_b, n, planar, spread): how many matches of a pair one plane map carries, and how they lie.

    A pair whose matches nearly all follow a plane map says little of its fundamental matrix. spread: cells of
    an 8 x 8 grid over the matches' box that hold one, of 64. Draws are seeded by the pair; fewer than 4 give 0.
    """
    kinds = dict(matches.dtypes)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        pdf = pdf.sort_values(["xa", "ya", "xb", "yb"], kind="stable")
        a, b = pdf[["xa", "ya"]].to_numpy(float), pdf[["xb", "yb"]].to_numpy(float)
        most = 0
        if len(a) >= 4:
            rng = np.random.default_rng([zlib.crc32(str(k).encode()) for k in key])
            for _ in range(rounds):
                pick = rng.choice(len(a), 4, replace=False)
                ok = transfer(homography(a[pick], b[pick]), a, b) < threshold
                if ok.sum() >= 4 and ok.sum() > most:
                    most = max(int(ok.sum()), int((transfer(homography(a[ok], b[ok]), a, b) < threshold).sum()))
        size = np.maximum(np.ptp(a, axis=0), 1e-9)
        cells = np.minimum(((a - a.min(axis=0)) / size * 8).astype(int), 7)
        return pd.DataFrame({"id_a": [key[0]], "id_b": [key[1]], "n": [len(a)], "planar": [most], "spread": [len(np.unique(cells, axis=0)) / 64]})

    return matches.select("id_a", "id_b", "xa", "ya", "xb", "yb").groupBy("id_a", "id_b").applyInPandas(solve, f"id_a {kinds['id_a']}, id_b {kinds['id_b']}, n long, planar long, spread double")


def window_sum(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1, zeros outside."""
    p = np.pad(a, r + 1)[:, :]
    c = p.cumsum(axis=0).cumsum(axis=1)
    n = 2 * r + 1
    return (c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n])[: a.shape[0], : a.shape[1]]


def sweep(ref: np.ndarray, k: np.ndarray, others: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], depths: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(depth, cost) of a photograph by a plane sweep: at each depth the others are seen through the plane parallel
    to the picture, and the cost is 1 less their normalised correlation, the mean of the better half.

    others: picture, intrinsics, and rotation and shift from the reference's frame. Cost 2 where nothing is seen.
    """
    h, w = ref.shape
    v, u = np.mgrid[:h, :w]
    rays = np.linalg.inv(k) @ np.stack((u.ravel(), v.ravel(), np.ones(h * w)))
    count = window_sum(np.ones((h, w)), radius)
    mean = window_sum(ref, radius) / count
    spread = window_sum(ref * ref, radius) / count - mean**2
    best, depth = np.full((h, w), 2.0), np.zeros((h, w))
    for d in depths:
        costs = []
        for picture, ks, r, t in others:
            p = ks @ (r @ (rays * d) + t[:, None])
            ok = p[2] > 1e-9
            z = np.where(ok, p[2], 1.0)
            x, y = (p[0] / z).reshape(h, w), (p[1] / z).reshape(h, w)
            inside = ok.reshape(h, w) & (x >= 0) & (y >= 0) & (x <= picture.shape[1] - 1) & (y <= picture.shape[0] - 1)
            x0, y0 = np.clip(x.astype(int), 0, picture.shape[1] - 2), np.clip(y.astype(int), 0, picture.shape[0] - 2)
            ax, ay = np.clip(x - x0, 0, 1), np.clip(y - y0, 0, 1)
            seen = (1 - ay) * ((1 - ax) * picture[y0, x0] + ax * picture[y0, x0 + 1]) + ay * ((1 - ax) * picture[y0 + 1, x0] + ax * picture[y0 + 1, x0 + 1])
            m = window_sum(seen, radius) / count
            s = window_sum(seen * seen, radius) / count - m**2
            both = window_sum(ref * seen, radius) / count - mean * m
            cost = 1 - both / np.sqrt(np.maximum(spread * s, 1e-12))
            costs.append(np.where(inside & (spread > 1e-6) & (s > 1e-6), cost, 2.0))
        ranked = np.sort(np.stack(costs), axis=0)[: max(1, (len(costs) + 1) // 2)].mean(axis=0)
        depth, best = np.where(ranked < best, d, depth), np.minimum(best, ranked)
    return depth, best


def depth_maps(pictures: DataFrame, pairs: DataFrame, planes: int = 64, radius: int = 3, most: int = 16) -> DataFrame:
    """(image_id, width, height, depth, cost): maps as little-endian float32, by a plane sweep even in inverse depth.

    pictures: image_id, width, height, grey (bytes of float32), r0..r8, t0..t2, fx, fy, cx, cy, near, far;
    pairs: image_id, source, rank: at most `most` sources of each photograph are used, the first by rank.
    """
    own = pairs.where(F.col("rank") <= most).select("image_id", F.col("source").alias("seen")).distinct()
    need = own.unionByName(own.select("image_id", F.col("image_id").alias("seen")).distinct())
    rows = need.join(pictures.withColumnRenamed("image_id", "seen"), "seen")
    kind = dict(rows.dtypes)["image_id"]

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        def parts(r):
            k = np.array([[r["fx"], 0, r["cx"]], [0, r["fy"], r["cy"]], [0, 0, 1]], dtype=float)
            grey = np.frombuffer(r["grey"], dtype="<f4").reshape(int(r["height"]), int(r["width"])).astype(float)
            return grey, k, np.array([r[c] for c in POSE[:9]], dtype=float).reshape(3, 3), np.array([r[c] for c in POSE[9:]], dtype=float)

        records = pdf.sort_values("seen").to_dict("records")
        ref = next((r for r in records if r["seen"] == key[0]), None)
        if ref is None or len(records) < 2:
            return pd.DataFrame({c: [] for c in ("image_id", "width", "height", "depth", "cost")})
        grey, k, r0, t0 = parts(ref)
        others = []
        for r in records:
            if r["seen"] != key[0]:
                picture, ks, r1, t1 = parts(r)
                others.append((picture, ks, r1 @ r0.T, t1 - r1 @ r0.T @ t0))
        depths = 1 / np.linspace(1 / ref["near"], 1 / ref["far"], planes)
        depth, cost = sweep(grey, k, others, depths, radius)
        return pd.DataFrame({"image_id": [key[0]], "width": [ref["width"]], "height": [ref["height"]], "depth": [depth.astype("<f4").tobytes()], "cost": [cost.astype("<f4").tobytes()]})

    return rows.groupBy("image_id").applyInPandas(solve, f"image_id {kind}, width long, height long, depth binary, cost binary")


def delaunay(p: np.ndarray) -> np.ndarray:
    """Triangles (rows of three positions) of points in the plane, none in another's circle; repeated points are left out."""
    _, first = np.unique(p, axis=0, return_index=True)
    order = np.sort(first)
    low, size = p.min(axis=0), max(float(np.ptp(p, axis=0).max()), 1e-9)
    q = np.concatenate(((p - low) / size, [[-40.0, -40.0], [40.0, -40.0], [0.5, 60.0]]))
    tri, n = np.array([[len(p), len(p) + 1, len(p) + 2]]), len(p)

    def circle(t):
        a, b, c = q[t[:, 0]], q[t[:, 1]], q[t[:, 2]]
        u, v = b - a, c - a
        d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
        d = np.where(np.abs(d) < 1e-300, 1e-300, d)
        uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
        o = np.stack(((v[:, 1] * uu - u[:, 1] * vv) / d, (u[:, 0] * vv - v[:, 0] * uu) / d), axis=1)
        return a + o, (o * o).sum(axis=1)

    centre, radius = circle(tri)
    for k in order.tolist():
        hit = ((q[k] - centre) ** 2).sum(axis=1) < radius * (1 + 1e-12)
        if not hit.any():
            continue
        old = tri[hit]
        edges = np.sort(np.concatenate((old[:, [0, 1]], old[:, [1, 2]], old[:, [2, 0]])), axis=1)
        rim, times = np.unique(edges, axis=0, return_counts=True)
        rim = rim[times == 1]
        new = np.column_stack((rim, np.full(len(rim), k)))
        c, r = circle(new)
        tri, centre, radius = np.concatenate((tri[~hit], new)), np.concatenate((centre[~hit], c)), np.concatenate((radius[~hit], r))
    return tri[(tri < n).all(axis=1)]


def planar_prior(depth: np.ndarray, cost: np.ndarray, k: np.ndarray, grid: int = 5, max_cost: float = 0.1, least_cosine: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(depth, normal) of a plane for each triangle of credible pixels, 0 where there is none.

    Support is the pixel of the lowest cost below max_cost in each square of `grid` pixels. A pixel whose ray
    meets its plane at a cosine below least_cosine, or behind the camera, has no prior. Normals face the camera.
    """
    h, w = depth.shape
    v, u = np.nonzero((depth > 0) & (cost < max_cost))
    square = (v // grid) * w + u // grid
    order = np.lexsort((v * w + u, cost[v, u], square))
    first = order[np.flatnonzero(np.append(True, np.diff(square[order]) > 0))] if len(order) else order
    u, v = u[first], v[first]
    prior, normal = np.zeros((h, w)), np.zeros((h, w, 3))
    if len(u) < 3:
        return prior, normal
    x = np.stack(((u - k[0, 2]) / k[0, 0], (v - k[1, 2]) / k[1, 1], np.ones(len(u))), axis=1) * depth[v, u][:, None]
    for a, b, c in delaunay(np.stack((u, v), axis=1).astype(float)):
        n = np.cross(x[b] - x[a], x[c] - x[a])
        size = np.linalg.norm(n)
        det = (u[b] - u[a]) * (v[c] - v[a]) - (u[c] - u[a]) * (v[b] - v[a])
        if size < 1e-12 or det == 0:
            continue
        n = n / size * (-1 if n[2] > 0 else 1)
        py, px = np.mgrid[min(v[a], v[b], v[c]) : max(v[a], v[b], v[c]) + 1, min(u[a], u[b], u[c]) : max(u[a], u[b], u[c]) + 1]
        l1 = ((px - u[a]) * (v[c] - v[a]) - (u[c] - u[a]) * (py - v[a])) / det
        l2 = ((u[b] - u[a]) * (py - v[a]) - (px - u[a]) * (v[b] - v[a])) / det
        ray = np.stack(((px - k[0, 2]) / k[0, 0], (py - k[1, 2]) / k[1, 1], np.ones(px.shape)), axis=-1)
        along = ray @ n
        ok = (l1 >= -1e-9) & (l2 >= -1e-9) & (l1 + l2 <= 1 + 1e-9) & (np.abs(along) / np.linalg.norm(ray, axis=-1) >= least_cosine)
        d = np.where(ok, (n @ x[a]) / np.where(along == 0, 1, along), 0)
        ok &= d > 0
        prior[py[ok], px[ok]], normal[py[ok], px[ok]] = d[ok], n
    return prior, normal


def planar_priors(maps: DataFrame, grid: int = 5, max_cost: float = 0.1) -> DataFrame:
    """(image_id, depth, normal): priors of depth maps (image_id, width, height, depth, cost as float32 bytes, fx, fy, cx, cy)."""
    kind = dict(maps.dtypes)["image_id"]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                shape = int(r["height"]), int(r["width"])
                depth, cost = (np.frombuffer(r[c], dtype="<f4").reshape(shape).astype(float) for c in ("depth", "cost"))
                k = np.array([[r["fx"], 0, r["cx"]], [0, r["fy"], r["cy"]], [0, 0, 1]], dtype=float)
                d, n = planar_prior(depth, cost, k, grid, max_cost)
                out.append((r["image_id"], d.astype("<f4").tobytes(), n.astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "depth", "normal"])

    return maps.select("image_id", "width", "height", "depth", "cost", *LENS).mapInPandas(run, f"image_id {kind}, depth binary, normal binary")


def halve(a: np.ndarray) -> np.ndarray:
    """Smoothed by 1 4 6 4 1 and taken at every second place; edges repeat."""
    kernel = np.array([1, 4, 6, 4, 1]) / 16
    for axis in (0, 1):
        pad = [(2, 2) if i == axis else (0, 0) for i in range(a.ndim)]
        p = np.pad(a, pad, mode="edge")
        n = a.shape[axis]
        a = sum(w * np.take(p, np.arange(i, i + n), axis=axis) for i, w in enumerate(kernel))
    return a[::2, ::2]


def double(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Twice as large, bilinear, cut to a shape."""
    for axis, n in enumerate(shape):
        at = np.arange(n) / 2
        low = np.minimum(at.astype(int), a.shape[axis] - 1)
        high = np.minimum(low + 1, a.shape[axis] - 1)
        w = (at - low).reshape([-1 if i == axis else 1 for i in range(a.ndim)])
        a = np.take(a, low, axis=axis) * (1 - w) + np.take(a, high, axis=axis) * w
    return a


def blend(pictures: list[np.ndarray], weights: list[np.ndarray], levels: int = 5) -> np.ndarray:
    """Pictures (h, w, c) joined band by band: each band of the Laplacian pyramid by weights smoothed to its scale.

    Where no weight is, the result is 0.
    """
    levels = max(1, min(levels, int(np.log2(max(2, min(pictures[0].shape[:2]))))))
    sums, totals = [None] * levels, [None] * levels
    for picture, weight in zip(pictures, weights, strict=True):
        g, w = picture.astype(float), weight.astype(float)
        for k in range(levels):
            small = halve(g) if k < levels - 1 else None
            band = g - double(small, g.shape[:2]) if small is not None else g
            sums[k] = band * w[..., None] + (0 if sums[k] is None else sums[k])
            totals[k] = w + (0 if totals[k] is None else totals[k])
            g, w = (small, halve(w)) if small is not None else (g, w)
    out = None
    for s, t in zip(reversed(sums), reversed(totals), strict=True):
        band = np.where(t[..., None] > 1e-9, s / np.maximum(t[..., None], 1e-9), 0)
        out = band if out is None else double(out, band.shape[:2]) + band
    seen = sum(w > 0 for w in weights) > 0
    return np.where(seen[..., None], out, 0)


def blend_tiles(layers: DataFrame, levels: int = 5) -> DataFrame:
    """(tile, width, height, rgb): tiles joined from their layers (tile, image_id, width, height, rgb, weight).

    rgb: bytes; weight: float32 bytes. A tile brings its halo along; it is one group of a bounded size.
    """
    kind = dict(layers.dtypes)["tile"]

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("image_id")
        w, h = int(pdf["width"].iloc[0]), int(pdf["height"].iloc[0])
        pictures = [np.frombuffer(x, dtype=np.uint8).reshape(h, w, 3) for x in pdf["rgb"]]
        weights = [np.frombuffer(x, dtype="<f4").reshape(h, w) for x in pdf["weight"]]
        out = np.clip(np.floor(blend(pictures, weights, levels) + 0.5), 0, 255).astype(np.uint8)
        return pd.DataFrame({"tile": [key[0]], "width": [w], "height": [h], "rgb": [out.tobytes()]})

    return layers.select("tile", "image_id", "width", "height", "rgb", "weight").groupBy("tile").applyInPandas(join, f"tile {kind}, width long, height long, rgb binary")


def decimate(vertices: DataFrame, triangles: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """A mesh of at most one vertex a cell: the mean of its vertices; triangles of three cells stay, once.

    A cluster's vid is its smallest one; of triangles over the same three clusters the smallest tid stays.
    """
    at = [F.floor(F.col(c) / cell).cast("bigint").alias(f"i{c}") for c in "xyz"]
    placed = vertices.select("vid", "x", "y", "z", *at)
    merged = placed.groupBy("ix", "iy", "iz").agg(F.min("vid").alias("to"), *[F.avg(c).alias(c) for c in "xyz"])
    names = placed.select("vid", "ix", "iy", "iz").join(merged.select("ix", "iy", "iz", "to"), ["ix", "iy", "iz"]).select("vid", "to")
    t = triangles.select("tid", "v0", "v1", "v2")
    for k in range(3):
        t = t.join(names.select(F.col("vid").alias(f"v{k}"), F.col("to").alias(f"n{k}")), f"v{k}")
    kept = t.where("n0 <> n1 and n1 <> n2 and n2 <> n0").withColumn("key", F.sort_array(F.array("n0", "n1", "n2")))
    once = kept.groupBy("key").agg(F.min(F.struct("tid", "n0", "n1", "n2")).alias("m")).select("m.tid", F.col("m.n0").alias("v0"), F.col("m.n1").alias("v1"), F.col("m.n2").alias("v2"))
    return merged.select(F.col("to").alias("vid"), "x", "y", "z"), once


def face_views(vertices: DataFrame, triangles: DataFrame, photos: DataFrame, least_cosine: float = 0.1) -> DataFrame:
    """(tid, image_id, area): the photograph that shows each triangle largest, from the front and whole in its frame.

    photos: of surface.PHOTO. Area in pixels; ties go to the smaller id; a triangle nobody sees is absent.
    """
    from terrafold.functions import geom
    from terrafold.operators.surface import PHOTO

    t = triangles.select("tid", "v0", "v1", "v2")
    for k in range(3):
        t = t.join(vertices.select(F.col("vid").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]), f"v{k}")
    a, b, c = (tuple(F.col(f"{d}{k}") for d in "xyz") for k in range(3))
    e, f = (tuple(p - q for p, q in zip(v, a, strict=True)) for v in (b, c))
    n = (e[1] * f[2] - e[2] * f[1], e[2] * f[0] - e[0] * f[2], e[0] * f[1] - e[1] * f[0])
    block = 256
    size = lambda v: F.floor(v / block).cast("bigint")
    spread = lambda p, q: F.explode(F.sequence(size(F.col(p)), size(F.col(q))))
    middle = [(F.col(f"{d}0") + F.col(f"{d}1") + F.col(f"{d}2")) / 3 for d in "xyz"]
    t = t.withColumns({"nx": n[0], "ny": n[1], "nz": n[2], "mx": middle[0], "my": middle[1], "mz": middle[2]})
    dealt = photos.select(*PHOTO).withColumnRenamed("x0", "bx0").withColumnRenamed("y0", "by0").withColumnRenamed("x1", "bx1").withColumnRenamed("y1", "by1")
    dealt = dealt.withColumn("bx", spread("bx0", "bx1")).withColumn("by", spread("by0", "by1"))
    met = t.withColumn("bx", size(F.col("mx"))).withColumn("by", size(F.col("my"))).join(dealt, ["bx", "by"])
    r, s, k = [F.col(f"r{i}") for i in range(9)], tuple(F.col(f"t{i}") for i in range(3)), tuple(F.col(x) for x in LENS)
    places = [geom.project(r, s, k, v) for v in (a, b, c)]
    centre = geom.camera_centre(r, s)
    ray = [c - F.col(m) for c, m in zip(centre, ("mx", "my", "mz"), strict=True)]
    dot = sum((p * F.col(q) for p, q in zip(ray, ("nx", "ny", "nz"), strict=True)), F.lit(0.0))
    length = lambda v: F.sqrt(sum((x * x for x in v), F.lit(0.0)))
    cosine = dot / (length(ray) * length([F.col(q) for q in ("nx", "ny", "nz")]))
    (u0, v0, _), (u1, v1, _), (u2, v2, _) = places
    area = F.abs((u1 - u0) * (v2 - v0) - (u2 - u0) * (v1 - v0)) / 2
    whole = F.lit(True)
    for u, v, _ in places:
        whole = whole & u.between(0, F.col("width") - 1) & v.between(0, F.col("height") - 1)
    seen = met.withColumns({"area": area, "ok": whole & (cosine >= least_cosine)}).where("ok and area > 0")
    best = F.max(F.struct("area", (-F.col("image_id")).alias("n"))).alias("m")
    return seen.groupBy("tid").agg(best).select("tid", (-F.col("m.n")).alias("image_id"), F.col("m.area").alias("area"))


def bilinear(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at places of a picture, clamped to it."""
    x0, y0 = np.clip(np.floor(x).astype(int), 0, a.shape[1] - 2), np.clip(np.floor(y).astype(int), 0, a.shape[0] - 2)
    ax, ay = np.clip(x - x0, 0, 1), np.clip(y - y0, 0, 1)
    return (1 - ay) * ((1 - ax) * a[y0, x0] + ax * a[y0, x0 + 1]) + ay * ((1 - ax) * a[y0 + 1, x0] + ax * a[y0 + 1, x0 + 1])


def smoothed(a: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur; edges repeat."""
    r = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(2)], mode="edge")
        a = sum(w * np.take(p, np.arange(k, k + a.shape[axis]), axis=axis) for k, w in enumerate(kernel))
    return a


def checker_corner(grey: np.ndarray, guess: tuple[float, float], sigma: float = 1.5, radius: float = 30, reach: float = 8) -> tuple[float, float, float] | None:
    """(x, y, contrast) of a black-and-white target's centre near a guess, or None.

    The centre is a saddle of brightness: of the eight strongest ones within `radius` (none under a fifth of
    the strongest) the first counts whose quarter circles look like a target, opposite ones alike and
    neighbours apart. It is then moved to where the gradients around it are square to the way to it.
    """
    if min(grey.shape) < 7:
        return None
    s = smoothed(grey.astype(float), sigma)
    xx, yy, xy = np.zeros_like(s), np.zeros_like(s), np.zeros_like(s)
    xx[:, 1:-1], yy[1:-1] = s[:, 2:] - 2 * s[:, 1:-1] + s[:, :-2], s[2:] - 2 * s[1:-1] + s[:-2]
    xy[1:-1, 1:-1] = (s[2:, 2:] + s[:-2, :-2] - s[2:, :-2] - s[:-2, 2:]) / 4
    saddle = np.maximum(0, xy * xy - xx * yy)
    saddle[[0, -1]], saddle[:, [0, -1]] = 0, 0
    p = np.pad(saddle, 2)
    highest = np.max([p[i : i + s.shape[0], j : j + s.shape[1]] for i in range(5) for j in range(5)], axis=0)
    y, x = np.mgrid[: s.shape[0], : s.shape[1]]
    inside = (x >= 2) & (y >= 2) & (x < s.shape[1] - 2) & (y < s.shape[0] - 2)
    y, x = np.nonzero((saddle > 0) & (saddle == highest) & inside & (np.hypot(x - guess[0], y - guess[1]) <= radius))
    if not len(x):
        return None
    strength = saddle[y, x]
    angle = 2 * np.pi * np.arange(32) / 32
    for k in np.lexsort((x, y, -strength))[:8]:
        if strength[k] < 0.2 * strength.max():
            break
        far = np.array([1, 2, 3])[:, None] * reach / 3
        ray = bilinear(s, x[k] + far * np.cos(angle), y[k] + far * np.sin(angle)).mean(axis=0)
        quarters = np.array([np.roll(ray, -o).reshape(4, 8).mean(axis=1) for o in range(8)])
        contrast = np.abs(quarters[:, 0] + quarters[:, 2] - quarters[:, 1] - quarters[:, 3]) / 510
        best = int(contrast.argmax())
        q = quarters[best]
        if contrast[best] <= 0.12 or max(abs(q[0] - q[2]), abs(q[1] - q[3])) / 255 >= 0.6 * contrast[best]:
            continue
        half = max(3, round(reach / 2))
        dy, dx = np.mgrid[-half : half + 1, -half : half + 1]
        weight = np.exp(-(dx**2 + dy**2) / (2 * (half / 2) ** 2))
        at = np.array([x[k], y[k]], dtype=float)
        for _ in range(20):
            px, py = at[0] + dx, at[1] + dy
            gx, gy = (bilinear(s, px + 1, py) - bilinear(s, px - 1, py)) / 2, (bilinear(s, px, py + 1) - bilinear(s, px, py - 1)) / 2
            m = np.array([[(weight * gx * gx).sum(), (weight * gx * gy).sum()], [(weight * gx * gy).sum(), (weight * gy * gy).sum()]])
            if abs(np.linalg.det(m)) <= 1e-9:
                break
            new = np.linalg.solve(m, [(weight * gx * (gx * px + gy * py)).sum(), (weight * gy * (gx * px + gy * py)).sum()])
            moved, at = np.hypot(*(new - at)), new
            if moved < 1e-3:
                break
        if np.hypot(at[0] - x[k], at[1] - y[k]) <= 3:
            return float(at[0]), float(at[1]), float(contrast[best])
    return None


def find_targets(chips: DataFrame, radius: float = 30, reach: float = 8) -> DataFrame:
    """(image_id, name, u, v, contrast): targets found in windows of photographs; windows without one are absent.

    chips: image_id, name, x0, y0 (the window's place), width, height, grey (bytes), gu, gv (where it is expected).
    """
    kinds = dict(chips.dtypes)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                grey = np.frombuffer(r["grey"], dtype=np.uint8).reshape(int(r["height"]), int(r["width"]))
                found = checker_corner(grey, (r["gu"] - r["x0"], r["gv"] - r["y0"]), radius=radius, reach=reach)
                if found:
                    out.append((r["image_id"], r["name"], found[0] + r["x0"], found[1] + r["y0"], found[2]))
            yield pd.DataFrame(out, columns=["image_id", "name", "u", "v", "contrast"])

    columns = ["image_id", "name", "x0", "y0", "width", "height", "grey", "gu", "gv"]
    return chips.select(*columns).mapInPandas(run, f"image_id {kinds['image_id']}, name {kinds['name']}, u double, v double, contrast double")
