"""NumPy kernels for what SQL cannot express: smoothing, peaks, geometry. They run per episode in applyInPandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian_smooth(values: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Gaussian filter with a reflected border; the kernel reaches truncate * sigma."""
    n = len(values)
    if not n:
        return np.zeros(0)
    radius = int(truncate * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    at = np.arange(-radius, n + radius) % (2 * n)
    return np.convolve(np.asarray(values, float)[np.where(at < n, at, 2 * n - 1 - at)], kernel / kernel.sum(), "valid")


def savitzky_golay(values: np.ndarray, window: int, order: int) -> np.ndarray:
    """Least-squares polynomial smoothing; the border repeats its nearest value."""
    half = window // 2
    design = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    weights = np.linalg.pinv(design)[0]
    return np.convolve(np.pad(np.asarray(values, float), half, "edge"), weights[::-1], "valid")


def banded_solve(diagonals: list[np.ndarray], right: np.ndarray) -> np.ndarray:
    """Solves symmetric positive definite systems of the main diagonal and the ones above it, in time by their length.

    Diagonals are length x systems; all systems go through one sweep together.
    """
    n, w = len(right), len(diagonals)
    low = [np.zeros(diagonals[0].shape) for _ in range(w)]  # rows of L D L': low[k][i] is L[i + k, i], low[0] is D
    for i in range(n):
        low[0][i] = diagonals[0][i] - sum(low[k][i - k] ** 2 * low[0][i - k] for k in range(1, min(w, i + 1)))
        for k in range(1, min(w, n - i)):
            low[k][i] = (diagonals[k][i] - sum(low[m][i - m] * low[m + k][i - m] * low[0][i - m] for m in range(1, min(w - k, i + 1)))) / low[0][i]
    x = np.repeat(np.asarray(right, float)[:, None], diagonals[0].shape[1], axis=1)
    for i in range(n):
        x[i] -= sum(low[k][i - k] * x[i - k] for k in range(1, min(w, i + 1)))
    x /= low[0]
    for i in range(n - 1, -1, -1):
        x[i] -= sum(low[k][i] * x[i + k] for k in range(1, min(w, n - i)))
    return x


def smoothing_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, residual: float = 0.0, dense: int = 400) -> np.ndarray:
    """Natural cubic spline of least curvature whose squared residuals sum to `residual` at most; with 0 it goes through (x, y).

    The penalty is found by refining a grid. Up to `dense` points one eigendecomposition gives the residuals of all
    penalties; beyond, each step is 64 penalties in one sweep of a banded system, so time and memory follow the points.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h = np.diff(x)
    a, c = 1 / h[:-1], 1 / h[1:]
    second = np.diff(np.diff(y) / h)
    # second differences: rows (a, -a - c, c) over the points
    r = [(h[:-1] + h[1:]) / 3, np.append(h[1:-1] / 6, 0.0), np.zeros(n - 2)]
    q = [a**2 + (a + c) ** 2 + c**2, np.append(-(a[:-1] + c[:-1]) * a[1:] - c[:-1] * (a[1:] + c[1:]), 0.0), np.append(c[:-2] * a[2:], [0.0, 0.0])[: n - 2]]

    def fit(penalties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """points x penalties: what leaves the points, and the second derivatives inside."""
        bend = banded_solve([u[:, None] + v[:, None] * penalties for u, v in zip(r, q, strict=True)], second)
        off = np.zeros((n, len(penalties)))
        off[:-2] += a[:, None] * bend
        off[1:-1] -= (a + c)[:, None] * bend
        off[2:] += c[:, None] * bend
        return penalties * off, bend

    def residuals(penalties: np.ndarray) -> np.ndarray:
        return (fit(penalties)[0] ** 2).sum(axis=0)

    if residual > 0 and n <= dense:
        full = lambda d: np.diag(d[0]) + sum(np.diag(v[: len(v) - k], k) + np.diag(v[: len(v) - k], -k) for k, v in enumerate(d[1:], 1) if len(v) > k)
        inverse = np.linalg.inv(np.linalg.cholesky(full(r)))
        stretch, axes = np.linalg.eigh(inverse @ full(q) @ inverse.T)
        weight = np.maximum(stretch, 0) * (axes.T @ (inverse @ second)) ** 2

        def residuals(penalties: np.ndarray) -> np.ndarray:
            return penalties**2 * (weight[:, None] / (1 + stretch[:, None] * penalties) ** 2).sum(axis=0)

    best = 0.0
    if residual > 0:
        tried = np.append(0.0, np.logspace(-12, 12, 63))
        for _ in range(4):  # residuals grow with the penalty
            fine = np.flatnonzero(residuals(tried) <= residual)
            k = int(fine[-1]) if len(fine) else 0
            best = tried[k]
            if k + 1 == len(tried):
                break
            tried = np.linspace(best, tried[k + 1], 64)
    off, bend = (m[:, 0] for m in fit(np.array([best])))
    f = y - off
    m = np.concatenate([[0.0], bend, [0.0]])
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    u, v = (x[i + 1] - at) / h[i], (at - x[i]) / h[i]
    return u * f[i] + v * f[i + 1] + ((u**3 - u) * m[i] + (v**3 - v) * m[i + 1]) * h[i] ** 2 / 6


def peaks(values: np.ndarray, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Local maxima (the middle of a plateau), the higher first within `distance`, of at least `prominence`."""
    v = np.asarray(values, float)
    found, i = [], 1
    while i < len(v) - 1:
        j = i
        while j < len(v) - 1 and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j < len(v) - 1 and v[j + 1] < v[i]:
            found.append((i + j) // 2)
        i = j + 1
    at = np.array(found, int)
    if distance > 1 and len(at):
        keep = np.ones(len(at), bool)
        for k in np.argsort(v[at], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(at - at[k]) < distance
                near[k] = False
                keep[near] = False
        at = at[keep]
    if prominence > 0:
        rise = []
        for p in at:
            left = np.flatnonzero(v[:p] > v[p])
            right = np.flatnonzero(v[p + 1 :] > v[p])
            low = v[left[-1] if len(left) else 0 : p + 1].min(), v[p : p + 1 + right[0] if len(right) else len(v)].min()
            rise.append(v[p] - max(low))
        at = at[np.array(rise) >= prominence] if len(at) else at
    return at


def local_minima(frames: np.ndarray, speeds: np.ndarray, kind: str = "short") -> list[tuple[int, float]]:
    """Frames of smoothed local minima with their speeds, slowest first. kind: short, long, or long_vda (outliers cut by quartiles)."""
    f, s = np.asarray(frames), np.asarray(speeds, float)
    ok = np.isfinite(s) & (s > 0)
    if kind == "short":
        ok &= s < 30
    if kind == "long_vda" and ok.sum() >= 4:
        q1, q3, top = np.percentile(s[ok], [25, 75, 95])
        ok &= s < max(q3 + 2 * (q3 - q1), top)
    f, s = f[ok], s[ok]
    n = len(s)
    if n < 4:
        return []
    if kind == "short":
        window, order, distance, prominence = min(7, n), 2, 1, 0.0
    else:
        window, order, distance, prominence = max(8, n // 7), max(2, n // 13), max(3 % n, 2), 0.3 * s.mean()
    window = max(3, window - (window % 2 == 0))
    if window >= n:
        window = max(3, n - 1 if n % 2 == 0 else n)
    smooth = savitzky_golay(s, window, min(order, window - 1, 8))
    grid = np.linspace(f.min(), f.max(), 300)
    at = peaks(-smoothing_spline(f.astype(float), smooth, grid, 1e-4 if kind == "short" else 1e-3 * s.mean()), distance, prominence)
    near = {int(f[np.abs(f - x).argmin()]) for x in np.rint(grid[at])}
    pairs = sorted(((x, float(s[f == x][0])) for x in near), key=lambda p: (p[1], p[0]))
    if kind == "short":
        return pairs
    kept: list[tuple[int, float]] = []
    for p in pairs:
        if all(abs(p[0] - k[0]) >= distance for k in kept):
            kept.append(p)
    return kept


def active_span(speeds: np.ndarray, active: float = 30.0, sigma: float = 5.0) -> tuple[int, int]:
    """First frame in the top `active` percent of smoothed speed, and the last one plus 1; (-1, -1) if all is still."""
    smooth = gaussian_smooth(speeds, sigma)
    if not len(smooth) or np.allclose(smooth, 0):
        return -1, -1
    on = np.flatnonzero(smooth >= np.percentile(smooth, 100 - active))
    return int(on[0]), int(on[-1]) + 1


def clip_and_smooth(speeds: np.ndarray, top: float = 150.0, sigma: float = 2.0) -> np.ndarray:
    """Speeds cut at `top`; the non-zero ones, if more than 3, smoothed as one sequence."""
    out = np.minimum(np.asarray(speeds, float), top)
    on = out != 0
    if on.sum() > 3:
        out[on] = gaussian_smooth(out[on], sigma)
    return out


class Cells:
    """Points of space by cubes of side `reach`: what is within reach of a place is in its cube or one of the 26 around."""

    def __init__(self, points: np.ndarray, reach: float):
        self.points, self.reach = points, reach
        self.low = np.floor(points.min(0) / reach).astype(np.int64) - 1
        self.shape = np.floor(points.max(0) / reach).astype(np.int64) - self.low + 2
        key = self.key(np.floor(points / reach).astype(np.int64))
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def key(self, cube: np.ndarray) -> np.ndarray:
        at = cube - self.low
        inside = ((at >= 0) & (at < self.shape)).all(1)
        return np.where(inside, (at[:, 0] * self.shape[1] + at[:, 1]) * self.shape[2] + at[:, 2], -1)

    def nearest(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest point within reach of each place (-1: none) and its squared distance."""
        best, who = np.full(len(places), np.inf), np.full(len(places), -1)
        cube = np.floor(places / self.reach).astype(np.int64)
        for step in np.ndindex(3, 3, 3):
            key = self.key(cube + np.array(step) - 1)
            first, last = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            last = np.where(key < 0, first, last)
            for k in range(int((last - first).max(initial=0))):
                row = np.flatnonzero(first + k < last)
                point = self.order[first[row] + k]
                d = ((places[row] - self.points[point]) ** 2).sum(1)
                nearer = d < best[row]
                best[row[nearer]], who[row[nearer]] = d[nearer], point[nearer]
        who[best > self.reach**2] = -1
        return who, best


def align_points(source: np.ndarray, target: np.ndarray, reach: float = 0.03, rounds: int = 30) -> np.ndarray:
    """Point-to-point alignment from identity: the 4 x 4 rigid transform that brings source nearest to target."""
    t = np.eye(4)
    if not len(source) or not len(target):
        return t
    cells = Cells(target, reach)
    for _ in range(rounds):
        moved = source @ t[:3, :3].T + t[:3, 3]
        near, _far = cells.nearest(moved)
        ok = near >= 0
        if ok.sum() < 3:
            break
        a, b = moved[ok], target[near[ok]]
        u, _, v = np.linalg.svd((a - a.mean(0)).T @ (b - b.mean(0)))
        r = v.T @ np.diag([1, 1, np.sign(np.linalg.det(v.T @ u.T))]) @ u.T
        step = np.eye(4)
        step[:3, :3], step[:3, 3] = r, b.mean(0) - r @ a.mean(0)
        t = step @ t
        if np.abs(step - np.eye(4)).max() < 1e-9:
            break
    return t


def nearest_blobs(depth: np.ndarray, percent: float = 10.0, blobs: int = 1) -> np.ndarray:
    """Labels 1..blobs of the largest 4-connected parts nearer than a percentile of depth, largest first; 0 elsewhere."""
    mask = np.isfinite(depth) & (depth < np.nanpercentile(depth, percent)) if np.isfinite(depth).any() else np.zeros(depth.shape, bool)
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = label.copy()
        for a, b in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
            both = mask[a] & mask[b]
            new[a] = np.where(both, np.maximum(new[a], new[b]), new[a])
            new[b] = np.where(both, np.maximum(new[a], new[b]), new[b])
        if (new == label).all():
            break
        label = new
    ids, n = np.unique(label[label > 0], return_counts=True)
    out = np.zeros(depth.shape, int)
    for i, k in enumerate(ids[np.lexsort((ids, -n))][:blobs]):
        out[label == k] = i + 1
    return out


def minima_by_episode(frames: DataFrame, kind: str) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        found = local_minima(pdf["frame_idx"].to_numpy(), pdf["speed"].to_numpy(), kind)
        return pd.DataFrame({"episode": [pdf["episode"].iloc[0]] * len(found), "frame_idx": [f for f, _ in found], "speed": [s for _, s in found]})

    return frames.select("episode", "frame_idx", "speed").groupBy("episode").applyInPandas(one, "episode long, frame_idx int, speed double")


def minima_by_type(clips: DataFrame) -> DataFrame:
    """minima_by_episode with each clip's own kind, by its columns video_type and use_depth: short, long, or long_vda."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        kind = "short" if pdf["video_type"].iloc[0] == "short" else "long_vda" if pdf["use_depth"].iloc[0] else "long"
        found = local_minima(pdf["frame_idx"].to_numpy(), pdf["speed"].to_numpy(), kind)
        return pd.DataFrame({"episode": [pdf["episode"].iloc[0]] * len(found), "kind": kind, "frame_idx": [f for f, _ in found], "speed": [s for _, s in found]})

    return clips.select("episode", "frame_idx", "speed", "video_type", "use_depth").groupBy("episode").applyInPandas(one, "episode long, kind string, frame_idx int, speed double")


def smoothed_by_episode(frames: DataFrame, sigma: float, top: float | None = None) -> DataFrame:
    """frames' speed smoothed by gaussian_smooth; with `top` by clip_and_smooth."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        speed = pdf["speed"].to_numpy()
        return pdf.assign(smooth=gaussian_smooth(speed, sigma) if top is None else clip_and_smooth(speed, top, sigma))

    return frames.select("episode", "frame_idx", "speed").groupBy("episode").applyInPandas(one, "episode long, frame_idx int, speed double, smooth double")


def registered(clouds: DataFrame, wrists: DataFrame, reach: float = 0.03) -> DataFrame:
    """episode, frame_idx, p: wrist positions in the coordinates of each episode's first cloud.

    clouds(episode, frame_idx, points array<array<double>>), wrists(episode, frame_idx, p array<double>). The first
    frame passes as it is, later ones move by the alignment of their cloud; frames without points or with a wrist that
    is missing or not a number are left out. Each later cloud meets the first one alone, so an episode is never held whole.
    """
    solid = clouds.where(F.size("points") > 0)
    lead = clouds.groupBy("episode").agg(F.min("frame_idx").alias("start"))
    first = solid.join(lead, "episode").where("frame_idx = start").select("episode", F.col("points").alias("target"))
    rows = solid.join(wrists, ["episode", "frame_idx"]).where("size(p) = 3 and forall(p, x -> x is not null and not isnan(x))").join(lead, "episode").join(first, "episode", "left")
    rows = rows.where("frame_idx = start or target is not null")

    def run(batches):
        for pdf in batches:
            out = []
            for first_frame, points, target, p in zip(pdf["frame_idx"] == pdf["start"], pdf["points"], pdf["target"], pdf["p"], strict=True):
                t = np.eye(4) if first_frame else align_points(np.array([*points], float), np.array([*target], float), reach)
                out.append([float(x) for x in (t @ np.append(np.array(p, float), 1.0))[:3]])
            yield pd.DataFrame({"episode": pdf["episode"], "frame_idx": pdf["frame_idx"], "p": out})

    return rows.select("episode", "frame_idx", "start", "points", "target", "p").mapInPandas(run, "episode long, frame_idx int, p array<double>")


def blobs_by_tensor(tensors: DataFrame, width: int, percent: float = 10.0, blobs: int = 1) -> DataFrame:
    """vec_id, blob, size, row and col (means) of the nearest blobs of tensors(vec_id, inv): depths row by row, `width` a row."""

    def run(batches):
        for pdf in batches:
            out = []
            for key, values in zip(pdf["vec_id"], pdf["inv"], strict=True):
                depth = np.array(values, float)[: len(values) // width * width].reshape(-1, width)
                label = nearest_blobs(depth, percent, blobs)
                for b in range(1, label.max(initial=0) + 1):
                    at = np.argwhere(label == b)
                    out.append((key, b, len(at), *at.mean(0)))
            yield pd.DataFrame(out, columns=["vec_id", "blob", "size", "row", "col"])

    return tensors.select("vec_id", "inv").mapInPandas(run, "vec_id long, blob int, size int, row double, col double")


def spans_by_episode(frames: DataFrame) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, z = active_span(pdf.sort_values("frame_idx")["speed"].to_numpy())
        return pd.DataFrame({"episode": [pdf["episode"].iloc[0]], "contact": [a], "separation": [z]})

    return frames.select("episode", "frame_idx", "speed").groupBy("episode").applyInPandas(one, "episode long, contact int, separation int")
