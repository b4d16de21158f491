"""Camera calibrations: homographies from pairs of points by consensus, their error, and world positions of detections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions.geometry import Box, ground_point, projected
from frameloom.operators.zones import classify

LEAST_POINTS = 4


def _centred(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points about their middle at a mean distance of the root of two, and the matrix that moves them there."""
    middle = p.mean(axis=0)
    scale = np.sqrt(2) / max(np.hypot(*(p - middle).T).mean(), 1e-12)
    return (p - middle) * scale, np.array([[scale, 0, -scale * middle[0]], [0, scale, -scale * middle[1]], [0, 0, 1]])


def homography(image: np.ndarray, world: np.ndarray) -> np.ndarray | None:
    """The direct linear transform of four or more pairs of points, of least squares; None where they are degenerate."""
    (a, left), (b, right) = _centred(image), _centred(world)
    one, zero = np.ones(len(a)), np.zeros((len(a), 3))
    row = np.column_stack([a, one])
    rows = np.vstack([np.hstack([row, zero, -b[:, :1] * row]), np.hstack([zero, row, -b[:, 1:] * row])])
    # as many right vectors as unknowns, and no left ones of a place for each pair by each pair
    _, values, v = np.linalg.svd(rows, full_matrices=len(rows) < 9)
    if values[7] < 1e-9 * values[0]:
        return None
    m = np.linalg.inv(right) @ v[-1].reshape(3, 3) @ left
    return None if abs(m[2, 2]) < 1e-12 else m / m[2, 2]


NAMES = ("image_x", "image_y", "world_x", "world_y")
#: Sets of four pairs that are tried for a camera, and how many of them a row of work has.
TRIES, AT_ONCE = 512, 64


def scores(m: np.ndarray, p: np.ndarray, most_error: float, cells: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """For each of many matrices the sum of the squared distances, none counting more than most_error, and how many pairs
    are within it; so many distances are held at a time."""
    sums, near = np.zeros(len(m)), np.zeros(len(m), np.int64)
    step = max(1, cells // len(m))
    for a in range(0, len(p), step):
        off = distances(m, p[a : a + step])
        sums += (np.minimum(off, most_error) ** 2).sum(axis=1)
        near += (off <= most_error).sum(axis=1)
    return sums, near


def distances(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How far each pair's projection is from where it belongs, for one matrix or many."""
    q = np.column_stack([p[:, :2], np.ones(len(p))]) @ np.swapaxes(m, -1, -2)
    with np.errstate(all="ignore"):
        off = np.hypot(q[..., 0] / q[..., 2] - p[:, 2], q[..., 1] / q[..., 2] - p[:, 3])
    return np.where(np.isfinite(off), off, np.inf)


def quads(n: int, first: int, number: int, seed: int) -> np.ndarray:
    """Four different places of n for each of so many tries from `first` on; each try has its own seed."""
    return np.array([np.random.default_rng((seed, t)).choice(n, 4, replace=False) for t in range(first, first + number)])


def _about_the_median(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like _centred, but as most points lie, whatever the others do."""
    middle = np.median(p, axis=0)
    scale = 1 / max(np.median(np.hypot(*(p - middle).T)), 1e-12)
    return (p - middle) * scale, np.array([[scale, 0, -scale * middle[0]], [0, scale, -scale * middle[1]], [0, 0, 1]])


def hypotheses(p: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The matrices that lead each four chosen pairs to their places exactly; NaN for three on a line."""
    (a, before), (b, after) = _about_the_median(p[:, :2]), _about_the_median(p[:, 2:])
    x, y, u, w = a[chosen, 0], a[chosen, 1], b[chosen, 0], b[chosen, 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    top = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], axis=-1)
    low = np.stack([zero, zero, zero, x, y, one, -w * x, -w * y], axis=-1)
    left, right = np.concatenate([top, low], axis=1), np.concatenate([u, w], axis=1)
    out = np.full((len(chosen), 9), np.nan)
    fine = np.linalg.svd(left, compute_uv=False)[:, -1] > 1e-9 * np.abs(left).max(axis=(1, 2))
    out[fine, :8] = np.linalg.solve(left[fine], right[fine][..., None])[..., 0]
    out[fine, 8] = 1
    whole = np.linalg.inv(after) @ out.reshape(-1, 3, 3) @ before
    with np.errstate(all="ignore"):
        return whole / whole[:, 2:, 2:]


def bar_of(off: np.ndarray, most_error: float) -> float:
    """How far off a pair may be to agree: most_error, or less where those that agree are much nearer on the whole."""
    near = off[off <= most_error]
    return min(most_error, max(4 * 1.4826 * float(np.median(near)), 1e-6)) if len(near) else most_error


def refitted(p: np.ndarray, m: np.ndarray, most_error: float) -> tuple[np.ndarray | None, int]:
    """The fit of least squares to the pairs that agree with m, made again until the same ones agree, and their number;
    none where these are degenerate."""
    off = distances(m, p)
    near = off <= bar_of(off, most_error)
    for _ in range(20):
        again = homography(p[near, :2], p[near, 2:]) if near.sum() >= LEAST_POINTS else None
        if again is None:
            return None, 0
        m, off = again, distances(again, p)
        after = off <= bar_of(off, most_error)
        if (after == near).all() or after.sum() < LEAST_POINTS:
            break
        near = after
    return m, int(near.sum())


def estimate(points: DataFrame, most_error: float = 3.0, tries: int = TRIES, seed: int = 20) -> DataFrame:
    """camera_id, homography, n, inliers and reason of each camera's pairs of points (camera_id, image_x, image_y, world_x,
    world_y), by consensus.

    Pairs with a null or infinite coordinate don't count. Sets of four pairs, the same ones each time, each give a matrix;
    tries of all cameras are rows that are scored side by side, by the squares of the pairs' distances from where they belong,
    none counting more than most_error. The best of a camera is fitted again by least squares to the pairs that agree. With 40 % of pairs off, one in eight sets is free of them, so that of 512 none is, has
    odds of 10^-29. Fewer than four pairs, or degenerate ones, give no homography and the reason. A camera's pairs travel
    as one array: they are set by hand.
    """
    good = F.array(*NAMES)
    fine = F.forall(good, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    arrays = points.groupBy("camera_id").agg(F.sort_array(F.collect_list(F.when(fine, good))).alias("pairs"))
    work = arrays.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(tries - 1), F.lit(AT_ONCE))))

    def score(parts):
        for pdf in parts:
            out = []
            for camera, pairs, first in zip(pdf["camera_id"], pdf["pairs"], pdf["first"]):
                p = np.array([list(x) for x in pairs], float).reshape(-1, 4)
                if len(p) >= LEAST_POINTS:
                    found = hypotheses(p, quads(len(p), first, min(AT_ONCE, tries - first), seed))
                    sums, near = scores(found, p, most_error)
                    top = int(sums.argmin())
                    if near[top] >= LEAST_POINTS:
                        out.append((camera, float(sums[top]), found[top].ravel().tolist()))
            yield pd.DataFrame(out, columns=["camera_id", "off", "m"])

    tried = work.repartition("camera_id", "first").mapInPandas(score, "camera_id long, off double, m array<double>")
    # of equal ones the least matrix, so that the result doesn't hang on the order of rows
    best = tried.groupBy("camera_id").agg(F.min_by("m", F.struct("off", "m")).alias("m"))

    def finish(parts):
        for pdf in parts:
            out = []
            for camera, pairs, m in zip(pdf["camera_id"], pdf["pairs"], pdf["m"]):
                p = np.array([list(x) for x in pairs], float).reshape(-1, 4)
                fit, inliers = (None, 0) if m is None else refitted(p, np.array(m).reshape(3, 3), most_error)
                reason = "fewer than four points" if len(p) < LEAST_POINTS else "degenerate points" if fit is None else None
                out.append((camera, None if fit is None else fit.ravel().tolist(), len(p), inliers, reason))
            yield pd.DataFrame(out, columns=["camera_id", "homography", "n", "inliers", "reason"])

    return arrays.join(best, "camera_id", "left").mapInPandas(finish, "camera_id long, homography array<double>, n long, inliers long, reason string")


def reprojection_error(points: DataFrame, calibrations: DataFrame) -> DataFrame:
    """camera_id and the mean distance of its pairs' projections from where they belong."""
    joined = points.join(calibrations.select("camera_id", "homography"), "camera_id")
    x, y = projected(F.col("image_x"), F.col("image_y"), F.col("homography"))
    return joined.groupBy("camera_id").agg(F.avg(F.hypot(x - F.col("world_x"), y - F.col("world_y"))).alias("error"))


def with_world(detections: DataFrame, calibrations: DataFrame, zones: DataFrame) -> DataFrame:
    """Detections (camera_id, x1..y2) with world_x, world_y and zone_id: null for a camera without a calibration
    (camera_id, homography) or a box without corners."""
    joined = detections.join(calibrations.select("camera_id", "homography"), "camera_id", "left")
    known = F.col("homography").isNotNull()
    x, y = projected(*ground_point(Box.of()), F.col("homography"))
    placed = joined.withColumns({"x": F.when(known, x), "y": F.when(known, y)}).drop("homography")
    return classify(placed, zones).withColumnsRenamed({"x": "world_x", "y": "world_y"})
