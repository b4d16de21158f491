"""Zones by grid against plain ray casting, and calibrations with many pairs that are far off."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import calibration, zones

ZONES = "camera_id int, zone_ord int, zone_id long, is_active boolean, polygon array<struct<x:double,y:double>>"


def held(x, y, polygon, eps=1e-9):
    """Plain ray casting; what is on an edge is inside."""
    odd = False
    for (ax, ay), (bx, by) in zip([polygon[-1], *polygon[:-1]], polygon):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if abs(cross) <= eps and min(ax, bx) - eps <= x <= max(ax, bx) + eps and min(ay, by) - eps <= y <= max(ay, by) + eps:
            return True
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def star(rng, middle, reach):
    """A polygon about a point, often concave."""
    n = int(rng.integers(3, 9))
    angles, far = np.sort(rng.uniform(0, 2 * np.pi, n)), reach * rng.uniform(0.2, 1, n)
    return [(float(middle[0] + r * np.cos(a)), float(middle[1] + r * np.sin(a))) for a, r in zip(angles, far)]


def many(n, side, reach=3.0, seed=4):
    rng = np.random.default_rng(seed)
    return [(1, i, 1000 + i, bool(i % 11), star(rng, rng.uniform(0, side, 2), reach)) for i in range(n)]


@pytest.mark.parametrize("most", [0, 10**6])
def test_many_zones_of_one_camera(spark, most):
    """Five thousand zones and more points, on edges and corners too."""
    listed = many(5000, 250.0)
    rng = np.random.default_rng(5)
    points = [(i, 1, *map(float, p)) for i, p in enumerate(rng.uniform(-5, 255, (400, 2)))]
    points += [(1000 + i, 1, *z[4][0]) for i, z in enumerate(listed[:50])] + [(2000 + i, 1, (z[4][0][0] + z[4][1][0]) / 2, (z[4][0][1] + z[4][1][1]) / 2) for i, z in enumerate(listed[:50])]
    got = {r["id"]: r["zone_id"] for r in zones.classify(spark.createDataFrame(points, "id long, camera_id int, x double, y double"), spark.createDataFrame(listed, ZONES), most).collect()}
    boxes = np.array([[*np.min(z[4], axis=0), *np.max(z[4], axis=0)] for z in listed])
    want = {}
    for i, _, x, y in points:
        near = np.flatnonzero((boxes[:, 0] <= x + 1e-9) & (boxes[:, 1] <= y + 1e-9) & (boxes[:, 2] >= x - 1e-9) & (boxes[:, 3] >= y - 1e-9))
        want[i] = next((listed[z][2] for z in near if listed[z][3] and held(x, y, listed[z][4])), None)
    assert got == want and 50 < sum(z is not None for z in want.values()) < len(want)


def test_what_a_point_costs_does_not_follow_the_zones(spark):
    """Corners that are tested for a point, with a hundred times the zones on a hundred times the ground."""
    tested = {}
    for n, side in ((50, 25.0), (5000, 250.0)):
        _, cells = zones.celled(spark.createDataFrame(many(n, side), ZONES))
        corners = F.aggregate("zones", F.lit(0), lambda s, z: s + F.when(z["polygon"].isNull(), 0).otherwise(F.size(z["polygon"])))
        tested[n] = cells.agg(F.avg(corners)).first()[0]
        assert cells.count() < 130 * n
    assert tested[5000] < 1.5 * tested[50]


def test_large_zones_lists_and_odd_points(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    listed = [(1, 2, 7, True, square(0.0, 1000.0)), (1, 1, 8, True, square(10.0, 11.0)), (1, 0, 9, False, square(0.0, 1000.0)), (2, 0, 5, True, square(-1.0, 1.0)), (2, 1, 6, True, [(0.0, 0.0), (1.0, 1.0)]), (1, 3, 4, True, square(0.0, 2000.0)), (3, 0, 3, True, None)]
    points = [(1, 1, 10.5, 10.5), (2, 1, 500.0, 500.0), (3, 1, 1000.0, 1000.0), (4, 1, 1500.0, 3.0), (5, 2, 1.0, 0.0), (6, 2, 1.1, 0.0), (7, 9, 0.0, 0.0), (8, None, 0.0, 0.0), (9, 1, None, 5.0), (10, 1, float("nan"), 5.0), (11, 1, float("inf"), 5.0), (12, 1, 10.0, 10.0), (13, 3, 0.0, 0.0)]
    df = spark.createDataFrame(points, "id long, camera_id int, x double, y double")
    want = {1: 8, 2: 7, 3: 7, 4: 4, 5: 5, 6: None, 7: None, 8: None, 9: None, 10: None, 11: None, 12: 8, 13: None}
    for most in (0, 1000):
        got = zones.classify(df, spark.createDataFrame(listed, ZONES), most)
        assert {r["id"]: r["zone_id"] for r in got.collect()} == want and sorted(got.columns) == ["camera_id", "id", "x", "y", "zone_id"]
    assert zones.classify(df, spark.createDataFrame([], ZONES)).where("zone_id IS NOT NULL").count() == 0


TRUE = np.array([[0.02, 0.003, 1.0], [-0.001, 0.025, 2.0], [0.0003, 0.0001, 1.0]])
POINTS = "camera_id long, image_x double, image_y double, world_x double, world_y double"


def pairs(camera, n, off, seed, noise=0.0):
    rng = np.random.default_rng(seed)
    image = rng.uniform(0, 640, (n, 2))
    q = np.column_stack([image, np.ones(n)]) @ TRUE.T
    world = q[:, :2] / q[:, 2:] + rng.normal(size=(n, 2)) * noise
    wrong = rng.permutation(n)[:off]
    world[wrong] += rng.choice([-1, 1], (off, 2)) * rng.uniform(5, 400, (off, 2))
    good = np.setdiff1d(np.arange(n), wrong)
    return [(camera, *map(float, (*a, *b))) for a, b in zip(image, world)], image[good], q[good, :2] / q[good, 2:]


def test_pairs_that_are_far_off(spark):
    """Up to four pairs of ten far off, and small noise on the others."""
    cases = {1: (12, 0, 0.0), 2: (12, 1, 0.0), 3: (12, 4, 0.0), 4: (40, 16, 0.0), 5: (10, 4, 0.0), 6: (50, 20, 0.001), 7: (200, 80, 0.001)}
    made = {c: pairs(c, n, off, c, noise) for c, (n, off, noise) in cases.items()}
    df = spark.createDataFrame([r for rows, _, _ in made.values() for r in rows], POINTS)
    got = {r["camera_id"]: r for r in calibration.estimate(df).collect()}
    for c, (n, off, noise) in cases.items():
        _, image, world = made[c]
        m = np.array(got[c]["homography"]).reshape(3, 3)
        q = np.column_stack([image, np.ones(len(image))]) @ m.T
        error = np.hypot(*(q[:, :2] / q[:, 2:] - world).T)
        assert error.mean() < (0.01 if noise else 1e-6), (c, error.mean())
        assert got[c]["n"] == n and got[c]["inliers"] <= n - off and got[c]["inliers"] >= (n - off if not noise else 0.9 * (n - off))
    again = {r["camera_id"]: r["homography"] for r in calibration.estimate(df.repartition(7)).collect()}
    assert again == {c: r["homography"] for c, r in got.items()}


def test_pairs_without_a_calibration(spark):
    line = [(1, float(i), float(2 * i), float(i), float(i)) for i in range(8)]
    same = [(2, 1.0, 1.0, 5.0, 5.0)] * 6
    few = [(3, 0.0, 0.0, 0.0, 0.0), (3, 1.0, 0.0, 1.0, 0.0), (3, 1.0, 1.0, 1.0, 1.0), (3, None, 1.0, 0.0, 1.0), (3, float("nan"), 1.0, 0.0, 1.0)]
    got = {r["camera_id"]: r for r in calibration.estimate(spark.createDataFrame(line + same + few, POINTS)).collect()}
    assert {c: (r["homography"], r["reason"], r["n"]) for c, r in got.items()} == {1: (None, "degenerate points", 8), 2: (None, "degenerate points", 6), 3: (None, "fewer than four points", 3)}
    assert calibration.estimate(spark.createDataFrame([], POINTS)).count() == 0


def test_every_try_is_the_same_whichever_row_makes_it():
    whole = calibration.quads(9, 0, 128, 20)
    assert (whole[64:] == calibration.quads(9, 64, 64, 20)).all() and all(len(set(q)) == 4 for q in whole.tolist())


def test_many_pairs_take_memory_by_their_number():
    """Forty thousand pairs of a camera: left vectors of each pair by each would be fifty gigabytes."""
    m = np.array([[0.01, 0.002, 1], [-0.001, 0.012, 2], [0.0004, 0.0001, 1]])
    p = np.random.default_rng(5).uniform(0, 400, (40_000, 2))
    q = np.column_stack([p, np.ones(len(p))]) @ m.T
    w = q[:, :2] / q[:, 2:]
    assert np.allclose(calibration.homography(p, w), m / m[2, 2], atol=1e-6)
    sums, near = calibration.scores(np.stack([m, np.eye(3)]), np.hstack([p, w]), 3.0, cells=1000)
    off = calibration.distances(np.stack([m, np.eye(3)]), np.hstack([p, w]))
    assert near.tolist() == (off <= 3).sum(axis=1).tolist() and np.allclose(sums, (np.minimum(off, 3) ** 2).sum(axis=1))
