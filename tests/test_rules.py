"""Neighbour search over long ways, long kernels, and the rules of tips and gaps on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vesselspark.operators import gaps, graph, profile
from vesselspark.operators import voxels as vox

ENDS = "gap_id int, a struct<a0: int, a1: int, a2: int>, b struct<a0: int, a1: int, a2: int>, radius_a double, radius_b double"


def test_nearest_far_away(spark):
    """Clouds near and far, ties, and a case without points on the other side."""
    rng = np.random.default_rng(2)
    surface = [(0, *map(float, p)) for p in rng.integers(0, 30, (400, 3))] + [(1, 5.0, 5.0, 5.0)]
    asked = [(0, *map(float, p)) for p in np.concatenate([rng.integers(0, 40, (60, 3)), rng.integers(300, 340, (60, 3)), [[15, 15, 900]]])] + [(2, 0.0, 0.0, 0.0), (1, 5.0, 5.0, 105.0)]
    left = spark.createDataFrame([(c, k, *p) for k, (c, *p) in enumerate(asked)], "case_id int, id_a int, x0 double, x1 double, x2 double")
    right = spark.createDataFrame([(c, k, *p) for k, (c, *p) in enumerate(surface)], "case_id int, id_b int, y0 double, y1 double, y2 double")
    got = {r.id_a: (r.distance, r.id_b) for r in vox.nearest(left, right).collect()}
    want = {k: min((math.dist(p, q), j) for j, (d, *q) in enumerate(surface) if c == d) for k, (c, *p) in enumerate(asked) if c != 2}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)


@pytest.mark.parametrize("n", [5, 40, 400])
def test_long_kernel(spark, n):
    """Sigma 20, whose kernel is longer than the line."""
    rng = np.random.default_rng(n)
    values = rng.random(n)
    rows = spark.createDataFrame([(0, 0, k, float(v)) for k, v in enumerate(values)], "case_id int, seg_id int, idx int, radius_mm double")
    got = [r.r for r in profile.smooth(rows, sigma=20.0).orderBy("idx").collect()]
    weights = profile.gaussian_weights(20.0)
    reach = len(weights) // 2
    at = (np.arange(n)[:, None] + np.arange(-reach, reach + 1)) % (2 * n)
    assert np.allclose(got, (values[np.where(at < n, at, 2 * n - 1 - at)] * weights).sum(1))
    # the same along an axis of a volume
    volume = rows.select("case_id", F.col("idx").alias("a0"), F.lit(0).alias("a1"), F.lit(0).alias("a2"), F.col("radius_mm").alias("value"))
    blurred = vox.blur(volume, spark.createDataFrame([(0, n, 1, 1)], "case_id int, n0 int, n1 int, n2 int"), 20.0, (0,))
    assert np.allclose([r.value for r in blurred.orderBy("a0").collect()], got)


def test_tip_rules(spark):
    """One tip for each rule, in the order of the rules."""
    middle, rows = (50, 50, 50), []
    for radius, beyond, prob, size, tips in [(1.0, 0, 0, 9000, 2), (2.0, 9.0, 9.0, 9000, 2), (1.0, 0.6, 0.9, 9000, 2), (1.0, 0.5, 0.2, 9000, 2), (1.0, None, None, 400, 2), (0.7, 0.0, 0.0, 400, 3), (0.7, 0.0, 0.0, 600, 3), (1.0, 0.0, 0.0, 400, 3), (0.7, 0.0, 0.0, 899, 1)]:
        at = (2, 50, 50) if not rows else middle
        rows.append((0, (0, at[0], at[1], at[2] + len(rows)), radius, beyond, prob, size, 9000 if size == 899 else 5000, tips))
    frame = spark.createDataFrame([(c, n, *map(lambda x: None if x is None else float(x), r[:3]), *r[3:]) for c, n, *r in rows], "case_id int, node struct<case_id: int, a0: int, a1: int, a2: int>, radius_mm double, beyond double, beyond_prob double, fragment_size int, largest_size int, fragment_tips int")
    wide = spark.createDataFrame([(0, 200, 200, 200)], "case_id int, n0 int, n1 int, n2 int")
    got = {r.node.a2 - 50: (r.is_valid, r.reason, r.confidence) for r in graph.classify_tips(frame, wide).collect()}
    assert [got[k] for k in range(9)] == [
        (True, "boundary", 0.9), (False, "large_radius_abrupt_stop", 0.8), (False, "contrast_continues", 0.7), (False, "model_prob_continues", 0.65), (False, "small_component_fragment", 0.65),
        (False, "thin_fragment_tip", 0.6), (True, "thin_vessel_tip", 0.75), (True, "default", 0.5), (False, "small_component_fragment", 0.65),
    ]


def test_gap_tiers(spark):
    rows = [(0, 0.02, 0.9), (1, 0.05, 0.2), (2, 0.05, 0.12), (3, 0.2, 0.15), (4, 0.2, 0.1), (5, 0.2, 0.05), (6, None, 0.3), (7, None, None), (8, 0.08, 0.2)]
    frame = spark.createDataFrame(rows, "gap_id int, tube_mean double, combined_mean double")
    got = [(r.tier, r.action, r.path_needs) for r in graph.gap_decision(frame).orderBy("gap_id").collect()]
    assert got == [
        ("none", "skip", 0.8), ("low_signal", "threshold", 0.8), ("low_signal", "path", 0.8), ("normal", "threshold", 0.6), ("normal", "path", 0.6), ("normal", "low_signal", 0.6),
        ("unknown", "threshold", 0.6), ("unknown", "low_signal", 0.6), ("normal", "threshold", 0.6),
    ]


def test_bridge_acceptance(spark):
    """A line of voxels is accepted, a cloud of over three cylinders is not, nor are nine voxels; ends that touch by a corner only do not meet."""
    line = [(k, 0, 0) for k in range(14)]
    cloud = [(k, i, j) for k in range(14) for i in range(6) for j in range(6)]
    roi = [(0, *p, 0.3, p in (line[0], line[-1]), True) for p in line] + [(1, *p, 0.3, p in (line[0], line[-1]), True) for p in cloud]
    roi += [(2, *p, 0.3, p in (line[0], line[10]), True) for p in line[:11]] + [(3, 0, 0, 0, 0.3, True, True), (3, 1, 1, 0, 0.3, True, True)] + [(4, *p, 0.3, p in (line[0], line[-1]), p[0] != 5) for p in line]
    frame = spark.createDataFrame(roi, "gap_id int, a0 int, a1 int, a2 int, p double, in_mask boolean, in_tube boolean")
    ends = spark.createDataFrame([(0, line[0], line[13], 0.5, 1.0), (1, line[0], line[13], 1.0, 1.0), (2, line[0], line[10], 1.0, 1.0), (3, line[0], (1, 1, 0), 1.0, 1.0), (4, line[0], line[13], 1.0, 1.0)], ENDS)
    found = gaps.threshold_bridges(ends, frame)
    got = {r.gap_id: (r.threshold, r.n_new, round(r.expected, 6), r.accepted) for r in gaps.judge_bridges(found, frame, ends).collect()}
    cylinder = round(math.pi * 13, 6)
    assert got == {0: (0.2, 12, cylinder, True), 1: (0.2, 502, cylinder, False), 2: (0.2, 9, round(math.pi * 10, 6), False)}


def test_bridge_costs(spark):
    rows = [(0, *p, 0.4, t) for p, t in [((0, 0, 0), True), ((10, 0, 0), True), ((5, 0, 0), True), ((5, 3, 4), True), ((5, 1, 0), False)]]
    frame = spark.createDataFrame(rows, "gap_id int, a0 int, a1 int, a2 int, p double, in_tube boolean")
    ends = spark.createDataFrame([(0, (0, 0, 0), (10, 0, 0), 1.0, 1.0)], ENDS)
    got = {(r.a0, r.a1, r.a2): r.cost for r in gaps.bridge_costs(ends, frame).collect()}
    assert got == pytest.approx({(0, 0, 0): 0.01, (10, 0, 0): 0.01, (5, 0, 0): 0.6, (5, 3, 4): 0.6 + 0.3 * 5 / 5, (5, 1, 0): 10.0})


def test_boxes_over_chunks(spark):
    """Boxes that begin below zero, end beyond chunks, hold one voxel or none."""
    rng = np.random.default_rng(1)
    places = {tuple(map(int, p)) for p in rng.integers(-5, 60, (500, 3))}
    boxes = [(0, -20, 70, -20, 70, -20, 70), (1, 15, 16, 0, 59, 3, 40), (2, 7, 7, 0, 59, 0, 59), (3, 5, 4, 0, 59, 0, 59), (4, -5, -1, -5, 31, 16, 47)]
    rows = spark.createDataFrame([(0, *p) for p in places], "case_id int, a0 int, a1 int, a2 int")
    asked = spark.createDataFrame([(0, *b) for b in boxes], "case_id int, box_id int, low0 int, high0 int, low1 int, high1 int, low2 int, high2 int")
    got = {(r.box_id, r.a0, r.a1, r.a2) for r in vox.in_boxes(rows, asked).collect()}
    assert got == {(b, *p) for b, *e in boxes for p in places if all(e[2 * k] <= p[k] <= e[2 * k + 1] for k in range(3))}
