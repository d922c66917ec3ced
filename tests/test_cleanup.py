"""The clean-up's steps and stops on hand-made cases, and exact distances beside brute force."""

import itertools
import math
import random

import pytest

from vesselspark.operators import gaps
from vesselspark.operators import voxels as vox

KEY = "case_id int, a0 int, a1 int, a2 int"
TREE = [(k, y, 5) for k in range(3, 33) for y in (5, 6)]
SPECK, NEAR, FAR, BLOB = [(10, 36, 36)], [(k, 6, 9) for k in range(20, 30)], [(k, 30, 30) for k in range(10, 20)], list(itertools.product(range(10, 13), range(8, 11), range(9, 12)))


def rows_of(spark, *cases):
    return spark.createDataFrame([(c, *p) for c, points in enumerate(cases) for p in points], KEY)


def cleaned(spark, config, *cases, skeleton=None):
    shapes = spark.createDataFrame([(c, 40, 40, 40) for c in range(len(cases) + 1)], "case_id int, n0 int, n1 int, n2 int")
    out, metrics = vox.cleanup(rows_of(spark, *cases), shapes, config, skeleton)
    got = [set() for _ in range(len(cases) + 1)]
    for r in out.collect():
        got[r.case_id].add((r.a0, r.a1, r.a2))
    return got, {r.case_id: r for r in metrics.collect()}


def test_default_steps_and_stops(spark):
    """Small components go first even in a case below the floor; far ones go in the others; an empty case counts nothing."""
    config = vox.Cleanup(least_size=5, floor=60, share=0.3)
    got, metrics = cleaned(spark, config, TREE + SPECK + NEAR + FAR, TREE[:40] + SPECK + FAR)
    assert got == [{*TREE, *NEAR}, {*TREE[:40], *FAR}, set()]
    assert tuple(metrics[0])[1:] == (81, 4, 81, 81, 3, 80, 0, 80, 0, 1, 0, 70, 2)
    assert tuple(metrics[1])[1:] == (51, 3, 51, 51, 2, 50, 0, 0, 0, 0, 0, 50, 2)
    assert tuple(metrics[2])[1:] == (0,) * 13


def test_bridges_and_shapes(spark):
    config = vox.Cleanup(least_size=5, floor=10, share=0.3, bridging_mm=2.0, bridge_radius_mm=0.5, elongation=2.0, near_mm=None)
    got, metrics = cleaned(spark, config, TREE + NEAR + FAR + [(a, b + 20, c) for a, b, c in BLOB])
    assert {*TREE, *NEAR, *FAR} < got[0] and not {(a, b + 20, c) for a, b, c in BLOB} & got[0]
    m = metrics[0]
    assert (m.bridges_added, m.components_removed_shape, m.components_removed_distance, m.output_components) == (1, 1, 0, 2) and m.voxels_after_bridging > 107


def test_smoothing_closing_and_final_removal(spark):
    """A thin thread is cut by smoothing or cleared by breaking cycles; what is then too small goes at the end."""
    ring = [(k, y, 5) for k in range(5, 25) for y in (5, 15)] + [(k, y, 5) for y in range(6, 15) for k in (5, 24)]
    thick = [(k, y, z) for k in range(3, 8) for y in range(4, 17) for z in range(3, 8)]
    case = sorted({*ring, *thick})
    got, metrics = cleaned(spark, vox.Cleanup(least_size=20, floor=10, near_mm=None, cycles_mm=0.8), case, skeleton=rows_of(spark, ring))
    m = metrics[0]
    # its corners are triangles of their own
    assert m.cycles_broken >= 1 and 0 < m.input_voxels - m.output_voxels < 40 and m.output_components == 1 and set(thick) <= got[0]
    with pytest.raises(ValueError):
        cleaned(spark, vox.Cleanup(cycles_mm=0.5), case)
    got, metrics = cleaned(spark, vox.Cleanup(least_size=5, floor=10, near_mm=None, smoothing=0.8, closing=1), thick + [(k, 30, 30) for k in range(10, 18)])
    m = metrics[0]
    assert m.input_components == 2 and m.components_after_initial_removal == 1 and m.voxels_after_smoothing < m.voxels_after_closing and got[0] <= set(thick)


def test_case_masks(spark):
    """The third mask is the second one cleaned."""
    probs = spark.createDataFrame([(0, *p, 0.9) for p in TREE + SPECK] + [(0, 1, 1, 1, 0.1)], KEY + ", p double")
    shapes = spark.createDataFrame([(0, 40, 40, 40)], "case_id int, n0 int, n1 int, n2 int")
    truth = rows_of(spark, TREE).selectExpr("*", "1.0D as value")
    masks = gaps.case_masks(truth, probs, shapes, (0.5,) * 3, (0.5,) * 3, config=vox.Cleanup(least_size=5, floor=10))
    assert [{(r.a0, r.a1, r.a2) for r in m.collect()} for m in masks] == [set(TREE), {*TREE, *SPECK}, set(TREE)]


@pytest.mark.parametrize("seed", range(2))
def test_distances(spark, seed):
    """Solid boxes with holes, at the grid's ends and inside, far from any background, and a case without any."""
    rng = random.Random(seed)
    shape = (21, 9, 14)
    grid = list(itertools.product(*map(range, shape)))
    holes = {rng.choice(grid) for _ in range(4)}
    noise = {p for p in grid if rng.random() < 0.5}
    cases = [[p for p in grid if p not in holes], sorted(noise), grid]
    shapes = spark.createDataFrame([(c, *shape) for c in range(3)], "case_id int, n0 int, n1 int, n2 int")
    got = {(r.case_id, r.a0, r.a1, r.a2): r.distance for r in vox.distance_transform(rows_of(spark, *cases), shapes).collect()}
    for case, points in enumerate(cases[:2]):
        ground = [p for p in grid if p not in set(points)]
        for p in points:
            assert math.isclose(got[case, *p], min(math.dist(p, q) for q in ground))
    assert len(got) == len(cases[0]) + len(cases[1])


def test_left_split_in_whole_cases(spark):
    """A left tree over a right one: the trunk becomes LM, its branches LAD and LCx by their side; segments of the right tree keep their name."""
    trunk = [(k, 20, 34) for k in range(39, 27, -1)]
    lad, lcx, right = [(k, 20 - (28 - k), 34) for k in range(28, 12, -1)], [(k, 20 + (28 - k), 34) for k in range(28, 12, -1)], [(k, 20, 3) for k in range(5, 35)]
    lower = [[(k, y, 34) for k in range(13, 0, -1)] for y in (5, 35)]
    rows = []
    for seg, line in enumerate((trunk, lad, lcx, right, *lower)):
        rows += [(0, seg, k, len(line), k * 1.0, (len(line) - 1) * 1.0, 1.5, *map(float, p)) for k, p in enumerate(line)]
    points = spark.createDataFrame(rows, "case_id int, seg_id int, idx int, n int, arc_mm double, length_mm double, radius_mm double, p0 double, p1 double, p2 double")
    shapes = spark.createDataFrame([(0, 40, 60, 40)], "case_id int, n0 int, n1 int, n2 int")
    labelled = vox.components(vox.stamp(rows_of(spark, trunk + lad + lcx + right + lower[0] + lower[1]), 1, shapes))
    names = {r.seg_id: r.artery_name for r in gaps.artery_names(points, labelled, shapes).collect()}
    assert names == {0: "LM", 1: "LAD", 2: "LCx", 3: "Right Coronary", 4: "LAD", 5: "LCx"}
