"""Hand-made shapes with answers worked out by hand."""

import itertools
import math
import random

import numpy as np
import pytest

from vesselspark.components import connected_components
from vesselspark.operators import graph, profile
from vesselspark.operators import voxels as vox

KEY = "case_id int, a0 int, a1 int, a2 int"


def mask(spark, *cases):
    return spark.createDataFrame([(c, *p) for c, points in enumerate(cases) for p in points], KEY)


LINE = [(k, 0, 0) for k in range(12)]
FORK = [(0, 20, 0), *[(k, 20, 0) for k in range(1, 13)], *[(-k, 20 + k, 0) for k in range(1, 13)], *[(-k, 20 - k, 0) for k in range(1, 13)]]
RING = [(0, k, 0) for k in range(1, 6)] + [(6, k, 0) for k in range(1, 6)] + [(k, 0, 0) for k in range(1, 6)] + [(k, 6, 0) for k in range(1, 6)]


def test_segments(spark):
    rows = graph.trace_segments(graph.neighbours(mask(spark, LINE, FORK, RING)), 10).collect()
    chains = {}
    for r in rows:
        chains.setdefault((r.case_id, r.seg_id), {})[r.idx] = (r.node.a0, r.node.a1, r.node.a2)
    assert [chains[0, 0][k] for k in range(12)] == LINE
    assert sorted(c for c, _ in chains) == [0, 1, 1, 1]
    for (case, _), chain in chains.items():
        assert sorted(chain) == list(range(len(chain))) and len(chain) == (12 if case == 0 else 13)


def test_cycles(spark):
    rows = mask(spark, LINE, FORK, RING)
    links = graph.neighbours(rows)
    assert {r.case_id: r.cycles for r in graph.cycle_counts(graph.degrees(rows, links), links).collect()} == {0: 0, 1: 0, 2: 1}


def test_gap(spark):
    two = [(k, 0, 0) for k in range(8)] + [(k, 0, 0) for k in range(11, 20)]
    rows = mask(spark, two)
    links = graph.neighbours(rows)
    tips = graph.tip_directions(graph.degrees(rows, links).filter("is_endpoint").select("case_id", "node"), links)
    labels = vox.components(rows).selectExpr("struct(case_id, a0, a1, a2) as node", "component")
    found = graph.gap_pairs(tips.join(labels, "node").selectExpr("*", "1.0D as radius_mm"), 3.0).collect()
    assert [(r.a.a0, r.b.a0, r.distance_mm, r.alignment) for r in found] == [(7, 11, 2.0, 1.0)]


@pytest.mark.parametrize("seed", range(2))
def test_components_and_forest(spark, seed):
    rng = random.Random(seed)
    edges = [(k, *rng.sample(range(60), 2), rng.randrange(20)) for k in range(70)]
    frame = spark.createDataFrame(edges, "edge_id long, src long, dst long, weight long")
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    kept = set()
    for i, a, b, _ in sorted(edges, key=lambda e: (e[3], e[0])):
        if root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
            kept.add(i)
    assert {r.edge_id for r in graph.spanning_forest(frame).collect()} == kept
    got = {r.node: r.component for r in connected_components(frame, spark.range(60)).collect()}
    assert got == {x: root(x) for x in range(60)}


def test_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(3000)], "src long, dst long")
    assert {r.component for r in connected_components(chain).collect()} == {0}


def test_elongation(spark):
    cube, flat = list(itertools.product(range(3), repeat=3)), [(a, b, 0) for a in range(9) for b in range(2)]
    far = [(x + 40, y, z) for x, y, z in flat] + [(80, k, k) for k in range(5)] + [(99, 0, 0)]
    rows = vox.elongation(vox.components(mask(spark, cube + far))).collect()
    got = {r.component.a0: r.elongation for r in rows}
    values = np.sort(np.linalg.eigvalsh(np.cov(np.array(flat).T)))[::-1]
    assert math.isclose(got[0], 1.0, rel_tol=1e-6) and math.isclose(got[40], values[0] / values[1], rel_tol=1e-6)
    assert got[80] == math.inf and got[99] is None


def profile_of(spark, radii, step=0.5, case=0):
    n = len(radii)
    rows = [(case, 1, k, k * step, r, (n - 1) * step, False, False, float(k), 0.0, 0.0) for k, r in enumerate(radii)]
    return spark.createDataFrame(rows, "case_id int, seg_id int, idx int, arc_mm double, radius_mm double, length_mm double, start_bif boolean, end_bif boolean, p0 double, p1 double, p2 double")


def test_dips(spark):
    dip = lambda low: [2.0] * 30 + [2 - (2 - low) * w for w in (0.4, 0.8, 1, 1, 1, 0.8, 0.4)] + [2.0] * 30
    found = profile.detect(profile_of(spark, dip(0.8))).collect()
    assert [(r.severity, round(r.pct)) for r in found] == [("Moderate", 60)]
    assert [r.severity for r in profile.detect(profile_of(spark, dip(0.56))).collect()] == ["Severe"]
    assert profile.detect(profile_of(spark, [2.0] * 60)).count() == 0 and profile.detect(profile_of(spark, [2.0] * 4)).count() == 0
    # a smooth dip to under a quarter on a long segment is no narrowing
    deep = [2.0] * 60 + [2 - 1.7 * math.sin(math.pi * k / 20) ** 2 for k in range(21)] + [2.0] * 60
    assert profile.detect(profile_of(spark, deep)).count() == 0
    assert profile.detect(profile_of(spark, deep), cfg=profile.NarrowingConfig(extreme_length_mm=1000, drop_radius_mm=0.1)).count() == 1


def test_resample_is_on_the_curve(spark):
    rows = graph.arc_length(spark.createDataFrame([(0, 0, k, float(k), float(k % 2), 0.0) for k in range(9)], "case_id int, seg_id int, idx int, p0 double, p1 double, p2 double"))
    out = graph.resample_curve(rows, 0.3).orderBy("idx").collect()
    assert len(out) == int(8 * math.sqrt(2) * 0.5 / 0.3) and [r.idx for r in out] == list(range(len(out)))
    assert all(abs(r.p1 - abs(r.p0 - 2 * round(r.p0 / 2))) < 1e-9 for r in out) and (out[-1].p0, out[-1].p1) == (8.0, 0.0)
