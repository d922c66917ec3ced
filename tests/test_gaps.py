"""Gap operators on hand-made shapes."""

import collections
import heapq
import itertools
import math
import random

from pyspark.sql import functions as F

from vesselspark.operators import gaps, graph
from vesselspark.operators import voxels as vox

KEY = "case_id int, a0 int, a1 int, a2 int"


def rows_of(spark, points):
    return spark.createDataFrame([(0, *p) for p in points], KEY)


def test_cheapest_path(spark):
    rng = random.Random(4)
    cost = {p: rng.choice([0.1, 0.5, 1.0, 5.0]) for p in itertools.product(range(5), repeat=3)}
    roi = spark.createDataFrame([(g, *p, c * (1 + g)) for g in (0, 1) for p, c in cost.items()], "gap_id int, a0 int, a1 int, a2 int, cost double")
    ends = spark.createDataFrame([(0, (0, 0, 0), (4, 4, 4)), (1, (4, 0, 0), (0, 4, 4))], "gap_id int, a struct<a0: int, a1: int, a2: int>, b struct<a0: int, a1: int, a2: int>")
    got = {}
    for r in gaps.cheapest_paths(ends, roi).collect():
        got.setdefault(r.gap_id, {})[r.idx] = (r.a0, r.a1, r.a2)

    def price(path):
        return sum((cost[a] + cost[b]) / 2 * math.dist(a, b) for a, b in itertools.pairwise(path))

    for gap, (start, end) in {0: ((0, 0, 0), (4, 4, 4)), 1: ((4, 0, 0), (0, 4, 4))}.items():
        far, heap = {start: 0.0}, [(0.0, start)]
        while heap:
            d, p = heapq.heappop(heap)
            for o in vox.ALL26:
                q = tuple(x + y for x, y in zip(p, o, strict=True))
                if q in cost and d + (cost[p] + cost[q]) / 2 * math.dist(p, q) < far.get(q, math.inf) - 1e-12:
                    far[q] = d + (cost[p] + cost[q]) / 2 * math.dist(p, q)
                    heapq.heappush(heap, (far[q], q))
        path = [got[gap][k] for k in range(len(got[gap]))]
        assert path[0] == start and path[-1] == end and math.isclose(price(path), far[end])


def test_long_path(spark, monkeypatch):
    """A straight path takes a round for every few of its steps, and doubling reads it off."""
    names = collections.Counter()
    for module in (gaps, graph):
        monkeypatch.setattr(module, "written", lambda df, name="table", own=module.written: (names.update([name]), own(df, name))[1])
    n = 60
    roi = spark.createDataFrame([(1, k, 0, 0, 0.5) for k in range(n)], "gap_id int, a0 int, a1 int, a2 int, cost double")
    ends = spark.createDataFrame([(1, (0, 0, 0), (n - 1, 0, 0))], "gap_id int, a struct<a0: int, a1: int, a2: int>, b struct<a0: int, a1: int, a2: int>")
    got = sorted((r.idx, r.a0) for r in gaps.cheapest_paths(ends, roi, 4).collect())
    assert got == [(k, k) for k in range(n)]
    assert names["front"] <= n / 4 + 2 and names["way"] < 10


def test_label_near(spark):
    """The voxel's own label; else the most frequent one of the smallest cube that holds any."""
    rows = [(0, 5, 5, 5, "own"), (0, 20, 20, 22, "far"), (0, 20, 21, 21, "ring"), (0, 21, 21, 21, "ring"), (0, 19, 20, 20, "alone"), (0, 40, 40, 43, "edge"), (0, 60, 60, 64, "out")]
    labelled = spark.createDataFrame(rows, KEY + ", component string")
    ends = spark.createDataFrame([(0, 1, 5, 5, 5), (0, 2, 20, 20, 20), (0, 3, 40, 40, 40), (0, 4, 60, 60, 60)], "case_id int, id int, a0 int, a1 int, a2 int")
    assert {r.id: r.component for r in gaps.label_near(ends, labelled).collect()} == {1: "own", 2: "ring", 3: "edge"}


def test_corners_do_not_connect(spark):
    left, right = [(k, 0, 0) for k in range(30)], [(k, 1, 1) for k in range(32, 62)]
    ends = spark.createDataFrame([(0, 7, (29, 0, 0), (32, 1, 1))], "case_id int, gap_id int, a struct<a0: int, a1: int, a2: int>, b struct<a0: int, a1: int, a2: int>")
    tube = spark.createDataFrame([(0, 7, 30, 0, 0), (0, 7, 31, 0, 0)], "case_id int, gap_id int, a0 int, a1 int, a2 int")
    merged, verified = gaps.merge_bridges(rows_of(spark, left + right), tube, ends, least_new=2, least_size=10)
    row = verified.first()
    assert merged.count() == 62 and row.applied and not row.connected
    more = tube.union(spark.createDataFrame([(0, 7, 31, 1, 0), (0, 7, 31, 1, 1)], tube.schema))
    assert gaps.merge_bridges(rows_of(spark, left + right), more, ends, least_new=2, least_size=10)[1].first().connected


def test_tapered_tube(spark):
    path = [(k, 20, 20) for k in range(11)]
    paths = spark.createDataFrame([(0, 1, k, *p) for k, p in enumerate(path)], "case_id int, gap_id int, idx int, a0 int, a1 int, a2 int")
    ends = spark.createDataFrame([(1, 1.0, 8.0)], "gap_id int, radius_a double, radius_b double")
    got = {(r.a0, r.a1, r.a2) for r in vox.stamp(vox.tapered(paths, ends), F.col("radius")).collect()}
    want = set()
    for k, p in enumerate(path):
        r = max(1, round(1.5 * (1 - k / 10) + 0.7 * 8.0 * k / 10))
        want |= {tuple(x + y for x, y in zip(p, o, strict=True)) for o in vox.ball(r)}
    assert got == want


def test_resegment_searches(spark):
    """A gap that a threshold joins, the same with a weak place that only a path gets through, and one too weak for either."""
    ends, roi, line = [], [], [(k, 3, 3) for k in range(13)]
    for gap, inside in ((1, 0.9), (2, 0.3)):
        ends.append((gap, (0, 3, 3), (12, 3, 3), 2.0, 2.0))
        roi += [(gap, *p, inside if p in line else 0.05, 0.5, p in (line[0], line[-1]), True) for p in itertools.product(range(13), range(7), range(7))]
    gaps_, regions = spark.createDataFrame(ends, "gap_id int, a struct<a0: int, a1: int, a2: int>, b struct<a0: int, a1: int, a2: int>, radius_a double, radius_b double"), spark.createDataFrame(roi, "gap_id int, a0 int, a1 int, a2 int, p double, p_main double, in_mask boolean, in_tube boolean")
    # a tube along the line only, so that the mean there is what the line has
    regions = regions.withColumn("in_tube", F.expr("abs(a1 - 3) + abs(a2 - 3) <= 1"))
    details, new = gaps.resegment(gaps_, regions)
    rows = {r.gap_id: r for r in details.collect()}
    # over the threshold along the line: 11 new voxels join the ends
    assert rows[1].strategy == "probability_threshold" and rows[1].n_new == 11 and math.isclose(rows[1].avg_probability, 0.9)
    thin = regions.withColumn("p", F.expr("if(a0 = 6, 0.08, p)"))
    rows = {r.gap_id: r for r in gaps.resegment(gaps_, thin)[0].collect()}
    assert rows[1].strategy == "dijkstra_thin" and math.isclose(rows[1].sinuosity, 1.0) and rows[1].n_new > 11
    assert rows[2].strategy == "skipped_low_signal" and rows[2].n_new == 0


def test_bridges(spark):
    left, right = [(k, 0, 0) for k in range(30)], [(k, 0, 0) for k in range(42, 72)]
    gap = [(k, 0, 0) for k in range(30, 42)]
    mask = rows_of(spark, left + right)
    ends = spark.createDataFrame([(0, 7, (29, 0, 0), (42, 0, 0))], "case_id int, gap_id int, a struct<a0: int, a1: int, a2: int>, b struct<a0: int, a1: int, a2: int>")
    roi = spark.createDataFrame([(7, *p, 0.17, False) for p in gap] + [(7, *p, 0.0, True) for p in [left[-1], right[0]]], "gap_id int, a0 int, a1 int, a2 int, p double, in_mask boolean")
    assert [tuple(r) for r in gaps.threshold_bridges(ends, roi).collect()] == [(7, 0.15)]
    assert gaps.threshold_bridges(ends, roi.filter("a0 <> 35")).count() == 0
    tube = spark.createDataFrame([(0, 7, *p) for p in gap], "case_id int, gap_id int, a0 int, a1 int, a2 int")
    merged, verified = gaps.merge_bridges(mask, tube, ends, search=1)
    assert merged.count() == 72 and verified.collect()[0].connected
    merged, verified = gaps.merge_bridges(mask, tube.filter("a0 < 35"), ends, search=1, least_size=10)
    assert merged.count() == 60 and not verified.collect()[0].connected


def test_midpoint_and_combined(spark):
    trunk, branch = [(k, 10, 10) for k in range(40)], [(20, k, 10) for k in range(14, 24)]
    mask = rows_of(spark, trunk + branch)
    labels = vox.components(mask).select(F.struct(*vox.KEY).alias("node"), "case_id", "component", F.lit(1.0).alias("radius_mm"))
    links = graph.neighbours(mask)
    tips = graph.degrees(mask, links).filter("is_endpoint").select("node").join(labels, "node").withColumn("is_valid", F.lit(True))
    found = gaps.midpoint_pairs(tips, labels)
    assert [(r.a.a1, r.b.a0, r.b.a1, r.distance_mm) for r in found.collect()] == [(14, 20, 10, 2.0)]
    none = found.select("case_id", "a", "b", "distance_mm").limit(0)
    assert [r.is_midpoint for r in gaps.combine_pairs(none, found, labels).collect()] == [True]
    taken = found.select("case_id", "a", "b", "distance_mm")
    assert [r.is_midpoint for r in gaps.combine_pairs(taken, found, labels).collect()] == [False]


def test_highlight(spark):
    points = spark.createDataFrame([(0, 1, k, float(k), 0.0, 0.0) for k in range(21)] + [(0, 2, k, 20.0, float(k), 0.0) for k in range(21)], "case_id int, seg_id int, idx int, p0 double, p1 double, p2 double")
    clicks = spark.createDataFrame([(0, 5.0, 1.0, 0.0, 20.0, 9.0, 1.0)], "case_id int, s0 double, s1 double, s2 double, e0 double, e1 double, e2 double")
    mask = rows_of(spark, [(k, 0, 0) for k in range(21)] + [(20, k, 0) for k in range(1, 21)])
    got = {(r.a0, r.a1) for r in gaps.highlight(points, clicks, mask).collect()}
    assert got == {(k, 0) for k in range(1, 21)} | {(20, k) for k in range(1, 14)}


def test_rounds_of_ways_send_no_steps(spark, monkeypatch):
    """a round deals its tables by gap; no row of a step is sent to a place of its own. Other queries keep the session's setting."""
    plans, real = [], gaps.written

    def seen(df, name="table", *more):
        plans.extend([df._jdf.queryExecution().executedPlan().toString()] if name == "front" else [])
        return real(df, name, *more)

    monkeypatch.setattr(gaps, "written", seen)
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    ends = spark.createDataFrame([(g, (0, 0, 0), (5, 0, 0)) for g in range(3)], "gap_id long, a struct<a0: int, a1: int, a2: int>, b struct<a0: int, a1: int, a2: int>")
    roi = spark.createDataFrame([(g, a, b, 0, 1.0 if b or a in (0, 5) else 9.0) for g in range(3) for a in range(6) for b in range(2)], "gap_id long, a0 int, a1 int, a2 int, cost double")
    rows = gaps.cheapest_paths(ends, roi).collect()
    assert sorted((r.gap_id, r.idx, r.a0, r.a1) for r in rows) == [(g, k, k, int(0 < k < 5)) for g in range(3) for k in range(6)]
    assert plans and spark.conf.get(setting) == before
    for plan in plans:
        assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(gap_id") + plan.count("BroadcastExchange") and "hashpartitioning(gap_id#" in plan and ", a0#" not in "".join(x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])
