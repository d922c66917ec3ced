"""Rooted trees beside a plain walk."""

import collections
import math
import random

from vesselspark import components
from vesselspark.operators import graph, trees


def plain(links, nodes, root):
    """What the plain search over the fewest hops says of each node: parent (the smallest that is nearer), depth, distance, children."""
    near = collections.defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    depth, front = {root: 0}, [root]
    while front:
        front = sorted({b for a in front for b in near[a] if b not in depth})
        for b in front:
            depth[b] = 1 + min(depth[a] for a in near[b] if a in depth and a not in front)
    parent = {v: min((a for a in near[v] if depth.get(a) == d - 1), default=None) for v, d in depth.items()}
    far, kids = {root: 0.0}, collections.defaultdict(list)
    for v in sorted(depth, key=depth.get):
        if parent[v] is not None:
            far[v] = far[parent[v]] + math.dist(nodes[v][:3], nodes[parent[v]][:3]) * 0.5
            kids[parent[v]].append(v)
    for own in kids.values():
        own.sort(key=lambda v: (-nodes[v][3], v))
    return parent, depth, far, kids


def check(spark, links, nodes, root):
    frame = spark.createDataFrame([(a, b) for a, b in links] + [(b, a) for a, b in links], "src int, dst int")
    places = spark.createDataFrame([(0, v, *p) for v, p in nodes.items()], "case_id int, node int, p0 double, p1 double, p2 double, radius_mm double")
    rooted = trees.rooted_trees(frame, places, spark.createDataFrame([(0, root)], "case_id int, node int")).cache()
    rows = {r.node: r for r in rooted.collect()}
    parent, depth, far, kids = plain(links, nodes, root)
    assert {v: (r.parent, r.depth) for v, r in rows.items()} == {v: (parent[v], depth[v]) for v in depth}
    assert all(math.isclose(r.distance_mm, far[v], abs_tol=1e-9) for v, r in rows.items())

    main, at = [root], root
    while kids[at]:
        at = kids[at][0]
        main.append(at)
    assert {v for v, r in rows.items() if r.on_main} == set(main)
    major = next((v for v in main if sum(nodes[c][3] >= 0.35 * nodes[v][3] for c in kids[v]) >= 2), None)
    assert [r.node for r in trees.major_bifurcations(rooted).collect()] == ([] if major is None else [major])

    def below(v):
        return {v}.union(*(below(c) for c in kids[v]))

    starts = rooted.select("root", "node")
    got = collections.defaultdict(set)
    for r in trees.subtrees(rooted, starts).collect():
        got[r.start].add(r.node)
    assert got == {v: below(v) for v in depth}
    for r in trees.directions(rooted, starts, 3).collect():
        end = r.node
        for _ in range(3):
            end = kids[end][0] if kids[end] else end
        gap = [b - a for a, b in zip(nodes[r.node][:3], nodes[end][:3], strict=True)]
        size = math.hypot(*gap) or 1.0
        assert all(math.isclose(a, b / size, abs_tol=1e-9) for a, b in zip((r.d0, r.d1, r.d2), gap, strict=True))


def test_forests_and_rings(spark):
    rng = random.Random(31)
    for ring in (0, 3):
        links = {(rng.randrange(max(0, k - 4), k), k) for k in range(1, 40)}
        while len(links) < 39 + ring:
            links.add(tuple(sorted(rng.sample(range(40), 2))))
        # a part that the root doesn't reach, and a ring of its own
        links |= {(50, 51), (51, 52), (60, 61), (61, 62), (60, 62)}
        nodes = {v: (*(float(rng.randrange(9)) for _ in range(3)), rng.randrange(1, 5) / 2) for v in [*range(40), 50, 51, 52, 60, 61, 62]}
        check(spark, sorted(links), nodes, 17)


def test_alone(spark):
    """A root without links is a tree of its own; no roots, no trees."""
    none = spark.createDataFrame([], "src int, dst int")
    nodes = spark.createDataFrame([(0, 7, 0.0, 0.0, 0.0, 1.0)], "case_id int, node int, p0 double, p1 double, p2 double, radius_mm double")
    one = trees.rooted_trees(none, nodes, nodes.select("case_id", "node")).collect()
    assert [(r.node, r.parent, r.depth, r.first, r.size) for r in one] == [(7, None, 0, 0, 1)]
    assert trees.rooted_trees(none, nodes, nodes.select("case_id", "node").limit(0)).count() == 0


def test_long_line(spark, monkeypatch):
    """Rounds grow with the logarithm of a line's length."""
    names = collections.Counter()
    counted = components.written
    monkeypatch.setattr(components, "written", lambda df, name="table": (names.update([name]), counted(df, name))[1])
    n = 5000
    down = spark.range(n - 1).selectExpr("cast(id as int) as src", "cast(id + 1 as int) as dst")
    links = down.unionByName(down.selectExpr("dst as src", "src as dst"))
    tours = {r.node: r for r in trees.euler_tours(links, spark.createDataFrame([(0,)], "node int")).collect()}
    assert len(tours) == n and all((r.depth, r.first, r.size) == (v, v, n - v) for v, r in tours.items())
    assert names["cells"] < 20
    names.clear()
    found = {r.node: r for r in graph.bfs(links, spark.createDataFrame([(1, 30)], "path_id int, node int")).collect()}
    assert len(found) == n and all(r.depth == abs(v - 30) for v, r in found.items())
    assert names["cells"] < 20
