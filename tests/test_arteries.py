"""The left split beside a plain version, on random trees with gaps."""

import math
import random

import pytest

from vesselspark.operators import arteries

SEGMENTS = "case_id int, seg_id long, start long, end long, length_mm double, radius_mm double, n_points long, mid1 double"
JUNCTIONS = "case_id int, node long, p0 double, p1 double, p2 double, radius_mm double"
SIZE = 60


def plain(segments, places, mask):
    """{seg: name} of one case, or nothing."""
    links = {}
    for s, (a, b, *_) in sorted(segments.items()):
        links.setdefault(a, []).append((s, b))
        links.setdefault(b, []).append((s, a))
    degree = {j: len(x) for j, x in links.items()}
    lone = [j for j in links if degree[j] == 1]
    if not lone:
        return {}

    def straight(a, b):
        n = max(3, int(math.dist(a, b)))
        return all(tuple(min(SIZE - 1, max(0, round(x + k / (n - 1) * (y - x)))) for x, y in zip(a, b, strict=True)) in mask for k in range(n))

    def total(start, cut):
        seen, todo, length = {cut}, [start], 0.0
        while todo:
            j = todo.pop()
            if j in seen:
                continue
            seen.add(j)
            for s, o in links[j]:
                if o not in seen:
                    length += segments[s][2] if s >= 0 else 0
                    todo.append(o)
        return length

    here = min(lone, key=lambda j: (-places[j][0], j))
    walked, main = {here}, set()
    for _ in range(50):
        for j in sorted(places):
            if j in links and j not in walked and j not in {o for _, o in links[here]} and math.dist(places[here][:3], places[j][:3]) * 0.5 < 8 and straight(places[here][:3], places[j][:3]):
                links[here].append((-1, j))
                links[j].append((-1, here))
        ways = sorted(((s, o) for s, o in links[here] if o not in walked), key=lambda w: (w[0] < 0, w[0], w[1]))
        if not ways:
            return {}
        if len(ways) == 1:
            judged = [(*ways[0], 0.0, True)]
        else:
            judged = []
            for s, o in ways:
                small = s >= 0 and segments[s][2] < 10 and degree.get(o, 0) <= 1
                length = segments[s][2] if small else total(o, here)
                judged.append((s, o, length, not small and length >= 10))
        majors = [w for w in judged if w[3]]
        if len(majors) >= 2:
            break
        for s, o, *_ in judged:
            main |= {s} if s >= 0 else set()
            walked.add(o)
        here = majors[0][1] if majors else max(judged, key=lambda w: w[2])[1]
    else:
        return {}
    thick = sorted(majors, key=lambda w: -(segments[w[0]][3] if w[0] >= 0 else places[w[1]][3]))[:2]
    if any(s >= 0 and segments[s][4] < 5 for s, *_ in thick):
        return {}
    names = {s: "LM" if s in main else "LAD" if x[5] <= places[here][1] else "LCx" for s, x in segments.items()}
    for s in sorted(segments):
        if s not in main:
            other = "LCx" if names[s] == "LAD" else "LAD"
            if {names[t] for j in segments[s][:2] for t, _ in links[j] if t >= 0 and t != s and t not in main} == {other}:
                names[s] = other
    return names


@pytest.mark.parametrize("with_mask", [True, False])
def test_split(spark, with_mask):
    rng = random.Random(5)
    segments, places, masks, want = [], [], [], {}
    for case in range(14):
        n = rng.choice([3, 8, 15, 25])
        at = {0: (50.0, 30.0, 30.0, 1.0)}
        for k in range(1, n):
            px, py, pz, _ = at[max(0, k - 1 - rng.randrange(3))]
            at[k] = (px - (rng.randrange(1, 5) if k > 1 else 17), py + rng.randrange(-6, 7), pz + rng.randrange(-6, 7), rng.random() * 2)
        own = {}
        for k in range(1, n):
            if k < 4 or rng.random() < 0.85:
                own[k] = (max(0, k - 1 - (rng.randrange(3) if k > 3 else 0)), k, rng.random() * rng.choice([3, 14, 30]), rng.random() * 2, rng.choice([3, 9, 30]), at[k][1] + rng.randrange(-4, 5))
        if case % 3 == 0 and n > 8:
            own[100] = (3, 6, 4.0, 1.0, 9, 30.0)
        used = {j for a, b, *_ in own.values() for j in (a, b)}
        at = {j: p for j, p in at.items() if j in used}
        mask = set()
        for a in at.values():
            for b in at.values():
                if rng.random() < 0.3:
                    steps = 4 * max(1, math.ceil(math.dist(a[:3], b[:3])))
                    mask |= {tuple(round(x + k / steps * (y - x)) for x, y in zip(a[:3], b[:3], strict=True)) for k in range(steps + 1)}
        want |= {(case, s): name for s, name in plain(own, at, mask if with_mask else set()).items()}
        segments += [(case, s, *map(int, x[:2]), *map(float, x[2:4]), x[4], float(x[5])) for s, x in own.items()]
        places += [(case, j, *map(float, p)) for j, p in at.items()]
        masks += [(case, *p) for p in mask]
    shapes = spark.createDataFrame([(c, SIZE, SIZE, SIZE) for c in range(14)], "case_id int, n0 int, n1 int, n2 int")
    mask = spark.createDataFrame(masks, "case_id int, a0 int, a1 int, a2 int") if with_mask else None
    rows = arteries.split_left(spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(places, JUNCTIONS), mask, shapes).collect()
    got = {(r.case_id, r.seg_id): r.artery_name for r in rows}
    assert len(got) == len(rows) and got == want
    assert {"LM", "LAD", "LCx"} <= set(got.values()) and all(r.confidence == 0.7 for r in rows)


def test_lines_that_end_outside(spark, monkeypatch):
    """only junctions in the mask are spread over cells; of the others no line is cut into places. Places lie between voxels and beyond the grid too."""
    spread, real = [], arteries.vox.near_pairs
    monkeypatch.setattr(arteries.vox, "near_pairs", lambda a, b, radius: (spread.append(b.count()), real(a, b, radius))[1])
    rng = random.Random(3)
    at = {j: tuple(rng.randrange(-1, 26) / 2 for _ in range(3)) for j in range(40)}
    mask = {(a, b, c) for a in range(12) for b in range(12) for c in range(12) if rng.random() < 0.7}
    inside = lambda p: tuple(min(11, max(0, round(x))) for x in p) in mask

    def straight(a, b):
        n = max(3, int(math.dist(a, b)))
        return all(inside([x + k / (n - 1) * (y - x) for x, y in zip(a, b, strict=True)]) for k in range(n))

    want = {(a, b) for a in at for b in at if a != b and math.dist(at[a], at[b]) * 0.5 < 8 and straight(at[a], at[b])}
    shapes = spark.createDataFrame([(1, 12, 12, 12)], "case_id int, n0 int, n1 int, n2 int")
    junctions = spark.createDataFrame([(1, j, *p, 1.0) for j, p in at.items()], JUNCTIONS)
    rows = arteries.clear_pairs(junctions, spark.createDataFrame([(1, *p) for p in mask], "case_id int, a0 int, a1 int, a2 int"), shapes).collect()
    assert {(r.here, r.other) for r in rows} == want and len(rows) == len(want) > 0
    assert spread == [sum(map(inside, at.values()))] and spread[0] < len(at)
