"""Voxel tables: dense volumes (case_id, a0, a1, a2, value), sparse masks (case_id, a0, a1, a2) and shapes (case_id, n0, n1, n2)."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..components import connected_components
from ..session import drop_written, written
from .profile import gaussian_weights

AXES = ["a0", "a1", "a2"]
KEY = ["case_id", *AXES]
ALL26 = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
#: More than any squared distance in a grid.
FAR = 1 << 40
FACES = [o for o in ALL26 if sum(map(abs, o)) == 1]


def offsets(steps: list[tuple[int, int, int]]) -> Column:
    return F.array(*(F.struct(*(F.lit(s).alias(f"d{k}") for k, s in enumerate(o))) for o in steps))


def ball(radius: float) -> list[tuple[int, int, int]]:
    r = math.ceil(radius)
    return [o for o in itertools.product(range(-r, r + 1), repeat=3) if sum(x * x for x in o) <= radius * radius]


def moved(rows: DataFrame, steps: list[tuple[int, int, int]], keep: list[str] | None = None) -> DataFrame:
    """Each row at each place it reaches by a step, with b0, b1, b2 where it came from; other columns in keep."""
    keep = keep or []
    rows = rows.select(*KEY, *keep, F.explode(offsets(steps)).alias("o"))
    return rows.select("case_id", *((F.col(a) + F.col(f"o.d{k}")).alias(a) for k, a in enumerate(AXES)), *(F.col(a).alias(f"b{k}") for k, a in enumerate(AXES)), *keep)


def inside(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """Rows that lie in their case's grid."""
    out = rows.join(shapes.select("case_id", "n0", "n1", "n2"), "case_id")
    return out.filter(" and ".join(f"a{k} >= 0 and a{k} < n{k}" for k in range(3))).drop("n0", "n1", "n2")


# --- values


CHUNK, CHUNKS = 16, ["__c0", "__c1", "__c2"]


def with_chunks(voxels: DataFrame) -> DataFrame:
    """Voxels with the chunk of CHUNK x CHUNK x CHUNK that each lies in."""
    return voxels.withColumns({c: F.floor(F.col(a) / CHUNK) for a, c in zip(AXES, CHUNKS, strict=True)})


def over_chunks(boxes: DataFrame) -> DataFrame:
    """Boxes (low0..high2), a row for each chunk they touch; those with a low end over the high one touch none."""
    for k, c in enumerate(CHUNKS):
        boxes = boxes.filter(f"low{k} <= high{k}").withColumn(c, F.explode(F.sequence(F.floor(F.col(f"low{k}") / CHUNK), F.floor(F.col(f"high{k}") / CHUNK))))
    return boxes


def zscore(voxels: DataFrame, limit: float = 3.0) -> DataFrame:
    """Per case, with the population deviation floored at 1e-6, clipped."""
    stats = voxels.groupBy("case_id").agg(F.avg("value").alias("m"), F.greatest(F.stddev_pop("value"), F.lit(1e-6)).alias("s"))
    z = (F.col("value") - F.col("m")) / F.col("s")
    return voxels.join(stats, "case_id").withColumn("z", F.greatest(F.lit(-limit), F.least(F.lit(limit), z))).drop("m", "s")


def reorient(voxels: DataFrame, shapes: DataFrame) -> DataFrame:
    """Shapes also has axes (for each new axis the old one) and flips; a flip counts from the far end."""
    rows = voxels.join(shapes, "case_id")
    old, size = F.array(*AXES), F.array("n0", "n1", "n2")
    at = lambda k: F.get(old, F.col("axes")[k])
    new = [F.when(F.col("flips")[k], F.get(size, F.col("axes")[k]) - 1 - at(k)).otherwise(at(k)).alias(f"a{k}") for k in range(3)]
    return rows.select("case_id", *new, "value")


def take_slice(voxels: DataFrame, shapes: DataFrame, axis: int, index: int) -> DataFrame:
    """V1: the plane axis = index, the index moved into the grid."""
    at = F.greatest(F.lit(0), F.least(F.lit(index), F.col(f"n{axis}") - 1))
    return voxels.join(shapes.select("case_id", at.alias("at")), "case_id").filter(F.col(f"a{axis}") == F.col("at")).drop("at")


def in_boxes(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Voxels in each box (case_id, box_id, low0..high2, ends included): an equi-join on the chunks that a box touches, then the box itself."""
    rows = with_chunks(voxels).join(over_chunks(boxes), ["case_id", *CHUNKS])
    return rows.filter(" and ".join(f"a{k} between low{k} and high{k}" for k in range(3))).select("box_id", *voxels.columns)


def blur(rows: DataFrame, shapes: DataFrame, sigma: float, axes: tuple[int, ...] = (0, 1, 2), value: str = "value") -> DataFrame:
    """V7: Gaussian blur, an axis at a time, mirrored at the grid's ends as often as a kernel reaches past them; absent voxels are 0."""
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    taps = F.array(*(F.struct(F.lit(k - radius).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(weights)))
    sizes = shapes.select("case_id", "n0", "n1", "n2")
    rows = rows.select(*KEY, F.col(value).cast("double").alias("value")).join(sizes, "case_id")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for axis in axes:
        a, n = F.col(f"a{axis}"), F.col(f"n{axis}")
        # a voxel's mirror images repeat every 2 n places; those within radius of the grid count: in a grid not narrower than that, one past an end that is nearer than radius
        turns = F.sequence(-F.ceil(F.lit(radius) / (2 * n)) - 1, F.ceil(F.lit(radius) / (2 * n)) + 1)
        images = F.flatten(F.transform(turns, lambda m: F.array(a + 2 * n * m, -1 - a + 2 * n * m)))
        all_images = F.filter(images, lambda i: (i >= -radius) & (i < n + radius))
        images = F.when(n < radius, all_images).otherwise(F.array_compact(F.array(a, F.when(a < radius, -1 - a), F.when(a >= n - radius, 2 * n - 1 - a))))
        # whole lines go to a task, which adds up what their voxels spread; only voxels are sent
        spread = rows.repartition(parts, "case_id", *(x for k, x in enumerate(AXES) if k != axis))
        spread = spread.withColumn("image", F.explode(images)).withColumn("t", F.explode(taps))
        spread = spread.withColumn(f"a{axis}", (F.col("image") - F.col("t.k")).cast("int")).filter(f"a{axis} >= 0 and a{axis} < n{axis}")
        rows = spread.groupBy(*KEY, "n0", "n1", "n2").agg(F.sum(F.col("value") * F.col("t.w")).alias("value"))
    return rows.select(*KEY, "value")


def smooth_mask(mask: DataFrame, shapes: DataFrame, sigma: float) -> DataFrame:
    """V7: blurred and cut at 0.5; where a case loses over 20 % of its voxels, with half the sigma instead."""
    flat = mask.withColumn("value", F.lit(1.0))
    first = blur(flat, shapes, sigma).filter("value >= 0.5").select(KEY)
    before = mask.groupBy("case_id").agg(F.count("*").alias("n"))
    after = first.groupBy("case_id").agg(F.count("*").alias("m"))
    weak = before.join(after, "case_id", "left").filter(F.coalesce("m", F.lit(0)) < 0.8 * F.col("n")).select("case_id")
    again = blur(flat.join(weak, "case_id", "left_semi"), shapes, sigma / 2).filter("value >= 0.5").select(KEY)
    return first.join(weak, "case_id", "left_anti").unionByName(again)


def corners(at: list[Column], sizes: list[Column]) -> Column:
    """The grid corners around a fractional place (eight in three axes), moved into the grid, with their weights."""
    low = [F.floor(F.greatest(F.lit(0.0), F.least(a, n - 1.0))) for a, n in zip(at, sizes, strict=True)]
    part = [F.greatest(F.lit(0.0), F.least(a, n - 1.0)) - b for a, n, b in zip(at, sizes, low, strict=True)]
    out = []
    for o in itertools.product((0, 1), repeat=len(at)):
        place = [F.least(b + s, n - 1).cast("int").alias(f"a{k}") for k, (b, s, n) in enumerate(zip(low, o, sizes, strict=True))]
        weight = [p if s else 1 - p for s, p in zip(o, part, strict=True)]
        out.append(F.struct(*place, math.prod(weight[1:], start=weight[0]).alias("w")))
    return F.array(*out)


#: Cells of an axis that a block of values covers.
BLOCK, BLOCKS = 8, ["__b0", "__b1", "__b2"]


def value_blocks(voxels: DataFrame) -> DataFrame:
    """(case_id, __b0, __b1, __b2, held): values by place in blocks of BLOCK cells an axis, with the places past their high ends, so that all corners of a cell lie in one block.

    Absent voxels and nulls are 0, those past the last one left out. A voxel has one row; those of negative place are in no cell.
    """
    rows = voxels.filter("a0 >= 0 and a1 >= 0 and a2 >= 0").select(*KEY, F.coalesce("value", F.lit(0.0)).alias("value"))
    for a, b in zip(AXES, BLOCKS, strict=True):
        rows = rows.withColumn(b, F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col(a) - 1) / BLOCK)), F.floor(F.col(a) / BLOCK))))
    inner = [(F.col(a) - F.col(b) * BLOCK).cast("int") for a, b in zip(AXES, BLOCKS, strict=True)]
    rows = rows.groupBy("case_id", *BLOCKS).agg(F.array_sort(F.collect_list(F.struct(place_in_block(inner).alias("at"), "value"))).alias("own"))
    step = lambda x, i: F.concat(F.array_repeat(F.lit(0.0), x["at"] - F.when(i > 0, F.get("own", i - 1)["at"]).otherwise(-1) - 1), F.array(x["value"]))
    return rows.select("case_id", *BLOCKS, F.flatten(F.transform("own", step)).alias("held"))


def place_in_block(at: list[Column]) -> Column:
    return (at[0] * (BLOCK + 1) + at[1]) * (BLOCK + 1) + at[2]


def sample_blocks(points: DataFrame, blocks: DataFrame, shapes: DataFrame, id_col: str = "point_id", how: str = "inner") -> DataFrame:
    """V5: trilinear samples at points (case_id, id, p0, p1, p2) in value_blocks. A point is one row and meets the one block of its cell. how: "left" keeps
    points of cases without a shape, their value is null."""
    rows = points.join(shapes.select("case_id", "n0", "n1", "n2"), "case_id", how)
    at = [F.greatest(F.lit(0.0), F.least(F.col(f"p{k}"), F.col(f"n{k}") - 1.0)) for k in range(3)]
    rows = rows.select("case_id", id_col, *(F.when(F.col("n0").isNotNull(), a).alias(f"p{k}") for k, a in enumerate(at)), *(F.col(f"n{k}") for k in range(3)))
    rows = rows.withColumns({b: F.floor(F.floor(f"p{k}") / BLOCK) for k, b in enumerate(BLOCKS)})
    rows = rows.join(blocks, ["case_id", *BLOCKS], "left")
    low = [F.floor(f"p{k}") for k in range(3)]
    part = [F.col(f"p{k}") - b for k, b in enumerate(low)]
    inner = [[(F.least(b + s, F.col(f"n{k}") - 1) - F.col(BLOCKS[k]) * BLOCK).cast("int") for s in (0, 1)] for k, b in enumerate(low)]
    terms = []
    for o in itertools.product((0, 1), repeat=3):
        weight = math.prod([p if s else 1 - p for s, p in zip(o, part, strict=True)], start=F.lit(1.0))
        terms.append(weight * F.coalesce(F.get("held", place_in_block([i[s] for s, i in zip(o, inner, strict=True)])), F.lit(0.0)))
    return rows.select("case_id", id_col, sum(terms[1:], terms[0]).alias("value"))


def sample_points(points: DataFrame, voxels: DataFrame, shapes: DataFrame, id_col: str = "point_id") -> DataFrame:
    """V5: trilinear samples at points (case_id, id, p0, p1, p2); absent voxels are 0."""
    return sample_blocks(points, value_blocks(voxels), shapes, id_col)


def resample(voxels: DataFrame, shapes: DataFrame, spacing: tuple[float, float, float], target: tuple[float, float, float]) -> DataFrame:
    """V4: linear resampling onto round(shape x spacing / target) voxels, edges held; absent voxels count 0, and a place with no voxel around it is left out.

    Lines along the last axis are sent whole: a new line is made of the four old ones around it. A voxel has one row.
    """
    new = [F.rint(F.col(f"n{k}") * (s / t)).cast("int") for k, (s, t) in enumerate(zip(spacing, target, strict=True))]
    grid = shapes.select("case_id", "n0", "n1", "n2", *(n.alias(f"m{k}") for k, n in enumerate(new)))
    # dealt by slice: shapes are a row a case, and all of the new grid would be made in the task that holds them
    parts = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = grid.withColumn("g0", F.explode(F.sequence(F.lit(0), F.col("m0") - 1))).repartition(parts, "case_id", "g0")
    grid = grid.withColumn("g1", F.explode(F.sequence(F.lit(0), F.col("m1") - 1)))
    at = lambda k, g: (g + 0.5) * (F.col(f"n{k}") / F.col(f"m{k}")) - 0.5
    around = corners([at(k, F.col(f"g{k}")) for k in (0, 1)], [F.col("n0"), F.col("n1")])

    # places of a line by number, null where it has no voxel
    line = voxels.filter("a2 >= 0").groupBy("case_id", "a0", "a1").agg(F.array_sort(F.collect_list(F.struct(F.col("a2").cast("int").alias("a2"), "value"))).alias("own"))
    absent = F.when(F.lit(False), F.get("own", F.lit(0)))
    step = lambda x, i: F.concat(F.array_repeat(absent, x["a2"] - F.when(i > 0, F.get("own", i - 1)["a2"]).otherwise(-1) - 1), F.array(x))
    line = line.select("case_id", "a0", "a1", F.flatten(F.transform("own", step)).alias("line"))

    # many rows for each of the grid's slices, which the planner takes for one: no side to broadcast
    rows = grid.select("case_id", "g0", "g1", "n2", "m2", F.inline(around)).hint("merge").join(line, ["case_id", "a0", "a1"])
    rows = rows.groupBy("case_id", "g0", "g1", "n2", "m2").agg(F.collect_list(F.struct("w", "line")).alias("lines"))

    def blended(g: Column) -> Column:
        """The terms of a place: a line's weight times the place's own between two voxels of it."""
        ends = corners([at(2, g)], [F.col("n2")])
        term = lambda one, end: F.when(F.get(one["line"], end["a0"]).isNotNull(), F.struct((one["w"] * end["w"] * F.get(one["line"], end["a0"])["value"]).alias("x")))
        return F.array_compact(F.flatten(F.transform(ends, lambda end: F.transform("lines", lambda one: term(one, end)))))

    rows = rows.select("case_id", "g0", "g1", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("m2") - 1), blended)).alias("g2", "terms")).filter("size(terms) > 0")
    known = F.filter("terms", lambda t: t["x"].isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, t: s + t["x"]))
    return rows.select("case_id", "g0", "g1", "g2", total.alias("value")).toDF(*KEY, "value")


def nearest_value(points: DataFrame, voxels: DataFrame, value: str, default: Column | None = None) -> DataFrame:
    """V6: the value at the rounded place of each point, default (0) where there is none."""
    at = points.withColumns({f"a{k}": F.rint(f"p{k}").cast("int") for k in range(3)})
    return at.join(voxels.select(*KEY, value), KEY, "left").withColumn(value, F.coalesce(value, default if default is not None else F.lit(0)))


def crop_wide(voxels: DataFrame, shapes: DataFrame, spacing: float = 0.5, wide_mm: float = 280.0, target_mm: float = 220.0, sigma: float = 5.0) -> DataFrame:
    """V3: where the in-plane extent is wide, a window of target_mm around the brightest place of the blurred mean of the middle slices."""
    size = max(1, round(target_mm / spacing))
    wide = shapes.filter(F.greatest("n0", "n1") * spacing > wide_mm)
    middle = F.col("a2").between(F.floor(F.col("n2") * 0.4), F.floor(F.col("n2") * 0.6))
    bright = F.greatest(F.lit(100.0), F.least(F.lit(700.0), F.col("value"))) - 100
    plane = voxels.join(wide, "case_id").filter(middle).groupBy("case_id", "a0", "a1").agg(F.avg(bright).alias("value")).withColumn("a2", F.lit(0))
    blurred = blur(plane, shapes, sigma, (0, 1))
    centre = blurred.groupBy("case_id").agg(F.min_by(F.struct("a0", "a1"), F.struct(-F.col("value"), F.col("a0"), F.col("a1"))).alias("c"))
    low = lambda k: F.greatest(F.lit(0), F.least(F.col(f"c.a{k}") - size // 2, F.col(f"n{k}") - size)).alias(f"l{k}")
    window = centre.join(shapes, "case_id").select("case_id", low(0), low(1))
    rows = voxels.join(window, "case_id", "left")
    keep = F.col("l0").isNull() | (F.col("a0").between(F.col("l0"), F.col("l0") + size - 1) & F.col("a1").between(F.col("l1"), F.col("l1") + size - 1))
    return rows.filter(keep).select("case_id", (F.col("a0") - F.coalesce("l0", F.lit(0))).alias("a0"), (F.col("a1") - F.coalesce("l1", F.lit(0))).alias("a1"), "a2", "value")


# --- neighbourhoods


def neighbour_count(mask: DataFrame, steps: list[tuple[int, int, int]] = FACES) -> DataFrame:
    """Mask voxels with n, how many of their neighbours are in the mask. Counts are summed before they meet the mask."""
    hits = moved(mask, steps).groupBy(*KEY).agg(F.count("*").alias("n"))
    return mask.select(KEY).join(hits.hint("merge"), KEY, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def surface(mask: DataFrame) -> DataFrame:
    """V8: foreground voxels that lack a face neighbour; outside the grid is background."""
    return neighbour_count(mask).filter("n < 6").select(KEY)


def erode(mask: DataFrame) -> DataFrame:
    return neighbour_count(mask).filter("n = 6").select(KEY)


def dilate(mask: DataFrame, shapes: DataFrame) -> DataFrame:
    return mask.select(KEY).union(inside(moved(mask, FACES).select(KEY), shapes)).distinct()


def close_holes(mask: DataFrame, shapes: DataFrame, times: int = 1) -> DataFrame:
    """V9: dilations, then erosions, outside counting as background; a case whose voxels more than double keeps its mask."""
    out = mask.select(KEY)
    for _ in range(times):
        out = dilate(out, shapes)
    for _ in range(times):
        out = erode(out)
    before = mask.groupBy("case_id").agg(F.count("*").alias("n"))
    after = out.groupBy("case_id").agg(F.count("*").alias("m"))
    grown = before.join(after, "case_id").filter("m > 2 * n").select("case_id")
    return out.join(grown, "case_id", "left_anti").unionByName(mask.select(KEY).join(grown, "case_id", "left_semi"))


def near_pairs(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs of rows of a (case_id, id_a, x0, x1, x2) and b (case_id, id_b, y0, y1, y2) within radius, with their distance: points
    fall into cells of side radius, b's cells spread over the 27 around, an equi-join on cells, then the exact distance."""
    cell = lambda p: [F.floor(F.col(f"{p}{k}") / radius).cast("long").alias(f"c{k}") for k in range(3)]
    left = a.select("*", *cell("x"))
    # 27 rows for each of b, which the planner takes for one: no side to broadcast
    spread = b.select("*", *cell("y")).withColumn("o", F.explode(offsets([(0, 0, 0), *ALL26]))).hint("merge")
    right = spread.withColumns({f"c{k}": F.col(f"c{k}") + F.col(f"o.d{k}") for k in range(3)}).drop("o")
    gap = F.sqrt(sum(((F.col(f"x{k}") - F.col(f"y{k}")) ** 2 for k in range(1, 3)), (F.col("x0") - F.col("y0")) ** 2))
    return left.join(right, ["case_id", "c0", "c1", "c2"]).withColumn("distance", gap).filter(F.col("distance") <= radius).drop("c0", "c1", "c2")


def nearest_within(a: DataFrame, b: DataFrame, radius: float, fine: float = 8.0) -> DataFrame:
    """(case_id, id_a, distance, id_b): the nearest of b for each row of a that has one within radius.

    Beyond a fine radius b is looked at through its occupied cells of a quarter of the radius, whose number around a point doesn't grow with the
    radius: a point keeps the cells that may hold its nearest, by the distance of their centres, and only their points are compared.
    """
    if radius <= fine:
        pairs = near_pairs(a, b, radius)
    else:
        side = radius / 4
        reach = side * math.sqrt(3) / 2
        held = b.select("case_id", F.struct(*(F.floor(F.col(f"y{k}") / side).alias(f"g{k}") for k in range(3))).alias("cell"), "id_b", "y0", "y1", "y2")
        cells = held.select("case_id", F.col("cell").alias("id_b")).distinct().select("*", *(((F.col(f"id_b.g{k}") + 0.5) * side).alias(f"y{k}") for k in range(3)))
        around = near_pairs(a, cells, radius + reach).groupBy("case_id", "id_a", "x0", "x1", "x2").agg(F.collect_list(F.struct("distance", "id_b")).alias("cells"))
        least = F.array_min("cells")["distance"] + 2 * reach
        kept = around.select("case_id", "id_a", "x0", "x1", "x2", F.explode(F.filter("cells", lambda c: c["distance"] <= least)).alias("c"))
        pairs = kept.withColumn("cell", F.col("c.id_b")).drop("c").join(held, ["case_id", "cell"])
        gap = F.sqrt(sum(((F.col(f"x{k}") - F.col(f"y{k}")) ** 2 for k in range(1, 3)), (F.col("x0") - F.col("y0")) ** 2))
        pairs = pairs.withColumn("distance", gap).filter(F.col("distance") <= radius)
    return pairs.groupBy("case_id", "id_a").agg(F.min(F.struct("distance", "id_b")).alias("m")).select("case_id", "id_a", "m.distance", "m.id_b")


def nearest(a: DataFrame, b: DataFrame, first_radius: float = 2.0) -> DataFrame:
    """For each row of a (case_id, id_a, x0..x2) the nearest of b (case_id, id_b, y0..y2), ties to the smaller id_b; rows of cases that b lacks are left out.

    The radius doubles each round for the points still without a hit, so a hit within the radius is the nearest there is. A round writes one table, of the points it looked at with
    what they hit; those without a hit are read from it by the next round.
    """
    columns = ["case_id", "id_a", *(f"x{k}" for k in range(3))]
    left = written(a.select(columns).join(b.select("case_id").distinct(), "case_id", "left_semi"), "left")
    right, out, radius = written(b, "right"), None, first_radius
    while True:
        looked = written(left.join(nearest_within(left, right, radius).hint("merge"), ["case_id", "id_a"], "left"), "looked")
        hits = looked.filter("distance is not null").select("case_id", "id_a", "distance", "id_b")
        out = hits if out is None else out.unionByName(hits)
        left, radius = looked.filter("distance is null").select(columns), radius * 2
        if left.isEmpty():
            return out


def as_points(rows: DataFrame, prefix: str, id_name: str) -> DataFrame:
    return rows.select("case_id", F.struct(*AXES).alias(id_name), *(F.col(a).cast("double").alias(f"{prefix}{k}") for k, a in enumerate(AXES)))


def along_axis(rows: DataFrame, axis: int) -> DataFrame:
    """One axis of the distance transform: rows (case_id, a0..a2, n0..n2, sq) with sq lowered to the least of sq at each place of the voxel's run along the axis plus the
    square of the way there, and of the squared ways to the background next to the run.

    A run is a stretch of neighbouring mask voxels on a line; what lies behind the background at its end is never nearer. A place farther off than what a voxel has cannot lower it,
    so a voxel looks at as many places as its distance.
    """
    line = ["case_id", *(x for k, x in enumerate(AXES) if k != axis)]
    rows = rows.withColumn("run", F.col(f"a{axis}") - F.row_number().over(Window.partitionBy(*line).orderBy(f"a{axis}")))
    runs = rows.groupBy(*line, "run").agg(F.array_sort(F.collect_list(F.struct(f"a{axis}", "sq"))).alias("places"), *(F.first(f"n{k}").alias(f"n{k}") for k in range(3)))
    first, n = F.col("places")[0][f"a{axis}"], F.size("places")
    runs = runs.withColumns({"first": first, "n": n, "sq": F.transform("places", lambda p: p["sq"])})
    far = F.lit(FAR)

    def lowered(i: Column) -> Column:
        low = F.when(F.col("first") > 0, (i + 1) * (i + 1)).otherwise(far)
        high = F.when(F.col("first") + F.col("n") < F.col(f"n{axis}"), (F.col("n") - i) * (F.col("n") - i)).otherwise(far)
        own = F.least(F.get("sq", i).cast("long"), low.cast("long"), high.cast("long"))
        reach = F.least(F.ceil(F.sqrt(own)).cast("int"), F.col("n"))
        near = F.transform(F.sequence(F.greatest(F.lit(0), i - reach), F.least(F.col("n") - 1, i + reach)), lambda j: F.get("sq", j) + (i - j) * (i - j))
        return F.least(own, F.array_min(near))

    at = F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((F.col("first") + i).alias("at"), lowered(i).alias("sq")))).alias("x")
    out = runs.select(*line, "n0", "n1", "n2", at)
    return out.select("case_id", *(F.col("x.at").alias(x) if k == axis else F.col(x) for k, x in enumerate(AXES)), "n0", "n1", "n2", F.col("x.sq").alias("sq"))


def distance_transform(mask: DataFrame, shapes: DataFrame) -> DataFrame:
    """Mask voxels with the exact distance to the nearest background voxel of the grid; mask voxels of a case without background are left out.
    An axis at a time, a shuffle each: along the first axis squared distances to the ends of runs, then lower envelopes of them along the others."""
    rows = mask.select(KEY).distinct().join(shapes.select("case_id", "n0", "n1", "n2"), "case_id").withColumn("sq", F.lit(FAR))
    for axis in (2, 1, 0):
        rows = along_axis(rows, axis)
    return rows.filter(F.col("sq") < FAR).select(*KEY, F.sqrt("sq").alias("distance"))


def components(mask: DataFrame, neighbours: int = 26) -> DataFrame:
    """Mask voxels with component, the first voxel of theirs in scan order."""
    steps = [o for o in (ALL26 if neighbours == 26 else FACES) if o > (0, 0, 0)]
    key = lambda names: F.struct("case_id", *(F.col(n).alias(f"a{k}") for k, n in enumerate(names)))
    edges = moved(mask, steps).join(mask.select(KEY).hint("merge"), KEY, "left_semi").select(key(AXES).alias("dst"), key(["b0", "b1", "b2"]).alias("src"))
    return connected_components(edges, mask.select(key(AXES).alias("node"))).select("node.*", F.col("component"))


def component_sizes(labelled: DataFrame) -> DataFrame:
    """(case_id, component, size, place): place 1 is the largest, ties to the first in scan order."""
    rows = labelled.groupBy("case_id", "component").agg(F.count("*").alias("size"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("size"), "component")))


def pooled_sizes(labelled: DataFrame, least: int = 100) -> DataFrame:
    """(case_id, component, size, place, n_components): the components of `least` voxels or more, largest first, and after them one row without component and place for all smaller ones of a case."""
    sizes = component_sizes(labelled)
    large = sizes.filter(F.col("size") >= least).select("case_id", "component", "size", "place", F.lit(1).cast("long").alias("n_components"))
    none = lambda c: F.when(F.lit(False), F.first(c)).alias(c)
    rest = sizes.filter(F.col("size") < least).groupBy("case_id").agg(none("component"), F.sum("size").alias("size"), none("place"), F.count("*").alias("n_components"))
    return large.unionByName(rest)


def protected(sizes: DataFrame, trees: int = 3, share: float = 0.05) -> DataFrame:
    """The largest components that hold a share of the case's voxels."""
    total = F.sum("size").over(Window.partitionBy("case_id"))
    return sizes.withColumn("least", F.greatest(F.lit(1), F.floor(total * share))).filter((F.col("place") <= trees) & (F.col("size") >= F.col("least"))).drop("least")


def remove_small(labelled: DataFrame, least: int = 200) -> DataFrame:
    """V12, J10"""
    keep = component_sizes(labelled).filter(F.col("size") >= least).select("case_id", "component")
    return labelled.join(keep, ["case_id", "component"], "left_semi")


def elongation(labelled: DataFrame) -> DataFrame:
    """(case_id, component, size, elongation): ratio of the two largest eigenvalues of the points' covariance; infinite for lines, null below 3 points. Eigenvalues in closed form."""
    pairs = {"00": ("a0", "a0"), "11": ("a1", "a1"), "22": ("a2", "a2"), "01": ("a0", "a1"), "02": ("a0", "a2"), "12": ("a1", "a2")}
    rows = labelled.groupBy("case_id", "component").agg(F.count("*").alias("size"), *(F.covar_samp(*p).alias(f"m{k}") for k, p in pairs.items()))
    c = {k: F.col(f"m{k}") for k in pairs}
    off = c["01"] ** 2 + c["02"] ** 2 + c["12"] ** 2
    q = (c["00"] + c["11"] + c["22"]) / 3
    p = F.sqrt(((c["00"] - q) ** 2 + (c["11"] - q) ** 2 + (c["22"] - q) ** 2 + 2 * off) / 6)
    b = {k: (c[k] - (q if k[0] == k[1] else 0)) / F.col("p") for k in pairs}
    det = b["00"] * (b["11"] * b["22"] - b["12"] ** 2) - b["01"] * (b["01"] * b["22"] - b["12"] * b["02"]) + b["02"] * (b["01"] * b["12"] - b["11"] * b["02"])
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    rows = rows.withColumn("q", q).withColumn("p", p).withColumn("phi", F.when(F.col("p") > 0, phi).otherwise(0.0))
    high = F.col("q") + 2 * F.col("p") * F.cos("phi")
    low = F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + 2 * math.pi / 3)
    middle = 3 * F.col("q") - high - low
    ratio = F.when(F.col("size") >= 3, F.when(middle > 1e-9 * F.greatest(high, F.lit(1e-9)), high / middle).otherwise(float("inf")))
    return rows.select("case_id", "component", "size", ratio.alias("elongation"))


def keep_elongated(labelled: DataFrame, safe: DataFrame, least: float = 2.0) -> DataFrame:
    """Without the components that are not safe and less elongated than `least`."""
    out = elongation(labelled).filter(F.col("elongation") < least).join(safe.select("case_id", "component"), ["case_id", "component"], "left_anti")
    return labelled.join(out.select("case_id", "component"), ["case_id", "component"], "left_anti")


def gap_to_protected(labelled: DataFrame, safe: DataFrame, radius: float) -> DataFrame:
    """(case_id, component, distance, id_a, id_b): the nearest pair of a component that is not safe and a safe one's voxels within radius."""
    own = ["case_id", "component"]
    points = labelled.join(safe.select(own), own, "left_anti")
    trees = as_points(labelled.join(safe.select(own), own, "left_semi"), "y", "id_b")
    left = points.select("case_id", "component", F.struct(*AXES).alias("id_a"), *(F.col(a).cast("double").alias(f"x{k}") for k, a in enumerate(AXES)))
    rows = near_pairs(left, trees, radius).groupBy(own).agg(F.min(F.struct("distance", "id_a", "id_b")).alias("m"))
    return rows.select(*own, "m.*")


def keep_near(labelled: DataFrame, safe: DataFrame, most_mm: float = 5.0, spacing: float = 0.5) -> DataFrame:
    """Without components farther than most_mm from every safe one, measured between all voxels; cases without a safe component stay."""
    own = ["case_id", "component"]
    hits = gap_to_protected(labelled, safe, most_mm / spacing).select(own)
    stay = safe.select(own).unionByName(hits)
    lone = labelled.join(safe.select("case_id").distinct(), "case_id", "left_anti")
    return labelled.join(stay, own, "left_semi").unionByName(lone)


def stamp(paths: DataFrame, radius: int | Column, shapes: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Voxels within radius of any path point, in the grid; a column gives each point its own radius, rounded to voxels (half to even), 1 at least.
    Columns in keep tell apart what was stamped for what."""
    if isinstance(radius, int):
        rows = moved(paths, ball(radius), list(keep)).select(*KEY, *keep)
    else:
        rows = paths.select(*KEY, *keep, F.greatest(F.rint(radius), F.lit(1)).cast("int").alias("r"))
        if keep:
            # a tube's balls overlap: they are made where their voxels are told apart, and only points are sent
            rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "case_id", *keep)
        for k, a in enumerate(AXES):
            left = F.col("r") ** 2 - sum(F.col(f"o{j}") ** 2 for j in range(k)) if k else F.col("r") ** 2
            # what is left of the radius on this axis, so that no voxel outside the ball is made
            reach = F.floor(F.sqrt(left) + 1e-9).cast("int")
            rows = rows.withColumn(f"o{k}", F.explode(F.sequence(-reach, reach)))
        rows = rows.select("case_id", *((F.col(a) + F.col(f"o{k}")).alias(a) for k, a in enumerate(AXES)), *keep)
    rows = rows.distinct()
    return rows if shapes is None else inside(rows, shapes)


def tapered(paths: DataFrame, ends: DataFrame, by: str = "gap_id", share: float = 0.7, least: float = 1.5) -> DataFrame:
    """Paths (by, idx, a0..a2) with the radius at each point, which goes evenly from one end's to the other's: share times radius_a and radius_b of ends, `least` or more."""
    last = F.max("idx").over(Window.partitionBy(by))
    t = F.col("idx") / F.greatest(last, F.lit(1))
    wide = lambda end: F.greatest(F.lit(least), share * F.col(f"radius_{end}"))
    rows = paths.withColumn("t", t).join(ends.select(by, wide("a").alias("__a"), wide("b").alias("__b")), by)
    return rows.withColumn("radius", F.col("__a") * (1 - F.col("t")) + F.col("__b") * F.col("t")).drop("t", "__a", "__b")


def line_points(lines: DataFrame) -> DataFrame:
    """Places of straight lines (case_id, line_id, s0..s2, e0..e2), ceil(length) + 1 of them, rounded half to even; none for a line of length 0."""
    gap = [F.col(f"e{k}") - F.col(f"s{k}") for k in range(3)]
    rows = lines.withColumn("steps", F.ceil(F.sqrt(gap[0] ** 2 + gap[1] ** 2 + gap[2] ** 2)).cast("int")).filter("steps > 0")
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("steps")))).withColumn("t", F.col("t") / F.col("steps"))
    return rows.select("case_id", "line_id", *(F.rint(F.col(f"s{k}") + F.col("t") * gap[k]).cast("int").alias(f"a{k}") for k in range(3)))


def bridge(labelled: DataFrame, safe: DataFrame, shapes: DataFrame, most_mm: float = 5.0, radius_mm: float = 1.0, spacing: float = 0.5) -> DataFrame:
    """The mask with a tube from each near component that is not safe to the nearest safe voxel."""
    gaps = gap_to_protected(labelled, safe, most_mm / spacing)
    ends = [F.col(f"id_a.{a}").alias(f"s{k}") for k, a in enumerate(AXES)] + [F.col(f"id_b.{a}").alias(f"e{k}") for k, a in enumerate(AXES)]
    tubes = stamp(line_points(gaps.select("case_id", F.col("component").alias("line_id"), *ends)), max(1, round(radius_mm / spacing)), shapes)
    return labelled.select(KEY).union(tubes).distinct()


def line_inside(lines: DataFrame, mask: DataFrame) -> DataFrame:
    """(case_id, line_id, clear): whether every place of a line lies in the mask."""
    rows = line_points(lines).join(mask.select(*KEY, F.lit(True).alias("in_mask")), KEY, "left")
    return rows.groupBy("case_id", "line_id").agg(F.bool_and(F.coalesce("in_mask", F.lit(False))).alias("clear"))


def stitch(tiles: DataFrame) -> DataFrame:
    """Scores of overlapping tiles (…, score, weight) as weighted means, then the sigmoid."""
    mean = F.sum(F.col("score") * F.col("weight")) / F.sum("weight")
    return tiles.groupBy(*KEY).agg((1 / (1 + F.exp(-mean))).alias("p"))


def tile_starts(n: Column, size: int, step: int) -> Column:
    """Starts of overlapping tiles along an axis; the last one ends at the grid's end."""
    last = F.greatest(n - size, F.lit(0))
    return F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), last, F.lit(step)), lambda x: x < last), F.array(last)))


def overlay(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Voxels of each case in the prediction, the truth and both."""
    p, t = pred.select(*KEY, F.lit(True).alias("p")), truth.select(*KEY, F.lit(True).alias("t"))
    rows = p.join(t, KEY, "full")
    both = F.col("p").isNotNull() & F.col("t").isNotNull()
    return rows.groupBy("case_id").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_truth"), F.count_if(both).alias("n_both"))


@dataclass(frozen=True)
class Cleanup:
    """Which steps a clean-up takes and how; None leaves a step out."""

    # fixed values: lengths in mm
    spacing: float = 0.5
    closing: int | None = None
    smoothing: float | None = None
    least_size: int = 200
    bridging_mm: float | None = None
    bridge_radius_mm: float = 1.0
    elongation: float | None = None
    near_mm: float | None = 5.0
    cycles_mm: float | None = None
    trees: int = 3
    share: float = 0.05
    floor: int = 3000


#: What a clean-up reports of a case.
CLEANUP_METRICS = (
    "input_voxels", "input_components", "voxels_after_closing", "voxels_after_smoothing", "components_after_initial_removal", "voxels_after_initial_removal", "bridges_added",
    "voxels_after_bridging", "components_removed_shape", "components_removed_distance", "cycles_broken", "output_voxels", "output_components",
)


def cleanup(mask: DataFrame, shapes: DataFrame, config: Cleanup | None = None, skeleton: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mask, metrics): closing, smoothing, small components, bridges, shape, distance, cycles, small components again; of them the ones that config asks for.

    A case that has fewer than config.floor voxels after a removal stops there and keeps what it has; all cases go through one plan, those that
    stopped lie aside. Metrics have a row for each case of shapes; steps a case didn't come to count 0. Components are labelled once and then
    only after steps that can change what is connected: removing whole components cannot. Breaking cycles needs the skeleton (case_id, a0, a1, a2) of
    the mask; cases with fewer than ten voxels of it are left as they are.
    """
    c = config or Cleanup()
    if c.cycles_mm is not None and skeleton is None:
        raise ValueError("breaking cycles needs a skeleton")
    own, found = ["case_id", "component"], []

    def count(rows: DataFrame, name: str, by_component: bool = False) -> None:
        what = F.count_distinct("component") if by_component else F.count("*")
        found.append(rows.groupBy("case_id").agg(what.alias("n")).withColumn("metric", F.lit(name)))

    def fewer(before: DataFrame, after: DataFrame, name: str) -> None:
        lost = before.select(own).distinct().join(after.select(own).distinct(), own, "left_anti")
        found.append(lost.groupBy("case_id").agg(F.count("*").alias("n")).withColumn("metric", F.lit(name)))

    label = lambda rows: written(components(rows), "labelled")
    safe_of = lambda rows: written(protected(component_sizes(rows), c.trees, c.share), "safe")
    stopped: list[DataFrame] = []

    def checked(rows: DataFrame) -> DataFrame:
        """Rows of the cases that go on; the others are done."""
        rows = written(rows, "state")
        enough = rows.groupBy("case_id").agg(F.count("*").alias("n")).filter(F.col("n") >= c.floor).select("case_id")
        stopped.append(rows.join(enough, "case_id", "left_anti"))
        return written(rows.join(enough, "case_id", "left_semi"), "going")

    now = written(mask.select(KEY).distinct(), "mask")
    count(now, "input_voxels")
    if c.closing or c.smoothing:
        count(label(now), "input_components", True)
    if c.closing:
        now = written(close_holes(now, shapes, c.closing), "closed")
    count(now, "voxels_after_closing")
    if c.smoothing:
        now = written(smooth_mask(now, shapes, c.smoothing), "smooth")
    count(now, "voxels_after_smoothing")
    state = label(now)
    if not (c.closing or c.smoothing):
        count(state, "input_components", True)

    state = written(remove_small(state, c.least_size), "large")
    count(state, "components_after_initial_removal", True)
    count(state, "voxels_after_initial_removal")
    state = checked(state)
    if c.bridging_mm is not None:
        safe = safe_of(state)
        gaps = gap_to_protected(state, safe, c.bridging_mm / c.spacing)
        found.append(gaps.groupBy("case_id").agg(F.count("*").alias("n")).withColumn("metric", F.lit("bridges_added")))
        state = label(bridge(state, safe, shapes, c.bridging_mm, c.bridge_radius_mm, c.spacing))
    count(state, "voxels_after_bridging")
    if c.elongation is not None:
        kept = written(keep_elongated(state, safe_of(state), c.elongation), "long")
        fewer(state, kept, "components_removed_shape")
        state = checked(kept)
    if c.near_mm is not None:
        kept = written(keep_near(state, safe_of(state), c.near_mm, c.spacing), "near")
        fewer(state, kept, "components_removed_distance")
        state = checked(kept)
    if c.cycles_mm is not None:
        from . import graph  # graphs are built on voxels

        thread = written(skeleton.select(KEY).join(state.select(KEY), KEY, "left_semi"), "skeleton")
        thread = thread.join(thread.groupBy("case_id").agg(F.count("*").alias("n")).filter("n >= 10").select("case_id"), "case_id", "left_semi")
        inside_mm = distance_transform(state.select(KEY), shapes).select(F.struct(*KEY).alias("node"), (F.col("distance") * c.spacing).alias("radius_mm"))
        links, inside_mm = written(graph.neighbours(thread), "links"), written(inside_mm, "radii")
        closing_links = written(graph.back_edges(links, inside_mm).filter(F.col("radius_mm") < c.cycles_mm), "cycles")
        count(closing_links, "cycles_broken")
        clear = stamp(closing_links.select("thin.*").distinct(), max(1, round(1.0 / c.spacing)))
        state = checked(label(state.select(KEY).join(clear, KEY, "left_anti")))
    done = remove_small(state, c.least_size)
    for rows in stopped:
        done = done.unionByName(rows)
    done = written(done, "clean")
    count(done, "output_voxels")
    count(done, "output_components", True)
    tall = found[0]
    for rows in found[1:]:
        tall = tall.unionByName(rows)
    wide = tall.groupBy("case_id").pivot("metric", list(CLEANUP_METRICS)).agg(F.sum("n"))
    metrics = shapes.select("case_id").distinct().join(wide, "case_id", "left").select("case_id", *(F.coalesce(m, F.lit(0).cast("long")).alias(m) for m in CLEANUP_METRICS))
    return done.select(KEY), metrics
