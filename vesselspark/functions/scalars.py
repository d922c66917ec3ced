"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grades in order, the arteries compared, and name tables.
SEVERITIES = ("Normal", "Mild", "Moderate", "Severe")
ARTERIES = ("LM", "LAD", "LCx", "RCA")
NAMES = {"LCX": "LCx", "lcx": "LCx", "Lcx": "LCx", "LCx": "LCx", "LM": "LM", "lm": "LM", "LAD": "LAD", "lad": "LAD", "RCA": "RCA", "rca": "RCA", "Left Coronary": "LAD", "Right Coronary": "RCA"}
SIDES = {
    "LM": "Left", "LAD": "Left", "LCx": "Left", "LCX": "Left", "D1": "Left", "D2": "Left", "OM": "Left", "OM1": "Left", "OM2": "Left", "Left Coronary": "Left",
    "RCA": "Right", "PDA": "Right", "PLB": "Right", "Right Coronary": "Right",
}
PREFIX = r"(?i)^(proximal|mid|distal) +"
#: Display windows by name.
WINDOWS = {"Default": (-3.0, 3.0), "Vessel Enhancement": (-1.0, 2.0), "Soft Tissue": (-2.0, 1.0)}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def severity(pct: Column) -> Column:
    """Below 25 Normal, below 50 Mild, below 70 Moderate, else Severe."""
    return F.when(pct < 25, "Normal").when(pct < 50, "Mild").when(pct < 70, "Moderate").otherwise("Severe")


def grade(name: Column) -> Column:
    """The rank of a severity, 0 to 3; unknown names rank as Normal."""
    return F.greatest(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.coalesce(name, F.lit("Normal"))) - 1, F.lit(0)).cast("int")


def finding_confidence(pct: Column, length: Column, from_end: Column | None = None, n_points: Column | None = None) -> Column:
    """With distance from the end and number of points, else by length alone."""
    base, by_length = F.least(F.lit(1.0), pct / 100 + 0.3), F.least(F.lit(1.0), length / 20)
    if from_end is None or n_points is None:
        return F.least(F.lit(1.0), base * (0.7 + 0.3 * by_length))
    return F.least(F.lit(1.0), base * (0.5 + 0.2 * by_length + 0.15 * F.least(F.lit(1.0), from_end / 5) + 0.15 * F.least(F.lit(1.0), n_points / 10)))


def normalize_artery(name: Column) -> Column:
    """P10: one of LM, LAD, LCx, RCA, or null. The name as it is, else without region prefixes, else what stands before the first '_'."""
    name = F.trim(name)
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, PREFIX, ""), PREFIX, ""))
    head = F.trim(F.regexp_replace(F.trim(F.substring_index(bare, "_", 1)), PREFIX, ""))
    return F.coalesce(lookup(NAMES, name), lookup(NAMES, bare), lookup(NAMES, head))


def artery_side(name: Column, dominance: Column) -> Column:
    """Left or Right, or null; PDA and PLB go left where dominance is Left."""
    name = F.trim(name)
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, PREFIX, ""), PREFIX, ""))
    head = F.trim(F.regexp_replace(F.trim(F.substring_index(bare, "_", 1)), PREFIX, ""))
    found = F.coalesce(lookup(SIDES, name), lookup(SIDES, bare), lookup(SIDES, head), lookup(SIDES, normalize_artery(name)))
    turns = name.isin("PDA", "PLB") | bare.isin("PDA", "PLB") | head.isin("PDA", "PLB")
    return F.when(found.isNotNull() & turns & F.coalesce(dominance == "Left", F.lit(False)), "Left").otherwise(found)


def severity_name(value: Column) -> Column:
    """Of a rank 0 to 3 as text or a name in any case; what is unknown is Normal."""
    text = F.initcap(F.trim(value.cast("string")))
    by_rank = lookup({str(k): s for k, s in enumerate(SEVERITIES)}, text)
    return F.coalesce(by_rank, F.when(text.isin(*SEVERITIES), text), F.lit("Normal"))


def clip(value: Column, low: float, high: float) -> Column:
    """P3"""
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def to_mm(position: Column, spacing: Column) -> Column:
    """P7"""
    return position * spacing


def to_voxel(mm: Column, spacing: Column) -> Column:
    """P7, inverse: rounds half to even."""
    return F.rint(mm / spacing).cast("int")


def near_boundary(position: list[Column], shape: list[Column], margin: int = 5) -> Column:
    """P13"""
    out = F.lit(False)
    for p, n in zip(position, shape, strict=True):
        out = out | (p < margin) | (p >= n - margin)
    return out


def alignment(a: list[Column], b: list[Column], dir_a: list[Column], dir_b: list[Column]) -> Column:
    """How well two tips point at each other, 0 to 1; 0.5 if a direction is null, 0 if the tips coincide."""
    gap = [y - x for x, y in zip(a, b, strict=True)]
    norm = F.sqrt(sum((g * g for g in gap[1:]), gap[0] * gap[0]))
    dot = lambda d: sum((x * g for x, g in zip(d[1:], gap[1:], strict=True)), d[0] * gap[0]) / norm
    return F.when(dir_a[0].isNull() | dir_b[0].isNull(), 0.5).when(norm < 1e-6, 0.0).otherwise(F.greatest(F.lit(0.0), (dot(dir_a) - dot(dir_b)) / 2))


def radius_ratio(a: Column, b: Column) -> Column:
    """Smaller over larger; 0.5 if one is not positive."""
    return F.when((a <= 0) | (b <= 0), 0.5).otherwise(F.least(a, b) / F.greatest(a, b))


def continuity_score(lcf: Column, bifurcations: Column, length: Column, plausibility: Column) -> Column:
    """P17"""
    return 0.4 * lcf + 0.3 * F.least(F.lit(1.0), bifurcations / 15) + 0.2 * F.least(F.lit(1.0), length / 200) + 0.1 * plausibility


def tier1_score(dice: Column, surface: Column, asd: Column, mare: Column, hd95: Column) -> Column:
    """NaN errors count as the worst case."""
    part = lambda c, worst: F.greatest(F.lit(0.0), 1 - F.nanvl(c, F.lit(worst)) / worst)
    return 0.30 * dice + 0.25 * surface + 0.15 * part(asd, 3.0) + 0.15 * part(mare, 2.0) + 0.15 * part(hd95, 10.0)


def tier3_score(side_sens: Column, sens: Column, side_spec: Column, spec: Column, agree: Column, miss: Column, extra: Column) -> Column:
    """By side, by artery where that is null."""
    return 0.30 * F.coalesce(side_sens, sens, F.lit(0.0)) + 0.20 * F.coalesce(side_spec, spec, F.lit(0.0)) + 0.20 * agree + 0.15 * (1 - miss) + 0.15 * (1 - extra)


def tier4_score(gap: Column) -> Column:
    """P18"""
    return F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.nanvl(gap, F.lit(0.5))))


def composite(t1: Column, t2: Column, t3: Column, t4: Column, weights: tuple[float, ...] = (0.25, 0.15, 0.45, 0.15)) -> Column:
    """P19"""
    return weights[0] * t1 + weights[1] * t2 + weights[2] * t3 + weights[3] * t4
