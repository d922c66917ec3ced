"""Findings against reader reports and against an oracle: per artery, per side, per case and per cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast, parts_for, written

from ..functions.scalars import ARTERIES, grade, severity

POSITIVE = 25.0


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def max_per_artery(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Of each artery the finding with the highest pct, ties to the smaller finding_id; unmapped ones (artery null) are left out."""
    order = Window.partitionBy(*keys, "artery").orderBy(F.desc("pct"), "finding_id")
    return findings.filter("artery is not null").withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def artery_spine(cases: DataFrame) -> DataFrame:
    """Each case with each of the four arteries."""
    return cases.withColumn("artery", F.explode(F.array(*map(F.lit, ARTERIES))))


def outcome(truth: Column, found: Column) -> Column:
    return F.when(truth & found, "TP").when(~truth & ~found, "TN").when(found, "FP").otherwise("FN")


def artery_comparison(cases: DataFrame, truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """On the spine the reader's and the pipeline's grade and percent (keys, artery, pct, severity); absent is Normal and 0 %."""
    t = truth.select(*keys, "artery", F.col("pct").alias("gt_pct"), F.col("severity").alias("gt_severity"))
    p = found.select(*keys, "artery", F.col("pct").alias("pipe_pct"), F.col("severity").alias("pipe_severity"))
    rows = artery_spine(cases.select(*keys)).join(t, [*keys, "artery"], "left").join(p, [*keys, "artery"], "left")
    rows = rows.withColumns({"gt_pct": F.coalesce("gt_pct", F.lit(0.0)), "pipe_pct": F.coalesce("pipe_pct", F.lit(0.0)), "gt_severity": F.coalesce("gt_severity", F.lit("Normal")), "pipe_severity": F.coalesce("pipe_severity", F.lit("Normal"))})
    apart = F.abs(grade(F.col("gt_severity")) - grade(F.col("pipe_severity")))
    return rows.withColumns({
        "severity_match": F.col("gt_severity") == F.col("pipe_severity"), "within_one": apart <= 1,
        "classification": outcome(F.col("gt_pct") >= POSITIVE, F.col("pipe_pct") >= POSITIVE), "pct_diff": F.col("pipe_pct") - F.col("gt_pct"),
    })


def outcome_counts() -> list[Column]:
    return [F.count_if(F.col("classification") == c).alias(c.lower()) for c in ("TP", "TN", "FP", "FN")]


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sensitivity", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("specificity", ratio(F.col("tn"), F.col("tn") + F.col("fp")))


def case_comparison(comparison: DataFrame, keys: list[str]) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("double"))
    return with_rates(comparison.groupBy(*keys).agg(*outcome_counts(), share("severity_match").alias("agreement_rate"), share("within_one").alias("within_one_rate")))


def side_profile(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per case and side (null sides left out) of items with side, pct, name: positives by grade, highest percent, names of positives in order."""
    positive = F.col("pct") >= POSITIVE
    by = lambda s: F.count_if(positive & (severity(F.col("pct")) == s))
    return items.filter("side is not null").groupBy(*keys, "side").agg(
        by("Mild").alias("n_mild"), by("Moderate").alias("n_moderate"), by("Severe").alias("n_severe"), F.count_if(positive).alias("n_positive"),
        F.greatest(F.max("pct"), F.lit(0.0)).alias("max_pct"), F.concat_ws(",", F.array_sort(F.collect_list(F.when(positive, F.col("name"))))).alias("names"),
    )


def side_comparison(cases: DataFrame, truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides of each case, reader's profile against the pipeline's."""
    spine = cases.select(*keys).withColumn("side", F.explode(F.array(F.lit("Left"), F.lit("Right"))))
    pick = lambda df, p: df.select(*keys, "side", F.col("n_positive").alias(f"{p}_n"), F.col("max_pct").alias(f"{p}_max"))
    rows = spine.join(pick(truth, "gt"), [*keys, "side"], "left").join(pick(found, "pipe"), [*keys, "side"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("gt_n", "gt_max", "pipe_n", "pipe_max")})
    return rows.withColumns({
        "classification": outcome(F.col("gt_n") > 0, F.col("pipe_n") > 0), "max_match": severity(F.col("gt_max")) == severity(F.col("pipe_max")),
        "max_diff": F.col("pipe_max") - F.col("gt_max"), "count_diff": F.col("pipe_n") - F.col("gt_n"),
    })


def binary_kappa(counts: DataFrame) -> DataFrame:
    """From tp, tn, fp, fn; full chance agreement gives 1 if all agree, else 0."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    po, pe = (tp + tn) / n, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n)
    kappa = F.when(n == 0, 0.0).when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return counts.withColumn("kappa", kappa)


def severity_kappa(comparison: DataFrame, keys: list[str]) -> DataFrame:
    """Cohen's kappa over the four grades, from the confusion counts."""
    cells = comparison.groupBy(*keys, grade(F.col("gt_severity")).alias("g"), grade(F.col("pipe_severity")).alias("p")).agg(F.count("*").alias("m"))
    whole, row, col = Window.partitionBy(*keys), Window.partitionBy(*keys, "g"), Window.partitionBy(*keys, "p")
    cells = cells.withColumn("n", F.sum("m").over(whole)).withColumn("row", F.sum("m").over(row)).withColumn("col", F.sum("m").over(col))
    # each grade's product of margins, once: on its diagonal cell or, lacking that, from its row and column
    rows = cells.groupBy(*keys, "n", F.col("g").alias("k")).agg(F.first("row").alias("r"), F.sum(F.when(F.col("g") == F.col("p"), F.col("m"))).alias("hit"))
    cols = cells.groupBy(*keys, F.col("p").alias("k")).agg(F.first("col").alias("c"))
    both = rows.join(cols, [*keys, "k"], "left")
    out = both.groupBy(*keys, "n").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.sum(F.col("r").cast("double") * F.coalesce("c", F.lit(0))).alias("margin"))
    po, pe = F.col("hits") / F.col("n"), F.col("margin") / (F.col("n") * F.col("n"))
    return out.select(*keys, F.when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def oracle_comparison(cases: DataFrame, model: DataFrame, oracle: DataFrame, keys: list[str]) -> DataFrame:
    """A row a case: agreement over the four arteries, misses and extra positives, sum and number of reference radius ratios."""
    pick = lambda df, p: df.select(*keys, "artery", *(F.col(c).alias(f"{p}_{c}") for c in ("pct", "severity", "ref_radius")))
    rows = artery_spine(cases.select(*keys)).join(pick(model, "m"), [*keys, "artery"], "left").join(pick(oracle, "o"), [*keys, "artery"], "left")
    m, o = F.coalesce("m_severity", F.lit("Normal")), F.coalesce("o_severity", F.lit("Normal"))
    mp, op = F.coalesce("m_pct", F.lit(0.0)) >= POSITIVE, F.coalesce("o_pct", F.lit(0.0)) >= POSITIVE
    both = F.when((F.col("m_ref_radius") > 0) & (F.col("o_ref_radius") > 0), F.col("m_ref_radius") / F.col("o_ref_radius"))
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*keys).agg(
        share(m == o).alias("agreement_rate"), share(F.abs(grade(m) - grade(o)) <= 1).alias("within_one_rate"), F.count_if(op).alias("n_oracle"), F.count_if(mp).alias("n_model"),
        F.count_if(op & ~mp).alias("misses"), F.count_if(mp & ~op).alias("extras"), F.coalesce(F.sum(both), F.lit(0.0)).alias("ratio_sum"), F.coalesce(F.sum(both * both), F.lit(0.0)).alias("ratio_squares"), F.count(both).alias("n_ratios"),
    )


def oracle_cohort(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Mean rates, pooled misses and extras, mean and deviation of all ratios (null if there are none)."""
    total = lambda c: F.sum(c).cast("double")
    n = total("n_ratios")
    mean = F.when(n > 0, total("ratio_sum") / n)
    spread = F.when(n > 0, F.sqrt(F.greatest(total("ratio_squares") / n - mean * mean, F.lit(0.0))))
    return cases.groupBy(*keys).agg(
        F.avg("agreement_rate").alias("agreement_rate"), F.avg("within_one_rate").alias("within_one_rate"), mean.alias("ratio_mean"), spread.alias("ratio_std"),
        ratio(total("misses"), total("n_oracle")).alias("miss_rate"), ratio(total("extras"), total("n_model")).alias("extra_rate"), F.count("*").alias("n_cases"),
    )


def hash_draw(seed: int, n: Column, *parts: Column) -> Column:
    """A whole number from 0 to n - 1 from the MD5 of seed and parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long"), n)


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with __at, their number from 0 in each group of keys by `order`, and __n, the group's rows. Groups are cut by a range partitioning and numbered where they lie; only
    each part's size is summed, so a group needs no task of its own."""
    parts = rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    parts = written(parts.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "parts")
    by = Window.partitionBy(*keys)
    sizes = parts.groupBy(*keys, "__part").agg(F.count("*").alias("__size"), F.min("__row").alias("__first"))
    before = F.coalesce(F.sum("__size").over(by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"__before": before, "__n": F.sum("__size").over(by)}).drop("__size")
    return parts.join(sizes, [*keys, "__part"]).withColumn("__at", F.col("__before") + F.col("__row") - F.col("__first")).drop("__part", "__row", "__first", "__before")


def bootstrap(cases: DataFrame, metric: Column, keys: list[str], order: str, iterations: int = 1000, ci: float = 0.95, seed: int = 42, broadcast_rows: int = 100_000) -> DataFrame:
    """Point estimate and percentile interval of an aggregate expression over cases drawn with replacement within each group of keys.

    Draw j of iteration i takes the case whose place in `order` is a hash of seed, i and j, so that every metric sees the same draws. Draws meet the cases where they are made,
    as long as the counted cases may be broadcast, and are summed before any shuffle.
    """
    placed = written(numbered(cases, keys, order), "placed")
    point = cases.groupBy(*keys).agg(metric.alias("point"))
    n = placed.count()
    # many rows come of few, so the few are dealt to as many tasks as the many need
    parts = parts_for(cases.sparkSession, n * iterations, 1_000_000)
    draws = placed.select(*keys, F.col("__at").alias("__j"), "__n").repartition(parts, *keys, "__j").withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    draws = draws.withColumn("__at", hash_draw(seed, F.col("__n"), F.col("__i"), F.col("__j"))).drop("__n", "__j")
    values = draws.join(maybe_broadcast(placed.drop("__n"), n, broadcast_rows), [*keys, "__at"]).groupBy(*keys, "__i").agg(metric.alias("v"))
    alpha = (1 - ci) / 2
    ends = values.groupBy(*keys).agg(F.percentile("v", F.lit(alpha)).alias("lower"), F.percentile("v", F.lit(1 - alpha)).alias("upper"))
    return point.join(ends, keys)



def comparison_text(comparison: DataFrame, keys: list[str]) -> DataFrame:
    """A report a case: a line an artery in the usual order, then the counts."""
    line = F.format_string("%-4s reader %-8s %5.1f%%  pipeline %-8s %5.1f%%  %s", "artery", "gt_severity", "gt_pct", "pipe_severity", "pipe_pct", "classification")
    place = F.array_position(F.array(*map(F.lit, ARTERIES)), F.col("artery"))
    rows = comparison.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), line.alias("line")))).alias("lines"), F.count_if("severity_match").alias("hits"))
    text = F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\nagreement "), F.col("hits").cast("string"), F.lit("/4"))
    return rows.select(*keys, text.alias("report"))
