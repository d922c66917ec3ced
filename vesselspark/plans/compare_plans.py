"""Queries of the comparison operators (P10-P12, A12-A22, A27, J3-J4, U4) and their SQL, on `orders` as graded findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import compare
from ..session import written
from .fixtures import GRADED, graded, table, with_ctes
from .profile_plans import rounded, sql_round

KEYS = ["model", "case_id"]
SEV = "CASE WHEN {0} < 25 THEN 'Normal' WHEN {0} < 50 THEN 'Mild' WHEN {0} < 70 THEN 'Moderate' ELSE 'Severe' END"
GRADE = "CASE {0} WHEN 'Severe' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Mild' THEN 1 ELSE 0 END"
OUTCOME = "CASE WHEN {0} AND {1} THEN 'TP' WHEN NOT {0} AND NOT {1} THEN 'TN' WHEN {1} THEN 'FP' ELSE 'FN' END"
FOUND = f"""
found AS (SELECT model, case_id, finding_id, gt_pct, pred_pct, ref_radius, artery AS name, CASE artery WHEN 'proximal LAD' THEN 'LAD' WHEN 'LCX' THEN 'LCx' WHEN 'D1_prox' THEN NULL ELSE artery END AS artery,
    CASE WHEN artery = 'RCA' THEN 'Right' ELSE 'Left' END AS side FROM graded),
truth AS (SELECT * FROM (SELECT *, gt_pct AS pct, {SEV.format("gt_pct")} AS severity FROM found WHERE artery IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY model, case_id, artery ORDER BY pct DESC, finding_id) = 1),
pipe AS (SELECT * FROM (SELECT *, pred_pct AS pct, {SEV.format("pred_pct")} AS severity FROM found WHERE artery IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY model, case_id, artery ORDER BY pct DESC, finding_id) = 1),
cases AS (SELECT DISTINCT model, case_id FROM found), spine AS (SELECT *, unnest(['LM', 'LAD', 'LCx', 'RCA']) AS artery FROM cases),
base AS (SELECT s.*, coalesce(t.pct, 0) AS gt_pct, coalesce(p.pct, 0) AS pipe_pct, coalesce(t.severity, 'Normal') AS gt_severity, coalesce(p.severity, 'Normal') AS pipe_severity,
    p.pct AS m_pct, t.pct AS o_pct, p.ref_radius AS m_ref, t.ref_radius AS o_ref FROM spine s LEFT JOIN truth t USING (model, case_id, artery) LEFT JOIN pipe p USING (model, case_id, artery)),
comparison AS (SELECT model, case_id, artery, gt_pct, pipe_pct, gt_severity, pipe_severity, gt_severity = pipe_severity AS severity_match, abs({GRADE.format("gt_severity")} - {GRADE.format("pipe_severity")}) <= 1 AS within_one,
    {OUTCOME.format("(gt_pct >= 25)", "(pipe_pct >= 25)")} AS classification, pipe_pct - gt_pct AS pct_diff FROM base),
by_case AS (SELECT model, case_id, count(*) FILTER (classification = 'TP') AS tp, count(*) FILTER (classification = 'TN') AS tn, count(*) FILTER (classification = 'FP') AS fp, count(*) FILTER (classification = 'FN') AS fn,
    avg(severity_match::INT) AS agreement_rate, avg(within_one::INT) AS within_one_rate FROM comparison GROUP BY ALL)
"""
PROFILE = """SELECT model, case_id, side, count(*) FILTER ({0} >= 25 AND {0} < 50) AS n_mild, count(*) FILTER ({0} >= 50 AND {0} < 70) AS n_moderate, count(*) FILTER ({0} >= 70) AS n_severe, count(*) FILTER ({0} >= 25) AS n_positive,
    greatest(max({0}), 0) AS max_pct, coalesce(string_agg(name, ',' ORDER BY name) FILTER ({0} >= 25), '') AS names FROM found GROUP BY ALL"""
SIDES = f"""
gt_side AS ({PROFILE.format("gt_pct")}), pipe_side AS ({PROFILE.format("pred_pct")}),
sides AS (SELECT c.model, c.case_id, c.side, coalesce(g.n_positive, 0) AS gt_n, coalesce(g.max_pct, 0) AS gt_max, coalesce(p.n_positive, 0) AS pipe_n, coalesce(p.max_pct, 0) AS pipe_max
  FROM (SELECT *, unnest(['Left', 'Right']) AS side FROM cases) c LEFT JOIN gt_side g USING (model, case_id, side) LEFT JOIN pipe_side p USING (model, case_id, side)),
side_rows AS (SELECT *, {OUTCOME.format("(gt_n > 0)", "(pipe_n > 0)")} AS classification, {SEV.format("gt_max")} = {SEV.format("pipe_max")} AS max_match, pipe_max - gt_max AS max_diff, pipe_n - gt_n AS count_diff FROM sides)
"""
ORACLE = f"""
oracle AS (SELECT model, case_id, avg((gt_severity = pipe_severity)::INT) AS agreement_rate, avg((abs({GRADE.format("gt_severity")} - {GRADE.format("pipe_severity")}) <= 1)::INT) AS within_one_rate,
    count(*) FILTER (gt_pct >= 25) AS n_oracle, count(*) FILTER (pipe_pct >= 25) AS n_model, count(*) FILTER (gt_pct >= 25 AND pipe_pct < 25) AS misses, count(*) FILTER (pipe_pct >= 25 AND gt_pct < 25) AS extras,
    coalesce(sum(m_ref / o_ref), 0) AS ratio_sum, coalesce(sum((m_ref / o_ref) * (m_ref / o_ref)), 0) AS ratio_squares, count(m_ref / o_ref) AS n_ratios FROM base GROUP BY ALL)
"""
ITERATIONS = 100
BOOT = f"""
placed AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY case_id) - 1 AS pos, count(*) OVER (PARTITION BY model) AS n FROM by_case),
draws AS (SELECT model, i, ('0x' || substr(md5('42|' || i || '|' || pos), 1, 13))::BIGINT % n AS pos FROM placed, range({ITERATIONS}) r(i)),
boot AS (SELECT d.model, d.i, sum(tp) / sum(tp + fn) AS v FROM draws d JOIN placed p ON p.model = d.model AND p.pos = d.pos GROUP BY ALL),
interval_of AS (SELECT model, quantile_cont(v, 0.025) AS lower, quantile_cont(v, 0.975) AS upper FROM boot GROUP BY model)
"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graded(spark, sf_dir).withColumn("name", F.col("artery"))
    return rows.withColumn("artery", scalars.normalize_artery(F.col("name"))).withColumn("side", scalars.artery_side(F.col("name"), F.lit(None).cast("string")))


def best(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, reader's, pipeline's) highest findings."""
    rows = found(spark, sf_dir)
    pick = lambda c: compare.max_per_artery(rows.withColumn("pct", F.col(c)), KEYS).withColumn("severity", scalars.severity(F.col("pct")))
    return rows.select(*KEYS).distinct(), pick("gt_pct"), pick("pred_pct")


def a12_max_per_artery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir)[2].select(*KEYS, "artery", "finding_id", "pct", "severity")


def a13_artery_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.artery_comparison(*best(spark, sf_dir), KEYS)


def a13_case_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.case_comparison(a13_artery_comparison(spark, sf_dir), KEYS))


def profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = found(spark, sf_dir)
    pick = lambda c: compare.side_profile(rows.withColumn("pct", F.col(c)), KEYS)
    return rows.select(*KEYS).distinct(), pick("gt_pct"), pick("pred_pct")


def a14_side_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir)[1]


def a15_side_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.side_comparison(*profiles(spark, sf_dir), KEYS)


def a16_binary_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = a15_side_comparison(spark, sf_dir).groupBy("model").agg(*compare.outcome_counts())
    return rounded(compare.binary_kappa(counts))


def a16_label_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(compare.outcome(F.col("quality") == 1, F.col("toxic") == 1).alias("classification"))
    return rounded(compare.binary_kappa(rows.agg(*compare.outcome_counts())))


def a17_severity_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.severity_kappa(a13_artery_comparison(spark, sf_dir), ["model"]))


def a18_oracle_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, truth, pipe = best(spark, sf_dir)
    return rounded(compare.oracle_comparison(cases, pipe, truth, KEYS))


def a19_oracle_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, truth, pipe = best(spark, sf_dir)
    return rounded(compare.oracle_cohort(compare.oracle_comparison(cases, pipe, truth, KEYS), ["model"]))


def sensitivity() -> F.Column:
    return compare.ratio(F.sum("tp"), F.sum(F.col("tp") + F.col("fn")))


def a20_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = written(compare.case_comparison(a13_artery_comparison(spark, sf_dir), KEYS), "cases")
    return rounded(compare.bootstrap(cases, sensitivity(), ["model"], "case_id", ITERATIONS))


def a21_cohort_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled rates, kappas and the interval of the sensitivity, a row a model."""
    # both feed several branches below
    comparison = written(a13_artery_comparison(spark, sf_dir), "comparison")
    cases = written(compare.case_comparison(comparison, KEYS), "cases")
    pooled = cases.groupBy("model").agg(*(F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")), F.avg("agreement_rate").alias("agreement_rate"), F.avg("within_one_rate").alias("within_one_rate"), F.count("*").alias("n_cases"))
    sides = a15_side_comparison(spark, sf_dir).groupBy("model").agg(*compare.outcome_counts(), F.avg(F.col("max_match").cast("double")).alias("side_max_agreement"))
    sides = compare.binary_kappa(compare.with_rates(sides)).select("model", F.col("sensitivity").alias("side_sensitivity"), F.col("specificity").alias("side_specificity"), F.col("kappa").alias("side_kappa"), "side_max_agreement")
    interval = compare.bootstrap(cases, sensitivity(), ["model"], "case_id", ITERATIONS).drop("point")
    rows = compare.with_rates(pooled).join(compare.severity_kappa(comparison, ["model"]), "model").join(sides, "model").join(interval, "model")
    return rounded(rows)


def a22_tier3_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oracle rows and cohort rows joined whole; the cohort's models are numbered from 1, so each side has one that the other lacks."""
    oracle = a19_oracle_cohort(spark, sf_dir).select("model", F.col("agreement_rate").alias("oracle_agreement"), "miss_rate", "extra_rate")
    cohort = compare.with_rates(compare.case_comparison(a13_artery_comparison(spark, sf_dir), KEYS).groupBy("model").agg(*(F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")))).withColumn("model", F.col("model") + 1)
    return rounded(oracle.join(cohort.select("model", "sensitivity", "specificity"), "model", "full"))


def a27_comparison_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.comparison_text(a13_artery_comparison(spark, sf_dir), KEYS)


def p8_severity_and_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8, P9 and its fallback."""
    rows = graded(spark, sf_dir)
    pct, length = F.col("gt_pct"), F.col("pred_pct") / 3
    return rounded(rows.select("finding_id", scalars.severity(pct).alias("severity"), scalars.finding_confidence(pct, length, F.col("ref_radius") * 3, F.col("case_id") % 13).alias("confidence"), scalars.finding_confidence(pct, length).alias("by_length")))


RAW = ("LM", " lcx ", "Proximal  LAD", "mid LAD_prox", "Left Coronary", "PDA", "PLB_1", "OM2", "distal RCA", "D1", "lad", "RCA_mid", "unknown", "", "LCx_distal")


def p10_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10-P12 over names picked by order key, with either dominance."""
    name = F.element_at(F.array(*map(F.lit, RAW)), (F.col("o_orderkey") % len(RAW) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), F.when(F.col("o_custkey") % 2 == 0, "Left").alias("dominance"), F.element_at(F.array(*map(F.lit, ("0", "2", "SEVERE", " mild", "?", "3"))), (F.col("o_custkey") % 6 + 1).cast("int")).alias("raw"))
    return rows.select("o_orderkey", scalars.normalize_artery(F.col("name")).alias("artery"), scalars.artery_side(F.col("name"), F.col("dominance")).alias("side"), scalars.severity_name(F.col("raw")).alias("severity"))


P10_SQL = f"""
WITH o AS (SELECT o_orderkey, {list(RAW)!r}[o_orderkey % {len(RAW)} + 1] AS name, o_custkey % 2 = 0 AS ld, ['0', '2', 'SEVERE', ' mild', '?', '3'][o_custkey % 6 + 1] AS raw FROM orders)
SELECT o_orderkey, CASE trim(name) WHEN 'LM' THEN 'LM' WHEN 'lcx' THEN 'LCx' WHEN 'Proximal  LAD' THEN 'LAD' WHEN 'mid LAD_prox' THEN 'LAD' WHEN 'Left Coronary' THEN 'LAD' WHEN 'distal RCA' THEN 'RCA' WHEN 'lad' THEN 'LAD' WHEN 'RCA_mid' THEN 'RCA' WHEN 'LCx_distal' THEN 'LCx' END AS artery,
  CASE WHEN trim(name) IN ('PDA', 'PLB_1') THEN CASE WHEN ld THEN 'Left' ELSE 'Right' END WHEN trim(name) IN ('distal RCA', 'RCA_mid') THEN 'Right' WHEN trim(name) IN ('unknown', '') THEN NULL ELSE 'Left' END AS side,
  CASE raw WHEN '2' THEN 'Moderate' WHEN 'SEVERE' THEN 'Severe' WHEN ' mild' THEN 'Mild' WHEN '3' THEN 'Severe' ELSE 'Normal' END AS severity FROM o
"""
KAPPA2 = "CASE WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END"
COUNTS = ", ".join(f"count(*) FILTER (classification = '{c}') AS {c.lower()}" for c in ("TP", "TN", "FP", "FN"))
KAPPA4 = f"""
cells AS (SELECT model, {GRADE.format("gt_severity")} AS g, {GRADE.format("pipe_severity")} AS p FROM comparison),
kap AS (SELECT model, count(*)::DOUBLE AS n, count(*) FILTER (g = p) / count(*)::DOUBLE AS po, (count(*) FILTER (g = 0) * count(*) FILTER (p = 0) + count(*) FILTER (g = 1) * count(*) FILTER (p = 1)
  + count(*) FILTER (g = 2) * count(*) FILTER (p = 2) + count(*) FILTER (g = 3) * count(*) FILTER (p = 3)) / (count(*) * count(*))::DOUBLE AS pe FROM cells GROUP BY model),
kappa_of AS (SELECT model, {KAPPA2} AS kappa FROM kap)
"""
KAPPA_SIDE = f"""
side_counts AS (SELECT model, {COUNTS}, avg(max_match::INT) AS side_max_agreement FROM side_rows GROUP BY model),
side_po AS (SELECT *, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS po, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / ((tp + tn + fp + fn) * (tp + tn + fp + fn))::DOUBLE AS pe FROM side_counts)
"""
RATES = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS sensitivity, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS specificity"
COHORT = """
cohort AS (SELECT model, avg(agreement_rate) AS agreement_rate, avg(within_one_rate) AS within_one_rate, sum(ratio_sum) / sum(n_ratios) AS ratio_mean, sqrt(greatest(sum(ratio_squares) / sum(n_ratios) - (sum(ratio_sum) / sum(n_ratios)) ^ 2, 0)) AS ratio_std,
  sum(misses) / sum(n_oracle) AS miss_rate, sum(extras) / sum(n_model) AS extra_rate, count(*) AS n_cases FROM oracle GROUP BY model)
"""
LINE = "printf('%-4s reader %-8s %5.1f%%  pipeline %-8s %5.1f%%  %s', artery, gt_severity, gt_pct, pipe_severity, pipe_pct, classification)"

QUERIES = {f.__name__: f for f in (
    a12_max_per_artery, a13_artery_comparison, a13_case_rates, a14_side_profile, a15_side_comparison, a16_binary_kappa, a16_label_kappa, a17_severity_kappa, a18_oracle_comparison, a19_oracle_cohort,
    a20_bootstrap, a21_cohort_row, a22_tier3_row, a27_comparison_text, p8_severity_and_confidence, p10_names,
)}
C = (GRADED, FOUND)
ORACLES = {
    "a12_max_per_artery": with_ctes(*C, select="SELECT model, case_id, artery, finding_id, pct, severity FROM pipe"),
    "a13_artery_comparison": with_ctes(*C, select="SELECT * FROM comparison"),
    "a13_case_rates": with_ctes(*C, select=f"SELECT model, case_id, tp, tn, fp, fn, agreement_rate, within_one_rate, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM (SELECT *, {RATES} FROM by_case)"),
    "a14_side_profile": with_ctes(*C, SIDES, select="SELECT * FROM gt_side"),
    "a15_side_comparison": with_ctes(*C, SIDES, select="SELECT * FROM side_rows"),
    "a16_binary_kappa": with_ctes(*C, SIDES, KAPPA_SIDE, select=f"SELECT model, tp, tn, fp, fn, round({KAPPA2}, 6) AS kappa FROM side_po"),
    "a16_label_kappa": f"SELECT tp, tn, fp, fn, round({KAPPA2}, 6) AS kappa FROM (SELECT *, (tp + tn) / n AS po, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n) AS pe FROM (SELECT {COUNTS}, count(*)::DOUBLE AS n FROM (SELECT {OUTCOME.format('(quality = 1)', '(toxic = 1)')} AS classification FROM labels)))",
    "a17_severity_kappa": with_ctes(*C, KAPPA4, select="SELECT model, round(kappa, 6) AS kappa FROM kappa_of"),
    "a18_oracle_comparison": with_ctes(*C, ORACLE, select=f"SELECT model, case_id, n_oracle, n_model, misses, extras, n_ratios, {sql_round('agreement_rate within_one_rate ratio_sum ratio_squares')} FROM oracle"),
    "a19_oracle_cohort": with_ctes(*C, ORACLE, COHORT, select=f"SELECT model, n_cases, {sql_round('agreement_rate within_one_rate ratio_mean ratio_std miss_rate extra_rate')} FROM cohort"),
    "a20_bootstrap": with_ctes(*C, BOOT, select=f"SELECT model, {sql_round('point lower upper')} FROM (SELECT model, sum(tp) / sum(tp + fn) AS point FROM by_case GROUP BY model) JOIN interval_of USING (model)"),
    "a21_cohort_row": with_ctes(*C, SIDES, BOOT, KAPPA4, KAPPA_SIDE, select=f"""SELECT model, a.tp, a.tn, a.fp, a.fn, n_cases, {sql_round('agreement_rate within_one_rate sensitivity specificity kappa side_sensitivity side_specificity side_kappa side_max_agreement lower upper')}
  FROM (SELECT *, {RATES} FROM (SELECT model, sum(tp)::BIGINT AS tp, sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg(agreement_rate) AS agreement_rate, avg(within_one_rate) AS within_one_rate, count(*) AS n_cases FROM by_case GROUP BY model)) a
  JOIN kappa_of USING (model) JOIN interval_of USING (model) JOIN (SELECT model, {RATES.replace('sensitivity', 'side_sensitivity').replace('specificity', 'side_specificity')}, {KAPPA2} AS side_kappa, side_max_agreement FROM side_po) s USING (model)"""),
    "a22_tier3_row": with_ctes(*C, ORACLE, COHORT, select=f"""SELECT model, {sql_round('oracle_agreement miss_rate extra_rate sensitivity specificity')} FROM (SELECT model, agreement_rate AS oracle_agreement, miss_rate, extra_rate FROM cohort)
  FULL JOIN (SELECT model + 1 AS model, {RATES} FROM (SELECT model, sum(tp) AS tp, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn FROM by_case GROUP BY model)) USING (model)"""),
    "a27_comparison_text": with_ctes(*C, select=f"SELECT model, case_id, string_agg({LINE}, chr(10) ORDER BY list_position(['LM', 'LAD', 'LCx', 'RCA'], artery)) || chr(10) || 'agreement ' || count(*) FILTER (severity_match) || '/4' AS report FROM comparison GROUP BY ALL"),
    "p8_severity_and_confidence": with_ctes(GRADED, select=f"""SELECT finding_id, {SEV.format('gt_pct')} AS severity, round(least(1, least(1, gt_pct / 100 + 0.3) * (0.5 + 0.2 * least(1, pred_pct / 60) + 0.15 * least(1, ref_radius * 3 / 5) + 0.15 * least(1, case_id % 13 / 10.0))), 6) AS confidence,
  round(least(1, least(1, gt_pct / 100 + 0.3) * (0.7 + 0.3 * least(1, pred_pct / 60))), 6) AS by_length FROM graded"""),
    "p10_names": P10_SQL,
}
