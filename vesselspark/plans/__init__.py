"""Registered queries over the driver's tables and their SQL twins."""

from . import cohort_plans, compare_plans, gap_plans, graph_plans, profile_plans, series_plans, tree_plans, voxel_plans

PARTS = (profile_plans, series_plans, compare_plans, voxel_plans, graph_plans, tree_plans, gap_plans, cohort_plans)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
