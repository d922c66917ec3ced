"""Cohort-wide analytics of vascular CT scans as Spark DataFrames."""
