"""Longitudinal cohort, outcome-label and event-sequence jobs on Spark DataFrames."""
