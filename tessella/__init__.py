"""Cohort analytics on Spark: long tables of measurements, cohorts, resampling, statistics, selection, consensus."""
