"""Cohort-scale analysis of medical-image tables on Spark."""
