"""Audit analytics for AI coding agents on Spark: sessions, processes, findings and decisions as DataFrames."""
