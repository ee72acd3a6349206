"""Aerial-survey analytics on Spark: telemetry, detections, terrain, coverage and catalogues as DataFrames."""
