"""Queries of the survey operators over the driver's tables, and their SQL."""
