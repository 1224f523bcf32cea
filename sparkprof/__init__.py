"""Profiling, description, model training and reporting over Spark DataFrames.

Every function takes and returns DataFrames (or Columns); the caller owns the
session.  Nothing here collects data: the only values that reach the driver are
fixed-size aggregates (counts, bounds, metrics) and fitted models.
"""
