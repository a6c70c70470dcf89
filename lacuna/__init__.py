"""Lacuna: gap-aware panel time-series analytics on Spark DataFrames.

A *cell panel* is the canonical form every operator works on: one row per
``(location, obs_date, variable)`` with a nullable double ``value``; a missing
measurement is NULL, never NaN.
"""
