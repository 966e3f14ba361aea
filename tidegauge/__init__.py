"""Tidegauge: event-impact analytics as PySpark DataFrame operators.

Every operator takes DataFrames and plain parameters and returns a lazy
DataFrame built from native column expressions, joins and windows.
"""
