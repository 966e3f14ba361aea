"""Operators of a training-data pipeline over tables of texts.

Every operator takes DataFrames and returns DataFrames. Nothing outside this
subpackage imports it; ``queries`` registers one query per operator.
"""
