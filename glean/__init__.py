"""Concept evidence analytics over time-stamped text, as PySpark DataFrames."""
