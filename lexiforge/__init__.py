"""Morphological analysis and corpus operators on PySpark DataFrames."""
