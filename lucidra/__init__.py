"""Lucidra: a Spark-first engine that audits the reliability of machine-made answers.

Every operator takes DataFrames and column names and returns a DataFrame; Catalyst and
Tungsten choose the physical plan. See README.md for the map of the package.
"""

__version__ = "0.1.0"
