"""Loomdoc: HTML analytics on PySpark DataFrames.

Pages are rows, parsed documents are node rows with pre-order interval
labels, and every query over them is a DataFrame plan.
"""

__version__ = "0.1.0"
