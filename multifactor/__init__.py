"""Exploratory multivariate analysis of large tables on Spark DataFrames."""

__version__ = "0.1.0"
