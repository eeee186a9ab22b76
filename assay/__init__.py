"""Hypothesis testing over large tables with Spark DataFrames."""
