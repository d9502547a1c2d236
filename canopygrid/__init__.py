"""Labelled-grid analytics and decision forests on Spark DataFrames."""
