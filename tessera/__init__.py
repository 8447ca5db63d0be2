"""Exploratory data analysis and data preparation on Spark DataFrames."""
