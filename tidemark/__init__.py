"""Tidemark: shoreline-change analytics and table operators on Spark DataFrames."""
