"""Colour analytics over document collections, as Spark DataFrame jobs.

Every public operator takes DataFrames and returns a DataFrame; the work is declared with built-in
Spark expressions, joins, aggregations and windows, so it runs inside the JVM on any cluster size.
"""
