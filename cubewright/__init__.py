"""Multidimensional analytics over fact tables, expressed as Spark DataFrames."""
