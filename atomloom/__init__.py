"""Spark jobs for analysing collections of structured point sets, with DataFrames."""
