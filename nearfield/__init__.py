"""Nearest-neighbour analytics and corpus operators on Spark DataFrames."""
