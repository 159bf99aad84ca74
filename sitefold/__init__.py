"""sitefold: causal effect estimation with instruments over data split by site, on Spark DataFrames."""

__version__ = "0.1.0"
