"""geoprev: spatio-temporal prevalence mapping on Spark DataFrames."""
