"""Korean personal-identifier detection and masking on Spark DataFrames."""
