"""Multichannel time-series, experiment statistics and record contracts on Spark DataFrames."""
