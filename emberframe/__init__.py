"""Thermal movies, geometry, time series and byte helpers as Spark DataFrames."""

__version__ = "0.1.0"
