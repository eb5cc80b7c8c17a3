"""Sensor-window analytics in Spark DataFrames."""
