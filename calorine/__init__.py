"""Calorine: sensor-telemetry history and corpus processing on Spark DataFrames."""
