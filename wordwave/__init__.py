"""Symbolic time-series features on Spark."""
