"""Ravelin: evidence integration and ranking on Spark."""
