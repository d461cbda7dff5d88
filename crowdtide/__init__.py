"""Occupancy analytics as Spark DataFrame operators."""
