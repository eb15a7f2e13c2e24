"""Gridded forecast analytics as lazy Spark plans."""
