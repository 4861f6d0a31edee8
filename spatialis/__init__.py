"""Spatial gene-expression analytics as DataFrame-to-DataFrame operators on Spark."""
