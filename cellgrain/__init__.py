"""Spatial cell analytics and corpus operators as PySpark jobs."""
