"""Transcript analytics on Spark: see README.md."""
