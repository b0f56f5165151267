"""Longitudinal record analytics as declarative Spark plans."""
