"""Workflow graphs compiled to DataFrames."""
