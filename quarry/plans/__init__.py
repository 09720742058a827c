"""Pipelines to DataFrame plans."""
