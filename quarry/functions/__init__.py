"""Compilers from JSON to Column: paths, filters, expressions, accumulators, updates, text."""
