"""Operators of a training-data pipeline (one module each) and their queries."""
