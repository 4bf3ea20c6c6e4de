"""Operators of a training-data pipeline and the queries that apply them."""
