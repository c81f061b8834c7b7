"""Operators of a training-data pipeline: scoring, searching, joining, mixing, sharding, tokenizing."""
