"""Operators of a training-data pipeline; nothing else in tessel imports this package."""
