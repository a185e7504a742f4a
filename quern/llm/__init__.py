"""Operators of a large-scale training-data pipeline; nothing else in quern imports this package."""
