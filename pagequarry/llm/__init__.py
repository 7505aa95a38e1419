"""Operators a training-data pipeline needs, each by one named method; nothing else in the package imports them."""
