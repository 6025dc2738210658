"""Operators of a training-data pipeline over large text tables. Nothing outside this package imports it."""
