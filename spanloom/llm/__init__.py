"""Operators that a training-data pipeline needs. Nothing else in spanloom imports this subpackage."""
