"""Operators on logs: folds of events into state, and decisions on commands."""
