"""Keyed merge, comparison, repair, change-log replay and metrics."""
