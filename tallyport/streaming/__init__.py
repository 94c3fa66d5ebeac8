"""Streaming replay of change logs."""
