"""Marks as a stream."""
