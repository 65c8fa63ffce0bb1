"""Participation and progression analytics on Spark DataFrames."""

from rollcall.model import Calendar, Model, Rules

__all__ = ["Calendar", "Model", "Rules"]
