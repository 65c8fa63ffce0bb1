"""Keyed-table plans and the per-member state that reports are read from."""
