"""Castwright: streaming."""
