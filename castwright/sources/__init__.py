"""Castwright: sources."""
