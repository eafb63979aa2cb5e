"""Castwright: plans."""
