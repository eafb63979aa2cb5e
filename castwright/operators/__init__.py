"""Castwright: operators."""
