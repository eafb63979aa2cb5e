"""Castwright: functions."""
