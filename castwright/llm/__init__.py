"""Operators for preparing training data from transcripts; nothing else in the library imports them."""
