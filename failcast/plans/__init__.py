"""Whole experiments and the query catalogue."""
