"""Whole analyses: operators put together over a set of tables."""
