"""Whole analyses: what to compare, how to score it, and the ranking that comes out."""
