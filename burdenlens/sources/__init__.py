"""Readers and writers of calls, phenotypes, saved groups and analysis results."""
