"""Column functions: keys, statistics and display formatting. No Python UDFs."""
