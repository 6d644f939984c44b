"""Column functions: keys, measures, calendar."""
