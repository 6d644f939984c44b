"""Interval-delivery analytics on Spark SQL: validation, knowledge history, interval facts, publication."""
