"""Feeds: contracts, line scans and a generated world."""
