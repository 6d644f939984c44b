"""Operators for preparing large text corpora: scoring, deduplication, scanning, packing, media."""
