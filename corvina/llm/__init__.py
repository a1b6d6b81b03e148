"""Operators of a training-data pipeline: tokens, duplicates, quality, languages, records, packing."""
