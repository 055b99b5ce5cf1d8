"""Operators of a training-data pipeline: cleaning, deduplication, scoring, mixing and packing of text documents."""
