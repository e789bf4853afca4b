"""Operators of a training-data pipeline: archives, text extraction, quality, similarity,
tokenisation, mixing and sharding. Nothing else in the library imports this subpackage."""
