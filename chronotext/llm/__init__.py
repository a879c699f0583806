"""Operators of a training-data pipeline: deduplication, search, mixing, classification, archives, segmentation."""
