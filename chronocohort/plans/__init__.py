"""Pipelines assembled from operators."""
