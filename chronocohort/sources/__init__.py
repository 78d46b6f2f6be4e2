"""Readers, writers, schemas and the adapters over the driver's tables."""
