"""Readers, dimension tables and inputs derived from the driver tables."""
