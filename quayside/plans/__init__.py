"""Whole jobs that chain operators."""
