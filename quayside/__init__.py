"""Quayside: assistance matching and text-corpus preparation as Spark jobs."""
