"""Registered queries over the benchmark tables."""
