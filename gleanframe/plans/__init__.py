"""Bundles of operators over one table."""
