"""Bundles of operators over one input."""
