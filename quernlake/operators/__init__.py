"""Relational, temporal and data-changing operators as DataFrame transformations."""
