"""Whole indexes, services and the catalogue of queries."""
