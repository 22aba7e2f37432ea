"""Indexes kept up to date from streams."""
