"""Composed plans: refresh, migration, validation."""
