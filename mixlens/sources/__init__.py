"""Readers and literal relations."""
