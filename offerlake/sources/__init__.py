"""Readers, writers and test-data fixtures."""
