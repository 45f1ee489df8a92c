"""Readers, writers, dimension tables and the shared folder for intermediate tables."""
