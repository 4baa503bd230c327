"""Readers of source trees, logs and profiles, and writers of results."""
