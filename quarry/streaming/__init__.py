"""Incremental re-analysis of a changing source tree."""
