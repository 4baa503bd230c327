"""Composite plans: whole-index builds, reports and reviews."""
