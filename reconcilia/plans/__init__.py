"""Whole dataflows, from words and pages to tables."""
