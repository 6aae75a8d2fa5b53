"""Whole scans, composed of operators."""
