"""Continuous forms of intake, triage, metrics, limits and run tracking."""
