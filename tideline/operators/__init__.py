"""Operators on logs and versions."""
