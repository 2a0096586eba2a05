"""Column functions and ordered helpers."""
