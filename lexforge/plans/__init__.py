"""Operators composed into whole flows."""
