"""Operators from files to findings."""
