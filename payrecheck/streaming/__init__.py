"""Runs over lines that keep arriving."""
