"""Operators for cleaning and preparing training text at scale."""
