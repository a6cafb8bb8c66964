"""Ledger sources and sinks."""
