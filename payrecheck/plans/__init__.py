"""Composed runs over a whole ledger."""
