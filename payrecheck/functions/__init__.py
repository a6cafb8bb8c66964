"""Column expressions: text keys, dates, money, names.  No UDFs."""
