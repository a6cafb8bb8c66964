"""Find ledger payments that may have been made twice, as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames.  See ``plans`` for the
composed runs, ``operators`` for the single steps and ``sources`` for ingest.
"""

__version__ = "0.1.0"
