"""guardspark: guarded text retrieval and audit analytics as Spark jobs.

Operators are functions ``fn(df, *, column names, parameters) -> DataFrame``
built from Spark column expressions, joins, windows and, where a step is
sequential or numeric by nature, Arrow-batched pandas functions.
"""

__version__ = "0.1.0"
