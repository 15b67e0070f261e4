"""echofold: near-duplicate detection and set-similarity analytics on PySpark.

Everything is a function from DataFrames to DataFrames (or from Columns to
Columns); nothing starts a session or collects data unless its docstring says
so.  The subpackage ``llm`` holds training-data operators and is optional:
nothing outside it imports it.
"""

__version__ = "0.1.0"
