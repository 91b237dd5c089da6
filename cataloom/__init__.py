"""cataloom: a Spark-native data catalog and retrieval engine.

Every operator is a function from DataFrames to a DataFrame on the public
PySpark API; see README.md for the operator list.
"""

__version__ = "0.1.0"
