"""Review and comment analytics on Spark: every operator is a DataFrame or Column transform."""

__version__ = "0.1.0"
