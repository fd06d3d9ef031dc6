"""finquill: a PySpark engine for financial-statement data."""
