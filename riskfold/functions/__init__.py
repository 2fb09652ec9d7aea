"""Column expressions: every feature is a native Spark expression (no UDF)."""
