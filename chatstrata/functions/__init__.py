"""Column functions: every one maps columns to a column with Spark built-ins."""
