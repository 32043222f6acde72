"""Column functions: every one is an expression of Spark built-ins."""
