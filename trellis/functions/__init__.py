"""Column functions: values, text, filters and parsers. All stay inside Spark's own expressions."""
