"""Column and SQL functions over identifiers."""
