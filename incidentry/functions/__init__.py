"""Column functions. Each takes and returns Columns; Arrow UDFs are kept to string similarity and Unicode."""
