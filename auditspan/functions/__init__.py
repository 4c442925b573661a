"""Column -> Column building blocks. Nothing in here is a UDF."""
