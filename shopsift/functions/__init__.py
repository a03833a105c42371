"""Column builders for product listings; none of them is a Python UDF."""
