"""Training-data operators: ten Spark jobs over tables of documents and pages.

Nothing outside this package imports it; ``queries`` holds the thin queries.
"""
