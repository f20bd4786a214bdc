"""Operators of a training-data pipeline over the tables documents, pages and
benchmark.  Nothing else in the library imports this package; its queries are
added to the catalogue by ``__spark_entry__`` when it is there."""
