"""Training-data operators on Spark: filters, archives, dedup, sampling, packing and scoring.

Each operator is a module with a general DataFrame interface; ``queries.py`` registers the
thin ``opN_<name>`` queries over the test tables.  Nothing else in the library imports this package.
"""
