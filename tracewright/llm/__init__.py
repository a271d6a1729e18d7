"""Training-data operators: ten corpus-scale components and their thin queries.

Nothing else in the library imports this subpackage. ``queries.QUERIES`` and
``queries.ORACLE_SQL`` are what ``__spark_entry__`` adds.
"""
