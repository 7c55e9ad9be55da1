"""Training-data operators: search, binary output, archives, de-duplication, filtering and mixing.

Nothing else in :mod:`rundelta` imports this subpackage.  ``queries.py`` binds the
operators to the tables of a data folder.
"""
