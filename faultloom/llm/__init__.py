"""Operators that prepare text corpora for model training.

Ten operators and the queries that apply them to the shared tables.  Nothing
else in the library imports this subpackage, and it imports nothing from the
rest of the library.
"""
