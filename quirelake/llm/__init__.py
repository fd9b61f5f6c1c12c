"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage.  ``queries.queries()`` and
``queries.oracle_sql()`` hold the registered queries.
"""
