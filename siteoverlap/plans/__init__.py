"""Bindings of the test tables, the registered queries and their SQL."""
