"""Registered queries over the shared test tables, with the SQL they are checked against."""
