"""Rounds and boards derived from the bundled test tables, with the queries that run on them."""
