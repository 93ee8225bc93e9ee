"""Relational operators over rounds and unit rows."""
