"""Operators for text corpora: packing, search, duplicates, tokens, pages, languages and mixtures."""
