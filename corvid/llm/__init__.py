"""Corpus operators for training data: archives, token files, tokenizing,
quality, language, near and exact duplicates, search and packing.

Nothing else in the library imports this subpackage."""
