"""Operators for cleaning and mixing large text corpora. Nothing else in the library imports them."""
