"""Readers and writers for transactions, the star schema and the dataset manifest."""
